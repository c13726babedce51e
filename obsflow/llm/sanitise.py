"""Personal data: patterns, and terms that reveal what the patterns found.

The patterns find emails, IP addresses, cards and phone numbers. Their values are the protected entities. The corpus says
what a term tells about an entity: with n(t), n(e) and n(t, e) the documents that hold t, that hold e, and that hold t
within REACH terms of e, of N documents, t discloses the share

    log2(N n(t, e) / (n(t) n(e))) / log2(N / n(e))

of the information content of e: 1 if every document with t has e beside it, 0 if they are independent. Terms that
disclose at least `generalise` of some entity are replaced by their kind wherever they stand, from `remove` on they go.
A share counts only with SUPPORT independent texts: a text is known by the smallest hash of its SHINGLE-term sequences,
which near copies have in common as often as they are similar, and (sum of counts)^2 / sum of squared counts is how many
texts of equal weight there would be, so a thousand copies of one text are one witness.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import groups_of_rows, only, stored
from obsflow.llm.lexical import terms_of

KINDS = ("email", "ip", "card", "phone")
REACH, SUPPORT, SHINGLE = 8, 3.0, 3
GENERALISE, REMOVE = 0.8, 0.95

# What the kinds look like. The forms below match the same spans as the plain patterns in one pass over long
# runs: a run of digits is never entered in the middle, and an email is looked for from its @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER, _FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _FOLDED)
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            last = tail.end()
            yield start, last
        at = text.find("@", max(last, at + 1))


def luhn(digits: str) -> bool:
    values = [ord(d) - 48 for d in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind as in KINDS, then by start."""
    out = [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def entity(text: str, span: Span) -> str:
    kind, start, end = span
    value = text[start:end]
    return f"{kind}:{value.translate(_FOLD) if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def masked(text: str, spans: list[Span]) -> str:
    """text with spaces in place of spans: terms never come from inside of what was found."""
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if end > at:
            parts += [text[at : max(at, start)], " " * (end - max(at, start))]
            at = end
    return "".join([*parts, text[at:]])


def beside(text: str, bare: str, spans: list[Span], reach: int) -> tuple[dict[str, set[str]], int]:
    """For each entity of a text, the terms within reach of it on either side; and what the text is known by."""
    terms = [(m.start(), m[0].translate(_FOLD)) for m in _TERM.finditer(bare)]
    starts, out = [s for s, _ in terms], {}
    for span in spans:
        left, right = bisect_left(starts, span[1]), bisect_left(starts, span[2])
        near = terms[max(0, left - reach) : left] + terms[right : right + reach]
        out.setdefault(entity(text, span), set()).update(t for _, t in near)
    words = [t for _, t in terms]
    sequences = (" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1)))
    return out, min(map(xxhash.xxh64_intdigest, sequences)) >> 1


def _evidence(docs: DataFrame, reach: int) -> DataFrame:
    """Counts from all texts: n documents with a term; with an entity; with a term beside an entity in a context; n in all."""

    def rows(texts: list[str | None]) -> Iterator[tuple[str | None, str | None, int | None, int]]:
        pairs, entities, bare = Counter(), Counter(), []
        for text in texts:
            text = text or ""
            spans = base_spans(text)
            bare.append(masked(text, spans))
            if not spans:
                continue
            near, known_by = beside(text, bare[-1], spans, reach)
            entities.update(near.keys())
            pairs.update((t, name, known_by) for name, terms in near.items() for t in terms)
        tokens, lengths = terms_of(pa.array(bare, pa.large_string()))
        encoded = tokens.dictionary_encode()
        n_terms = max(1, len(encoded.dictionary))
        held = np.unique(np.repeat(np.arange(len(texts)), lengths) * n_terms + encoded.indices.to_numpy(zero_copy_only=False))
        counts = np.bincount(held % n_terms, minlength=n_terms).tolist()
        yield None, None, None, len(texts)
        yield from ((t, None, None, n) for t, n in zip(encoded.dictionary.to_pylist(), counts, strict=False))
        yield from ((None, e, None, n) for e, n in entities.items())
        yield from ((t, e, s, n) for (t, e, s), n in pairs.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "text"):
            columns = list(zip(*rows(batch.column("text").to_pylist()), strict=True))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["term", "entity", "context", "n"])

    return docs.select("text").mapInArrow(run, "term string, entity string, context long, n long")


def disclosing_terms(docs: DataFrame, least: float = GENERALISE, support: float = SUPPORT, reach: int = REACH) -> DataFrame:
    """(term, entity, disclosure, documents, contexts): terms of docs (text) that reveal an entity, with the one they reveal most.

    Counts are of all documents. A tie goes to the least entity. An entity that every document holds has no information
    to disclose. Null and empty texts are documents without terms; an empty table gives no rows.
    """
    found = stored(_evidence(only(docs, text="string"), reach), "evidence")
    total = found.where("term is null and entity is null").agg(F.sum("n")).first()[0] or 0
    contexts = found.where("context is not null").groupBy("term", "entity", "context").agg(F.sum("n").alias("n"))
    pairs = contexts.groupBy("term", "entity").agg(F.sum("n").alias("n_both"), (F.pow(F.sum("n"), F.lit(2)) / F.sum(F.col("n") * F.col("n"))).alias("contexts"))
    pairs = stored(pairs.where(F.col("contexts") >= support), "pairs")
    terms = found.where("entity is null and term is not null").join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    entities = found.where("term is null and entity is not null").groupBy("entity").agg(F.sum("n").alias("n_entity"))
    both = pairs.join(terms, "term").join(entities, "entity")
    told = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")).cast("double")) / F.log2(F.lit(float(total)) / F.col("n_entity"))
    both = both.where(F.col("n_entity") < total).withColumn("disclosure", told).where(F.col("disclosure") >= least)
    most = F.min_by(F.struct("entity", "disclosure", F.col("n_term").alias("documents"), "contexts"), F.struct(-F.col("disclosure"), "entity"))
    return both.groupBy("term").agg(most.alias("b")).select("term", "b.*")


def _kind_of(word: str) -> str:
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]"


def cleaned(text: str, base: list[Span], terms: list[Span], removed: set[str]) -> str:
    """text with its spans replaced by their kinds; overlapping ones of patterns become one, named after the first."""
    parts, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in base + terms):
        if start < at:
            at = max(at, end)
            continue
        word = text[start:end]
        new = f"[{kind.upper()}]" if kind != "term" else "" if word.translate(_FOLD) in removed else _kind_of(word)
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, clean_text string"


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups_of_rows(batches, "text"):
        out = []
        for doc_id, text, hits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "hits")), strict=True):
            text = text or ""
            base, terms, removed = base_spans(text), [], set()
            if hits:
                wanted, removed = {h["term"] for h in hits}, {h["term"] for h in hits if h["removed"]}
                terms = [("term", *m.span()) for m in _TERM.finditer(masked(text, base)) if m[0].translate(_FOLD) in wanted]
            told = [",".join(f"{k}:{s}:{e}" for k, s, e in spans) for spans in (base, base + terms)]
            n = Counter(k for k, _, _ in base)
            out.append((doc_id, *(n[k] for k in KINDS), hashlib.sha256(told[0].encode()).hexdigest(), told[1], len(terms), cleaned(text, base, terms, removed)))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def sanitised(docs: DataFrame, disclosing: DataFrame | None = None, remove: float = REMOVE) -> DataFrame:
    """One row for each of docs (doc_id, text), see RESULT: counts and spans of what was found, and clean_text without it.

    Spans are kind:start:end in code points, the end exclusive, patterns first and then terms; disclosing is the table
    of disclosing_terms(), by default that of docs. A null or empty text has no spans and stays empty. Repeated rows
    and null ids stay rows of their own; other columns are ignored, whatever their names. Texts are read whole: a very
    long one takes time in proportion to its length. An empty table gives no rows.
    """
    disclosing = stored(disclosing_terms(docs) if disclosing is None else disclosing, "disclosing")
    own = only(docs, doc_id="long", text="string").withColumn("key", F.md5("text"))
    found = disclosing.select("term", (F.col("disclosure") >= remove).alias("removed"))
    pattern = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = own.select("key", F.explode(F.array_distinct(F.split(F.translate("text", _UPPER, _FOLDED), pattern))).alias("term"))
    hits = stored(words.join(found, "term").groupBy("key").agg(F.collect_set(F.struct("term", "removed")).alias("hits")), "hits")
    return own.join(hits, "key", "left").select("doc_id", "text", "hits").mapInArrow(_sanitise, RESULT)
