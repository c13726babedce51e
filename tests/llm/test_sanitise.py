"""Personal data: patterns against the plain regular expressions, disclosure against counts over all texts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from obsflow.llm import sanitise

SCHEMA = "doc_id long, text string, key string, hits long, term string, spans string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            value = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            fits = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "phone": 9 <= len(digits) <= 15,
                "card": 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in value) % 10 == 0,
            }
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_equals_the_plain_patterns():
    draw = random.Random(2)
    parts = ["a.b@c.de", "@", "x@y", "a@b.c@d.e", "..@-.-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (743) 555-3824", "+12", "++49(0)30.1234-56", "+1", " ", "é", "word", "\n", "-", "7", "."]
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randint(1, 8)))
        assert sanitise.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1 " * 100_000, "a." * 100_000 + "@"):
        sanitise.base_spans(run)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("aeioulnrst", k=draw.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [prose(draw.randint(5, 60)) for _ in range(300)]
    out += [f"{prose(20)} Quillfeather {prose(2)} mail to q@ex.org or 4711 {prose(20)}" for _ in range(12)]  # a name beside an address in texts of their own
    out += [f"{prose(15)} Quillfeather {prose(15)}"]  # and alone: it is removed there too
    copy = f"{prose(20)} Onlyhere {prose(3)} z@ex.org {prose(20)}"
    out += [copy] * 60  # copies are one witness
    out += [f"{prose(8)} half {prose(2)} h@ex.org {prose(9)}" for _ in range(9)] + [f"{prose(8)} half {prose(12)}" for _ in range(40)]
    out += [None, "", " \n", "1.2.3.4 +1 (743) 555-3824", "long " + prose(30000) + " end@of.text"]
    return list(enumerate(out)) + [(3, out[3]), (None, out[301])]


def disclosed(texts, least, support=3.0, reach=8):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    n_term, n_entity, both, contexts = Counter(), Counter(), Counter(), defaultdict(Counter)
    for _, text in texts:
        text = text or ""
        spans = plain(text)
        bare = list(text)
        for _, a, b in spans:
            bare[a:b] = " " * (b - a)
        found = [(m.start(), fold(m[0])) for m in term.finditer("".join(bare))]
        n_term.update({t for _, t in found})
        near = defaultdict(set)
        for kind, a, b in spans:
            value = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub("[^0-9]", "", text[a:b])
            near[f"{kind}:{value}"] |= {t for _, t in [x for x in found if x[0] < a][-reach:] + [x for x in found if x[0] >= b][:reach]}
        n_entity.update(near.keys())
        words = [t for _, t in found]
        known_by = min(sanitise.xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2)))
        for e, terms in near.items():
            for t in terms:
                both[t, e] += 1
                contexts[t, e][known_by] += 1
    out = {}
    for (t, e), n in both.items():
        c = contexts[t, e].values()
        if sum(c) ** 2 / sum(x * x for x in c) >= support and n_entity[e] < len(texts):
            share = math.log2(len(texts) * n / (n_term[t] * n_entity[e])) / math.log2(len(texts) / n_entity[e])
            if share >= least:
                out[t] = min(out.get(t, (0, "~")), (-share, e))
    return {t: (e, round(-s, 9)) for t, (s, e) in out.items()}


@pytest.mark.parametrize("least", [0.8, 0.3])
def test_disclosure_equals_counts(spark, texts, least):
    frame = spark.createDataFrame([(i, t, "k", 1, "t", "s") for i, t in texts], SCHEMA).repartition(4)
    found = {r.term: (r.entity, round(r.disclosure, 9)) for r in sanitise.disclosing_terms(frame, least).collect()}
    assert found == disclosed(texts, least)
    assert "quillfeather" in found and "onlyhere" not in found


def test_spans_and_clean_texts(spark, texts):
    frame = spark.createDataFrame([(i, t, "k", 1, "t", "s") for i, t in texts], SCHEMA).repartition(4)
    rows = sanitise.sanitised(frame).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    of = dict(texts)
    for r in rows:
        text, base = of[r.doc_id] or "", plain(of[r.doc_id] or "")
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert spans[: len(told)] == told and len(spans) == len(told) + r.n_terms
        named = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in spans[len(told) :])]
        assert named.count("Quillfeather") == text.count("Quillfeather")
        assert "Quillfeather" not in r.clean_text and "@" not in r.clean_text and "Onlyhere" not in named
        if not spans:
            assert r.clean_text == text
    assert sanitise.sanitised(frame.limit(0)).isEmpty()


def test_generalised_or_removed(spark):
    disclosing = spark.createDataFrame([("quill", "email:a", 0.99, 1, 3.0), ("1984", "email:a", 0.85, 1, 3.0), ("jo", "email:a", 0.85, 1, 3.0), ("by", "email:a", 0.85, 1, 3.0)], "term string, entity string, disclosure double, documents long, contexts double")
    docs = spark.createDataFrame([(1, "Jo QUILL, born 1984 by a@b.cd. Quilly")], "doc_id long, text string")
    (row,) = sanitise.sanitised(docs, disclosing).collect()
    assert row.clean_text == "[NAME] , born [NUMBER] [WORD] [EMAIL]. Quilly"
    assert row.spans == "email:23:29,term:0:2,term:3:8,term:15:19,term:20:22" and row.n_terms == 4
