"""Removal of byte strings that repeat across documents, by prefix-free parsing.

Corpus order is needed here only as far as it tells which strings of `length` bytes are equal and which document holds
the first of them, so suffixes are compared on their first `length` bytes and the work is split as follows.

1. Parse. A rolling hash over `trigger` bytes picks the trigger with the smallest value in every string of `length`
   bytes, so every such string holds a trigger, and equal strings hold the same one at the same place. A phrase is a
   trigger with the bytes that a string holding it can reach on either side; phrases overlap as in any prefix-free
   parse. The parse is the list of (document, place, phrase).
2. Dictionary. Occurrences are grouped by trigger and sorted by phrase and document. A phrase that a smaller document
   has too settles all of its strings at once, which is what makes highly repetitive text cheap. A trigger with one
   phrase only can hold no other match. What is left are triggers with several phrases, each in its first document.
3. Dictionary suffixes. The strings whose own trigger is of that kind are sorted by content and document; a string
   that a smaller document has is marked.
4. Combination. Both kinds of marks go back to their documents and the union of the marked strings is removed.

All hashes are taken over content by one prefix sum per document, have 64 bits, and are compared within a trigger.

A phrase or string that a smaller document of the same task has is known to be repeated before anything is shuffled;
it travels under a key of its own instead of its trigger's, so a passage that stands in a third of all documents sends
its trigger's group about one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import discard, groups_of_rows, only, stored, text_bytes

LAST = (1 << 63) - 1
BLOCK = 1 << 20
#: Phrases and strings that a task keeps in mind to settle later documents at once; what it forgets is settled after the shuffle.
KNOWN = 1 << 17


@dataclass(frozen=True)
class Shape:
    length: int = 50
    trigger: int = 24

    @property
    def reach(self) -> int:
        return self.length - self.trigger


_random = np.random.default_rng(20)
_VALUE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, n.bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


class Hashes:
    """Hashes of any strings of a byte array, from one prefix sum; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        self._up, down = _power(len(data))
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * down[: len(data)], out=self._sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._mix((self._sum[end] - self._sum[start]) * self._up[start])

    def rolling(self, width: int) -> np.ndarray:
        n = len(self._sum) - width
        return self._mix((self._sum[width:] - self._sum[:n]) * self._up[:n])

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i that has as many."""
    have, out = 1, x
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return out if have == width else pick(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


def _phrase_hash(hashes: Hashes, at: np.ndarray, low: np.ndarray, high: np.ndarray, shape: Shape) -> np.ndarray:
    start, end = np.maximum(low, at - shape.reach), np.minimum(high, at + shape.trigger + shape.reach)
    left = (at - start).astype(np.uint64)
    return hashes.of(start, end) + left * np.uint64(0x94D049BB133111EB) + (end - at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def triggers(data: np.ndarray, ends: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place in it, trigger hash, phrase hash) of the triggers of texts that stand one after the other."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    margin = 2 * shape.length
    for a in range(0, len(data), BLOCK):
        low = max(0, a - margin)
        part = data[low : a + BLOCK + margin]
        if len(part) < shape.length:
            continue
        hashes = Hashes(part)
        rolled = hashes.rolling(shape.trigger)
        least = _slide(rolled, shape.reach + 1, np.minimum)
        # strings that would run over the end of a document do not count
        inner = ends[(ends > low) & (ends < low + len(part))] - low
        for e in inner.tolist():
            least[max(0, e - shape.length + 1) : e] = 0
        last_start = int(ends[-1]) - low - shape.length
        least[max(0, last_start + 1) :] = 0
        padded = np.concatenate([np.zeros(shape.reach, np.uint64), least, np.zeros(len(rolled) - len(least), np.uint64)])
        at = np.flatnonzero(_slide(padded, shape.reach + 1, np.maximum)[: len(rolled)] == rolled)
        at = at[(at + low >= a) & (at + low < a + BLOCK)]
        document = np.searchsorted(ends, at + low, side="right")
        phrase = _phrase_hash(hashes, at, np.maximum(starts[document] - low, 0), np.minimum(ends[document] - low, len(part)), shape)
        yield document, at + low - starts[document], rolled[at], phrase


class Seen:
    """The smallest document so far of contents that several documents of a task have."""

    def __init__(self) -> None:
        self._c, self._d = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which of these contents a smaller document of the task is known to have."""
        order = np.lexsort((d, c))
        first = np.flatnonzero(np.concatenate([[True], c[order][1:] != c[order][:-1]])[: len(c)])
        least = np.empty(len(c), np.int64)
        least[order] = np.repeat(d[order][first], np.diff(first, append=len(c)))
        if len(self._c):
            k = np.minimum(np.searchsorted(self._c, c), len(self._c) - 1)
            least = np.where(self._c[k] == c, np.minimum(least, self._d[k]), least)
        out = d > least
        if out.any():
            both, smallest = np.concatenate([c[out], self._c]), np.concatenate([least[out], self._d])
            self._c, at = np.unique(both, return_index=True)  # the newest entry of a content holds the least document
            self._d = smallest[at]
            if len(self._c) > KNOWN:
                newest = np.sort(np.argsort(at, kind="stable")[:KNOWN])
                self._c, self._d = self._c[newest], self._d[newest]
        return out


def _spread(key: np.ndarray, d: np.ndarray, place: np.ndarray, here: np.ndarray) -> np.ndarray:
    """The key, or for rows that are settled already one of their document and a thousand places: such rows need no
    other, and neighbours of one key take less room on disk than as many different ones."""
    mixed = ((d.view(np.uint64) * np.uint64(_BASE)) ^ ((place.astype(np.uint64) >> np.uint64(10)) * _VALUE[0])) >> np.uint64(20)
    return np.where(here, mixed.view(np.int64), key)


def occurrences(docs: DataFrame, shape: Shape) -> DataFrame:
    """The parse: (g, c, d, r, mark) for each phrase of a document: its trigger's hash, its own, the document and the place.

    A phrase that a document repeats is named once, at its first place. mark is 4 * place, + 2 for such a phrase, + 1 for
    one that a smaller document of the task has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in groups_of_rows(batches, "text", BLOCK):
            data, ends = text_bytes(batch.column("text"))
            ids, rows = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("d", "r"))
            for document, place, g, c in triggers(data, ends, shape):
                order = np.lexsort((place, c, document))
                document, place, g, c = document[order], place[order], g[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (c[1:] != c[:-1])])[: len(order)])
                again = np.diff(first, append=len(order)) > 1
                document, g, c = document[first], g[first], c[first]
                c, d = c.view(np.int64), ids[document]
                here = seen.later(c, d)
                key = _spread((g >> np.uint64(20)).view(np.int64), d, place[first], here)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, c, d, rows[document], 4 * place[first] + 2 * again + here)], ["g", "c", "d", "r", "mark"])

    return docs.mapInArrow(run, "g long, c long, d long, r long, mark long")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From occurrences sorted by (g, c, d): those whose phrase a smaller document has (settled), and the occurrences
    in a phrase's first document where the trigger has other phrases (open). Only the state of the last trigger and
    its first document's places are carried from one batch to the next."""
    last_g = last_c = first_d = None
    runs, pending = 0, []

    def rows(d: np.ndarray, r: np.ndarray, mark: np.ndarray, c: np.ndarray, settled: np.ndarray) -> pa.RecordBatch:
        pos = np.where(mark & 2, -1 - (mark >> 2), mark >> 2).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d, r, pos, c, settled)], ["d", "r", "pos", "c", "settled"])

    for batch in batches:
        g, c, d, r, mark = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("g", "c", "d", "r", "mark"))
        here = (mark & 1).astype(bool)
        if here.any():
            yield rows(d[here], r[here], mark[here], c[here], here[here])
            g, c, d, r, mark = (x[~here] for x in (g, c, d, r, mark))
        if not len(g):
            continue
        n = len(g)
        new_g = np.concatenate([[last_g is None or g[0] != last_g], g[1:] != g[:-1]])
        new_c = new_g | np.concatenate([[last_c is None or c[0] != last_c], c[1:] != c[:-1]])
        begin = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
        own_first = np.where(begin >= 0, d[np.maximum(begin, 0)], first_d if first_d is not None else 0)
        settled = d > own_first
        group = np.cumsum(new_g)  # 0: still the trigger of the batch before
        runs_of = np.bincount(group, weights=new_c, minlength=int(group[-1]) + 1).astype(np.int64)
        runs_of[0] += runs
        is_open = ~settled & (runs_of[group] > 1)
        if pending and runs_of[0] > 1:
            for p in pending:
                yield rows(*p, np.zeros(len(p[0]), bool))
            pending = []
        if int(group[-1]) > 0:
            pending = []
        take = settled | is_open
        if take.any():
            yield rows(d[take], r[take], mark[take], c[take], settled[take])
        if runs_of[group[-1]] == 1:
            wait = (group == group[-1]) & ~settled
            pending.append((d[wait], r[wait], mark[wait], c[wait]))
        last_g, last_c, first_d, runs = g[-1], c[-1], own_first[-1], int(runs_of[group[-1]])


def _open_strings(shape: Shape):  # noqa: ANN202
    """From texts with their marks: (k, w, d, r, mark) for each string whose own trigger is open and that no settled phrase covers.

    k is the string's hash; where mark says that a smaller document of the task has it, the hash is w and k any number.

    A string's own trigger has the smallest rolling hash in it, so it is at the same place wherever the string occurs.
    If it is neither open nor settled, the string occurs again only in that trigger's phrase, and is settled there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in groups_of_rows(batches, "text", BLOCK):
            hs, ds, rs, ps = [], [], [], []
            for k in range(batch.num_rows):
                data = np.frombuffer((batch.column("text")[k].as_py() or "").encode(), np.uint8)
                if len(data) < shape.length:
                    continue
                hashes = Hashes(data)
                at, settled = _checked(hashes, len(data), batch, k, shape)
                if settled.all():
                    continue
                rolled = hashes.rolling(shape.trigger)
                opened = np.full_like(rolled, np.iinfo(np.uint64).max)
                opened[at[~settled]] = rolled[at[~settled]]
                own = _slide(opened, shape.reach + 1, np.minimum) == _slide(rolled, shape.reach + 1, np.minimum)
                start = np.flatnonzero(own & ~_starts(at[settled], len(data), shape)[: len(own)])
                hs.append(hashes.of(start, start + shape.length).view(np.int64))
                ds.append(np.full(len(start), batch.column("d")[k].as_py()))
                rs.append(np.full(len(start), batch.column("r")[k].as_py()))
                ps.append(start)
            if hs:
                w, d, r, place = (np.concatenate(x) for x in (hs, ds, rs, ps))
                here = seen.later(w, d)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_spread(w, d, place, here), np.where(here, w, 0), d, r, 2 * place + here)], ["k", "w", "d", "r", "mark"])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings sorted by (k, d): those that a smaller document has. Only the last string and its first document are carried."""
    last_w = first_d = None
    for batch in batches:
        k, w, d, r, mark = (batch.column(n).to_numpy() for n in ("k", "w", "d", "r", "mark"))
        again = (mark & 1).astype(bool)
        w = np.where(again, w, k)
        live = np.flatnonzero(~again)
        if len(live):
            w_, d_ = w[live], d[live]
            new = np.concatenate([[last_w is None or w_[0] != last_w], w_[1:] != w_[:-1]])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(w_)), -1))
            first = np.where(begin >= 0, d_[np.maximum(begin, 0)], first_d if first_d is not None else 0)
            last_w, first_d = w_[-1], first[-1]
            again[live] = d_ > first
        yield pa.RecordBatch.from_arrays([pa.array(x[again]) for x in (w, d, r, (mark >> 1).astype(np.int32))], ["w", "d", "r", "pos"])


def _checked(hashes: Hashes, n: int, batch: pa.RecordBatch, k: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """A document's phrase marks that hold in this text (rows may share a doc_id), and which are settled."""
    marks = batch.column("marks")[k].values
    if marks is None:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at, c, settled = marks.field("pos").to_numpy().astype(np.int64), marks.field("c").to_numpy(), marks.field("settled").to_numpy(zero_copy_only=False)
    again, at = at < 0, np.where(at < 0, -1 - at, at)
    phrase = lambda p: _phrase_hash(hashes, p, np.zeros_like(p), np.full_like(p, n), shape).view(np.int64)
    inside = at + shape.trigger <= n
    at, c, settled, again = at[inside], c[inside], settled[inside], again[inside]
    same = phrase(at) == c
    at, c, settled, again = at[same], c[same], settled[same], again[same]
    if again.any():  # equal phrases have equal triggers, and are phrases wherever they stand
        rolled = hashes.rolling(shape.trigger)
        places = np.flatnonzero(np.isin(rolled, rolled[at[again]]))
        order = np.argsort(c[again])
        known, kinds = c[again][order], settled[again][order]
        found = phrase(places)
        k = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[k] == found
        at, settled = np.concatenate([at[~again], places[hit]]), np.concatenate([settled[~again], kinds[k[hit]]])
    return at, settled


def _starts(at: np.ndarray, n: int, shape: Shape) -> np.ndarray:
    """Which places start a string that holds one of the triggers."""
    edge = np.zeros(n + 1, np.int32)
    low, high = np.maximum(0, at - shape.reach), np.minimum(at, n - shape.length)
    ok = low <= high
    np.add.at(edge, low[ok], 1)
    np.add.at(edge, high[ok] + 1, -1)
    return np.cumsum(edge)[:n] > 0


def _removed(shape: Shape):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "text", BLOCK):
            out = []
            for k in range(batch.num_rows):
                text = (batch.column("text")[k].as_py() or "").encode()
                gone = np.zeros(0, np.int64)
                has = batch.column("marks")[k].is_valid, batch.column("strings")[k].is_valid
                if len(text) >= shape.length and any(has):
                    data = np.frombuffer(text, np.uint8)
                    hashes = Hashes(data)
                    start = np.zeros(len(data), bool)
                    if has[0]:
                        at, settled = _checked(hashes, len(data), batch, k, shape)
                        start |= _starts(at[settled], len(data), shape)
                    if has[1]:
                        strings = batch.column("strings")[k].values
                        at, w = strings.field("pos").to_numpy().astype(np.int64), strings.field("w").to_numpy()
                        inside = at + shape.length <= len(data)
                        at, w = at[inside], w[inside]
                        start[at[hashes.of(at, at + shape.length).view(np.int64) == w]] = True
                    edge = np.zeros(len(data) + 1, np.int32)
                    first = np.flatnonzero(start)
                    edge[first] += 1
                    edge[first + shape.length] -= 1
                    gone = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)))
                spans = gone.reshape(-1, 2).tolist()
                kept, before = [], 0
                for a, b in spans:
                    kept.append(text[before:a])
                    before = b
                rest = b"".join([*kept, text[before:]])
                out.append((len(text), len(text) - len(rest), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")))
            n, removed, spans, digest, rest = (list(x) for x in zip(*out, strict=True))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(digest), pa.array(rest)],
                ["_row", "n_bytes", "n_removed", "spans", "kept_sha256", "kept_text"],
            )

    return run


def repeated_strings(docs: DataFrame, shape: Shape = Shape(), keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: _row (the columns in keep), n_bytes, n_removed, spans [start, end), kept_sha256, kept_text.

    A byte is removed if a string of `length` bytes covers it that also starts in a document with a smaller doc_id.
    Rows without a doc_id count as larger than all others and equal to each other; rows with one doc_id, repeated rows
    too, do not remove each other's text. Null text is empty; an empty table gives no rows; columns besides doc_id
    and text are not read. A very long text is parsed in stretches and held whole only in its own task. kept_text leaves
    out bytes of characters that were cut in two.
    """
    keep = keep or ["doc_id"]
    text = F.col("text").cast("string")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d")
    # rows without a doc_id are told apart by their texts, so that they are no group
    r = F.when(F.col("doc_id").isNull(), F.coalesce(F.xxhash64(text), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("r")
    texts = docs.select(d, r, text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"))
    plain = only(docs, doc_id="long", text="string").select(d, r, "text")
    parsed = occurrences(plain, shape).repartition("g").sortWithinPartitions("g", "c", "d")
    marks = stored(parsed.mapInArrow(_settle, "d long, r long, pos int, c long, settled boolean"), "marks")
    row_key = ["d", "r"]
    opened = marks.where("not settled").select(*row_key).distinct()
    of_doc = marks.join(opened, row_key, "left_semi").groupBy(*row_key).agg(F.collect_list(F.struct("pos", "c", "settled")).alias("marks"))
    strings = plain.join(of_doc, row_key).mapInArrow(_open_strings(shape), "k long, w long, d long, r long, mark long")
    found = stored(strings.repartition("k").sortWithinPartitions("k", "d").mapInArrow(_later, "w long, d long, r long, pos int"), "strings")
    of_strings = found.groupBy(*row_key).agg(F.collect_list(F.struct("pos", "w")).alias("strings"))
    settled = marks.where("settled").groupBy(*row_key).agg(F.collect_list(F.struct("pos", "c", "settled")).alias("marks"))
    both = stored(settled.join(of_strings, row_key, "full_outer"), "spans")
    discard(marks, found)
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*(f"`{c}`" for c in keep)).schema)
    return texts.join(both, row_key, "left").select("text", "marks", "strings", "_row").mapInArrow(
        _removed(shape), f"_row struct<{row}>, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept_text string"
    )
