"""Benchmark passages in documents: SimHash of item-sized windows, a multi-index over Hamming blocks, exact similarity.

A window that is similar enough to an item shares at least one shingle with it, so windows are laid only around the
places where a document holds a shingle of the benchmark; that loses nothing. Each such window of an item's size gets
a SimHash fingerprint from running bit sums. The fingerprints of the items are indexed by RADIUS + 1 blocks of bits:
two fingerprints within the radius agree in at least one block, so the look-up finds all of them. The weighted Jaccard
similarity of the shingle multisets (a shingle's weight is how often it occurs) then decides.

The benchmark is the query set. It is taken in blocks of bounded size, each sent to all tasks; documents never move.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import groups_of_rows, only

#: Bits by which the fingerprints of a window and its item may differ; at a similarity of 0.8 about ten do.
RADIUS = 19
#: Bytes of benchmark text that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
_FOLD = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def folded_words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates like white space."""
    return (text or "").lower().encode(errors="replace").translate(_FOLD).split()


def shingles(tokens: list[bytes], size: int) -> np.ndarray:
    """64-bit hashes of the shingles in order (fewer words: the whole sequence; none: nothing)."""
    if len(tokens) <= size:
        return np.asarray([xxhash.xxh64_intdigest(b" ".join(tokens))] if tokens else [], np.uint64)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(tokens[k : k + size])) for k in range(len(tokens) - size + 1)), np.uint64, len(tokens) - size + 1)


def fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each run of `width` shingles: a bit is set if it is in over half of them."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    most = (2 * (sums[width:] - sums[:-width]) > width).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view("<u8").reshape(-1)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: the smaller counts over the larger ones."""
    both = sum(min(n, b[h]) for h, n in a.items() if h in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


@dataclass
class Index:
    """A block of the benchmark, by item length in words."""

    size: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    codes: dict[int, tuple[np.ndarray, list[list[int]]]] = field(default_factory=dict)
    items: list[tuple[int, int, Counter]] = field(default_factory=list)  # item_id, words, shingles
    tables: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], size: int) -> Index:
        out = cls(size)
        of_code: dict[int, dict[int, set[int]]] = {}
        prints: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            tokens = folded_words(text)
            if not tokens:
                continue
            k, n = len(out.items), len(tokens)
            hashes = shingles(tokens, size)
            out.items.append((item_id, n, Counter(hashes.tolist())))
            ids = np.asarray([out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in tokens], np.uint64)
            width = min(size, n)
            for code in _codes(ids, width).tolist():
                of_code.setdefault(width, {}).setdefault(code, set()).add(n)
            prints.setdefault(n, []).append((int(fingerprints(hashes, len(hashes))[0]), k))
        for width, found in of_code.items():
            order = np.asarray(sorted(found), np.uint64)
            out.codes[width] = order, [sorted(found[int(c)]) for c in order]
        for n, found in prints.items():
            prints_of, places = np.asarray([p for p, _ in found], np.uint64), np.asarray([k for _, k in found])
            blocks = []
            for value in _blocks(prints_of):
                order = np.argsort(value, kind="stable")
                blocks.append((value[order], order))
            out.tables[n] = prints_of, places, blocks
        return out

    def near(self, n: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) with fingerprints within the radius, of windows and items of n words."""
        own, places, blocks = self.tables[n]
        pairs: set[tuple[int, int]] = set()
        for value, (ordered, order) in zip(_blocks(prints), blocks, strict=True):
            low, high = np.searchsorted(ordered, value, "left"), np.searchsorted(ordered, value, "right")
            count = high - low
            window = np.repeat(np.arange(len(prints)), count)
            item = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            close = np.bitwise_count(prints[window] ^ own[item]) <= RADIUS
            pairs.update(zip(window[close].tolist(), places[item[close]].tolist(), strict=True))
        return sorted(pairs)

    def matches(self, text: str | None, least: float) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window of each item; the first of equally good ones."""
        tokens = folded_words(text)
        if not tokens:
            return []
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.uint64, len(tokens))
        best: dict[int, tuple[int, int, int, float]] = {}
        wanted: dict[int, list[np.ndarray]] = {}
        for width, (codes, lengths) in self.codes.items():
            if len(ids) < width:
                continue
            known = np.cumsum(np.concatenate([[0], ids == 0]))
            place = np.flatnonzero(known[width:] == known[:-width])
            code = _codes(ids, width)[place]
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            for p, c in zip(place[hit].tolist(), at[hit].tolist(), strict=True):
                for n in lengths[c]:
                    first, last = max(0, p + width - n), min(p, len(tokens) - n)
                    wanted.setdefault(n, []).append(np.arange(first, last + 1) if len(tokens) >= n else np.zeros(1, np.int64))
        for n, ranges in wanted.items():
            starts = np.unique(np.concatenate(ranges))
            # runs of neighbouring windows share their running sums
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
                if not len(run):
                    continue
                low, high = int(run[0]), min(len(tokens), int(run[-1]) + n)
                hashes = shingles(tokens[low:high], self.size)
                width = max(1, min(n, high - low) - self.size + 1)
                found = fingerprints(hashes, width)[run - low]
                for window, k in self.near(n, found):
                    at = int(run[window])
                    item_id, _, counts = self.items[k]
                    score = similarity(Counter(hashes[at - low : at - low + width].tolist()), counts)
                    if score >= least and (item_id not in best or score > best[item_id][3]):
                        best[item_id] = (item_id, at, min(n, len(tokens)), score)
        return list(best.values())


def _codes(ids: np.ndarray, width: int) -> np.ndarray:
    n = len(ids) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(29))) * _STEP + ids[k : k + n]
    return out


def _blocks(prints: np.ndarray) -> Iterator[np.ndarray]:
    """The bits of each of the RADIUS + 1 blocks."""
    edges = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)


def _indexes(benchmark: DataFrame, size: int) -> Iterator[Index]:
    items = only(benchmark, item_id="long", text="string")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES
        yield Index.of([(r.item_id, r.text) for r in rows], size)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """One row (doc_id, item_id, start_word, n_words, similarity) for each document and item it holds a close copy of.

    Null and empty texts hold nothing, and such items are held by nothing; a text shorter than an item is compared
    as a whole. Repeated rows are reported each; an empty table on either side gives no rows; other columns are not
    read. Words are counted after punctuation is taken for white space.
    """
    plain, out = only(docs, doc_id="long", text="string"), None
    for index in _indexes(benchmark, size):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in groups_of_rows(batches, "text"):
                rows = [(k, *m) for k, text in enumerate(batch.column("text")) for m in shared.value.matches(text.as_py(), least)]
                if rows:
                    k, item, start, n, score = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(k)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(score)],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        part = plain.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of docs that hold no item, with their own columns; nothing is shuffled."""
    for index in _indexes(benchmark, size):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in groups_of_rows(batches, "text"):
                yield batch.filter(pa.array([not shared.value.matches(text.as_py(), least) for text in batch.column("text")]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
