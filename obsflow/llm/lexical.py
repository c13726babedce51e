"""Ranked lexical search over bit-sliced Bloom signatures.

The index has a row for each block of documents. A term of a document sets HASHES bits of its signature, a term that
occurs 2, 4, 8, ... times sets more under keys of their own, and the signatures are stored by slices: one bitmap of
documents for each bit. The slices of a query term, ANDed, show every document that has the term and some that do not;
the class of its count bounds its share of the score. The weighted sum over a query's terms is thus an upper bound, and
every document whose bound reaches the tenth best score so far is rescored from its stored terms. Documents of similar
size share a block, so that long ones do not fill the signatures of short ones. The index is a table: build it once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsflow.llm.common import groups_of_rows, only, stored, text_bytes

HASHES, CLASSES = 6, 7
#: Documents of a block at most, bytes of text that are sorted by size together, and bytes of queries in one pass.
BLOCK_DOCS, BLOCK_BYTES, QUERY_BYTES, QUERY_GROUP = 2048, 8 << 20, 8 << 20, 256
NO_ID = -(1 << 63)
_TERM = np.ones(256, bool)
_TERM[np.r_[0x00:0x30, 0x3A:0x41, 0x5B:0x61, 0x7B:0x80]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

INDEX = (
    "block long, doc_ids array<long>, lengths array<int>, terms array<string>, ends array<int>, codes array<int>, counts array<int>, width int, slices binary"
)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in order, lower-cased, and how many each text has (null: none)."""
    raw, ends = text_bytes(texts)
    inside = _TERM[raw]
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    before[ends[:-1][ends[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    offsets = np.concatenate([np.cumsum(inside)[starts] - 1, [inside.sum()]]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]]))
    places = np.concatenate([[0], np.searchsorted(starts, ends)])
    return found, np.diff(places)


def term_hashes(terms: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) for t in terms.cast(pa.large_binary()).to_pylist()), np.uint64, len(terms))


def _slices_of(hashes: np.ndarray, kind: np.ndarray | int, width: int) -> np.ndarray:
    """(HASHES, n): the slices of terms in a class of counts."""
    h = (hashes + np.asarray(kind).astype(np.uint64) * _STEP) * _MIX
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) % np.uint64(width)).astype(np.int64) for k in range(HASHES)])


def _blocks(ids: np.ndarray, texts: pa.Array) -> Iterator[dict]:
    """Index rows of some documents, by the number of their different terms."""
    tokens, lengths = terms_of(texts)
    encoded = tokens.dictionary_encode()
    terms, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_terms = max(1, len(terms))
    entries, counts = np.unique(np.repeat(np.arange(len(ids)), lengths) * n_terms + code, return_counts=True)
    doc, code = entries // n_terms, entries % n_terms
    distinct = np.bincount(doc, minlength=len(ids))
    begins = np.concatenate([[0], np.cumsum(distinct)])
    hashes = term_hashes(terms)
    classes = np.minimum(np.frexp(counts)[1] - 1, CLASSES - 1)
    keys = np.bincount(doc, weights=classes + 1, minlength=len(ids)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    order = order[lengths[order] > 0]  # the others match nothing
    at = 0
    while at < len(order):
        limit = max(2 * int(keys[order[at]]), 64)
        to = min(at + BLOCK_DOCS, int(np.searchsorted(keys[order], limit, side="right")))
        rows, at = order[at : max(to, at + 1)], max(to, at + 1)
        take = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in rows])
        n = distinct[rows]
        own, codes = np.unique(code[take], return_inverse=True)
        width = max(8, math.ceil(int(keys[rows].max()) * HASHES / math.log(2)))
        bits = np.zeros((width, -(-len(rows) // 8) * 8), bool)
        place = np.repeat(np.arange(len(rows)), n)
        for kind in range(int(classes[take].max()) + 1):
            there = classes[take] >= kind
            bits[_slices_of(hashes[code[take][there]], kind, width), place[there]] = True
        yield {
            "doc_ids": [None if i == NO_ID else i for i in ids[rows].tolist()], "lengths": lengths[rows].astype(np.int32), "terms": terms.take(pa.array(own)), "ends": np.cumsum(n).astype(np.int32),
            "codes": codes.astype(np.int32), "counts": counts[take].astype(np.int32), "width": width, "slices": np.packbits(bits, axis=1).tobytes(),
        }


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text): a row for each block, see INDEX. Nothing is shuffled.

    Texts without a term (null ones too) are in no block. Repeated rows and null ids are documents like others. A very
    long text is a block of its own. Other columns are ignored; an empty table gives an empty index.
    """

    def rows(ids: list, held: list[pa.Array], block: int) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_ids": pa.int64(), "lengths": pa.int32(), "terms": pa.string(), "ends": pa.int32(), "codes": pa.int32(), "counts": pa.int32()}
        for row in _blocks(np.concatenate(ids), pa.chunked_array(held).combine_chunks()):
            columns = {k: pa.ListArray.from_arrays(pa.array([0, len(row[k])], pa.int32()), pa.array(row[k], v) if k != "terms" else row[k].cast(v)) for k, v in kinds.items()}
            columns = {"block": pa.array([block], pa.int64()), **columns, "width": pa.array([row["width"]], pa.int32()), "slices": pa.array([row["slices"]], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)
            block += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size, block = [], [], 0, TaskContext.get().partitionId() << 33
        for batch in groups_of_rows(batches, "text"):
            ids.append(batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
            held.append(batch.column("text").cast(pa.large_string()))
            size += held[-1].nbytes
            if size >= BLOCK_BYTES:
                for out in rows(ids, held, block):
                    yield out
                    block += 1
                ids, held, size = [], [], 0
        if ids:
            yield from rows(ids, held, block)

    return only(docs, doc_id="long", text="string").mapInArrow(run, INDEX)


@dataclass
class Queries:
    """Some items: their ids and, one after the other, the terms of each."""

    ids: list[int | None]
    terms: pa.Array
    codes: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray | None = None
    documents: int = 0
    total: int = 0

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Queries:
        """Rows with one id are one item, whose terms are those of all its rows."""
        tokens, lengths = terms_of(pa.array([t for _, t in rows], pa.large_string()))
        encoded = tokens.dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = list(dict.fromkeys(i for i, _ in rows))
        number = {i: k for k, i in enumerate(ids)}
        n_terms = max(1, len(encoded.dictionary))
        pairs = np.unique(np.repeat(np.asarray([number[i] for i, _ in rows], np.int64), lengths) * n_terms + code)
        ends = np.cumsum(np.bincount(pairs // n_terms, minlength=len(ids)))
        return cls(ids, encoded.dictionary.cast(pa.string()), pairs % n_terms, ends, term_hashes(encoded.dictionary))

    def weigh(self, documents: int, total: int, holders: np.ndarray) -> None:
        self.documents, self.total = documents, total
        self.weights = np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holders], np.int64)


def _share(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


@dataclass
class Block:
    """A row of the index as arrays."""

    ids: np.ndarray
    lengths: np.ndarray
    terms: pa.Array
    ends: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    slices: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Block:
        values = lambda name: batch.column(name)[row].values
        number = lambda name: values(name).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = values("doc_ids").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        slices = np.frombuffer(batch.column("slices")[row].as_py(), np.uint8).reshape(batch.column("width")[row].as_py(), -1)
        return cls(ids, number("lengths"), values("terms"), number("ends"), number("codes"), number("counts"), slices)

    def bounds(self, q: Queries, first: int, last: int, m: np.ndarray, most: np.ndarray) -> np.ndarray:
        """(items, documents): upper bounds of the scores of items first to last."""
        begin, ends = (q.ends[first - 1] if first else 0), q.ends[first:last]
        terms, at = np.unique(q.codes[begin : ends[-1]], return_inverse=True)
        n, width = len(self.ids), len(self.slices)
        share = np.zeros((len(terms), n), np.int64)
        left = np.arange(len(terms))
        there = np.bitwise_and.reduce(self.slices[_slices_of(q.hashes[terms], 0, width)], axis=0)
        for kind in range(CLASSES):
            if kind:
                there &= np.bitwise_and.reduce(self.slices[_slices_of(q.hashes[terms[left]], kind, width)], axis=0)
            some = there.any(axis=1)
            left, there = left[some], there[some]
            if not len(left):
                break
            t, d = np.nonzero(np.unpackbits(there, axis=1, count=n))
            count = most[d] if kind == CLASSES - 1 else np.minimum(most[d], (2 << kind) - 1)
            share[left[t], d] = q.weights[terms[left[t]]] * _share(count, m[d])
        out = np.zeros((last - first, n), np.int64)
        starts = np.concatenate([[begin], ends[:-1]]) - begin
        full = ends - begin > starts
        if full.any():
            out[full] = np.add.reduceat(share[at], starts[full], axis=0)
        return out

    def scores(self, q: Queries, items: np.ndarray, docs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of item and document."""
        known = pc.index_in(q.terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n_terms = len(self.terms)
        entries = np.repeat(np.arange(len(self.ids)), np.diff(self.ends, prepend=0)) * n_terms + self.codes
        out = np.zeros(len(items), np.int64)
        begins = np.concatenate([[0], q.ends[:-1]])
        for a in range(0, len(items), 4096):
            i, d = items[a : a + 4096], docs[a : a + 4096]
            size = q.ends[i] - begins[i]
            pair = np.repeat(np.arange(len(i)), size)
            term = q.codes[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins[i], size)]
            held = known[term] >= 0
            pair, term = pair[held], term[held]
            wanted = d[pair] * n_terms + known[term]
            place = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
            hit = entries[place] == wanted
            pair, term, count = pair[hit], term[hit], self.counts[place[hit]]
            np.add.at(out, a + pair, q.weights[term] * _share(count, m[d[pair]]))
        return out


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.item, self.doc, self.score = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.reach = np.ones(items, np.int64)  # what a document's bound must reach to matter

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = (np.concatenate(x) for x in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        order = order[score[order] > 0]
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        full = rank == self.k - 1
        self.reach[item[full]] = score[full]


def _search_block(block: Block, q: Queries, best: Best) -> None:
    m = 10 + (90 * block.lengths * q.documents) // q.total
    most = np.maximum.reduceat(block.counts, np.concatenate([[0], block.ends[:-1]]))
    for first in range(0, len(q.ids), QUERY_GROUP):
        last = min(first + QUERY_GROUP, len(q.ids))
        if q.ends[last - 1] == (q.ends[first - 1] if first else 0):
            continue
        bound = block.bounds(q, first, last, m, most)
        reach = best.reach[first:last]
        few = bound.shape[1] > best.k
        if few and (reach == 1).any():  # no threshold yet: the best bounds first
            item = np.flatnonzero(reach == 1)
            doc = np.argpartition(-bound[item], best.k, axis=1)[:, : best.k]
            item = np.repeat(item, best.k)
            doc = doc.ravel()
            some = bound[item, doc] > 0
            item, doc = item[some], doc[some]
            best.add(first + item, block.ids[doc], block.scores(q, first + item, doc, m))
            bound[item, doc] = 0
        item, doc = np.nonzero(bound >= best.reach[first:last, None])
        if len(item):
            best.add(first + item, block.ids[doc], block.scores(q, first + item, doc, m))


def _statistics(index: DataFrame, q: Queries) -> None:
    """Sets the weights of q from all of the index: documents, terms, and documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(q.terms) + 2, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                codes = batch.column("codes")[row].values.to_numpy(zero_copy_only=False)
                known = pc.index_in(batch.column("terms")[row].values, value_set=q.terms).fill_null(-1).to_numpy(zero_copy_only=False)
                held = np.bincount(codes, minlength=len(known))
                np.add.at(found, known[known >= 0], held[known >= 0])
                lengths = batch.column("lengths")[row].values.to_numpy(zero_copy_only=False)
                found[-2:] += len(lengths), int(lengths.sum(dtype=np.int64))
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": pa.array(there, pa.int64()), "n": pa.array(found[there], pa.int64())})

    totals = np.zeros(len(q.terms) + 2, np.int64)
    for r in index.select("lengths", "terms", "codes").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # the queries' terms
        totals[r.term] = r.n
    q.weigh(int(totals[-2]), max(1, int(totals[-1])), totals[:-2])


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of an index for each of items (item_id, text).

    Equal scores go by doc_id, nulls first. Items without a term (null or empty text) and terms that no document has
    give no rows. Rows of one item_id are one item. Items go through in passes of QUERY_BYTES; each pass reads the index
    twice, once for counts. What leaves a task is k rows an item.
    """
    items = only(items, item_id="long", text="string")
    spark = items.sparkSession
    passes = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for number in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number).select("item_id", "text").collect()  # about QUERY_BYTES
        q = Queries.of([(r.item_id, r.text) for r in rows])
        if not len(q.codes):
            continue
        _statistics(index, q)

        def run(batches: Iterator[pa.RecordBatch], q: Queries = q) -> Iterator[pa.RecordBatch]:
            best = Best(len(q.ids), k)
            for batch in batches:
                for row in range(batch.num_rows):
                    _search_block(Block.of(batch, row), q, best)
            ids = pa.array(q.ids, pa.int64()).take(pa.array(best.item))
            docs = pa.array(best.doc, pa.int64(), mask=best.doc == NO_ID)
            yield pa.RecordBatch.from_pydict({"item_id": ids, "doc_id": docs, "score": pa.array(best.score, pa.int64())})

        found = found.unionByName(index.mapInArrow(run, "item_id long, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index of docs that is stored first."""
    return search(stored(build_index(docs), "index"), items, k)
