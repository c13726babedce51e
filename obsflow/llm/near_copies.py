"""Near copies by the Jaccard similarity of word shingles: every pair that is reported was compared exactly.

Candidates come from the pivot distance tables of simhash.py first: sets whose fingerprints are within two bits are
compared, and what is similar is one component before anything else is looked at. At a similarity of 0.8 two
fingerprints differ by about ten bits, which no cell of 64 bits can prune, so what the radius cannot hold comes from
min-hash bands. Two sets of similarity s agree in a band of ROWS minima with probability s**ROWS, so at 0.8 a pair
misses all BANDS bands in about seven of a million cases, and less above.

A band's cell is not expanded to pairs. Each member is compared with one leader, at first with the one that meets most
others; what similarity joins is one component from then on; and only members of different components of a cell are
compared with each other at the end, block by block inside a task, which gives back the similar pairs alone. No candidate
pair is left out, other than pairs that are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import discard, groups_of_rows, only, rows_of, stored
from obsflow.llm.components import components
from obsflow.llm.simhash import bits_in_most
from obsflow.llm.simhash import links as pivot_links

BANDS, ROWS = 30, 5
#: Rounds in which members of a cell are compared with one leader before the rest is compared with each other, the size
#: of cells that skip all but the first of them, and the shingles of a block of a cell.
LEADERS, CELL, BLOCK = 4, 24, 200_000

_random = np.random.default_rng(11)
_turn = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_times = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_mix = _random.integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, rising; a shorter text is one shingle, one without words none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(tokens[k:] for k in range(min(size, len(tokens)))), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set; an empty set has none."""
    if not len(found):
        return np.zeros(0, np.int32)
    short = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, ((short[at : at + 512, None] ^ _turn) * _times).min(0), out=least)
    return ((least.reshape(BANDS, ROWS) * _mix).sum(1, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets without repeats (two empty sets: 1)."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(found: int) -> int:
    return found - (1 << 64) if found >> 63 else found


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, the node (a hash of the shingle set), the set's size, its SimHash fingerprint and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "text"):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([_signed(xxhash.xxh64_intdigest(s.tobytes())) for s in sets], pa.int64())]
            columns += [pa.array([len(s) for s in sets], pa.int32()), pa.array([_signed(bits_in_most(s)) for s in sets], pa.int64())]
            columns += [pa.array([bands(s) for s in sets], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, node long, n int, fp long, bands array<int>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "text"):
            sets = [shingles(t, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "items"])

    return docs.mapInArrow(run, "node long, items binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with whether their similarity is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("items", "items_")]
            alike = [similarity(x, y) >= least for x, y in zip(*whole, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike, pa.bool_())], ["a", "b", "alike"])

    other = sets.select(F.col("node").alias("b"), F.col("items").alias("items_"))
    return pairs.join(sets.withColumnRenamed("node", "a"), "a").join(other, "b").select("a", "b", "items", "items_").mapInArrow(run, "a long, b long, alike boolean")


def pivot_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (node, n, node_, n_) that connect all nodes whose fingerprints a chain of steps within two bits connects, by the pivot tables.

    Nodes of one fingerprint meet the smallest of them. A set without shingles is one node, and its fingerprint zero is no sign of likeness.
    """
    own = nodes.where("n > 0").select("node", "n", "fp")
    first = own.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("nodes"))
    same = own.join(first.where("nodes > 1"), "fp").select("node", "n", F.col("first.node").alias("node_"), F.col("first.n").alias("n_")).where("node <> node_")
    of = lambda end, mark: first.select(F.col("fp").alias(end), F.col("first.node").alias(f"node{mark}"), F.col("first.n").alias(f"n{mark}"))
    near = pivot_links(first.select("fp")).join(of("a", ""), "a").join(of("b", "_"), "b")
    return same.unionByName(near.select("node", "n", "node_", "n_"))


def links(nodes: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) that connect exactly the nodes that a chain of candidate pairs of the similarity connects.

    nodes: node, n, fp, bands and the doc_id and text_hash of a row of docs (doc_id, text_hash, text) that has this set.
    """
    placed = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    keyed = placed.select("node", "n", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("key").cast("long") + F.lit(1 << 31)).alias("cell"))
    shared = keyed.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    in_cells = keyed.join(shared, "cell")
    # how many members a node meets: the text that others were copied from meets the most
    popular = in_cells.groupBy("node").agg(F.sum("members").alias("popular"))
    cells = stored(in_cells.join(popular, "node"), "cells")
    by_pivots = stored(pivot_pairs(nodes), "pairs")
    asked = cells.select("node").unionByName(by_pivots.select("node")).unionByName(by_pivots.select(F.col("node_").alias("node"))).distinct()
    wanted = nodes.select("node", "doc_id", "text_hash").join(asked, "node", "left_semi")
    sets = stored(_sets(docs.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text"), size), "sets")
    close = F.least("n", "n_") >= least * F.greatest("n", "n_") - 1e-6
    tested, made, roots = None, [cells, sets, by_pivots], None

    def rooted() -> DataFrame:
        if roots is None:
            return cells.withColumn("root", F.col("node"))
        return cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def settle(pairs: DataFrame) -> None:
        nonlocal tested, roots
        pairs = pairs.where(close).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        made.append(stored(_alike(pairs, sets, least), "alike"))
        tested = made[-1] if tested is None else tested.unionByName(made[-1])
        alike = made[-1].where("alike").select("a", "b")
        if not alike.isEmpty():  # what was joined before is linked to its roots already
            roots = components(alike if roots is None else alike.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    settle(by_pivots)
    for turn in range(LEADERS):
        members = rooted() if turn == 0 else rooted().where(F.col("members") > CELL)
        by = F.xxhash64("node", F.lit(turn)) if turn % 2 else -F.col("popular")
        first = F.min(F.struct(by.alias("by"), F.col("node").alias("node_"), F.col("n").alias("n_"), F.col("root").alias("root_")))
        leaders = members.groupBy("cell").agg(first.alias("first"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell", "first.*")
        leaders = stored(leaders, "leaders")
        made.append(leaders)
        if leaders.isEmpty():
            break
        # one leader for each member and round: the one that the most of its cells can have in common
        one = members.join(leaders, "cell").where("root <> root_").where(close).groupBy("node", "n").agg(F.min(F.struct("by", "node_", "n_")).alias("first"))
        settle(one.select("node", "n", "first.node_", "first.n_"))
    # what is still apart in a cell: the members outside its largest component, with all others
    parts = rooted().groupBy("cell", "root").agg(F.count("*").alias("k"))
    main = parts.groupBy("cell").agg(F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("cell", F.col("most.root").alias("main"))
    apart = rooted().join(main, "cell").select("cell", "node", "n", "root", "main")
    last = stored(_apart(apart, sets, least), "apart")
    made.append(last)
    out = stored(tested.where("alike").select("a", "b").unionByName(last), "near")
    discard(*made)
    return out


def _apart(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of similar members of a cell that are in different components, but for pairs within the main one.

    A cell is cut into blocks of about BLOCK shingles and each two blocks meet in one group, so a member is sent once for
    each block of its cell and pairs that are not similar are never rows.
    """
    blocks = members.groupBy("cell").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    own = members.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = dealt.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "main")

    def run(table: pa.Table) -> pa.Table:
        node, root, main, block, low, high = (table.column(c).to_numpy() for c in ("node", "root", "main", "block", "low", "high"))
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
        size = np.asarray([len(x) for x in items])
        _, group, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        order = np.argsort(group, kind="stable")
        owner, begin = np.repeat(np.arange(len(node)), size)[order], np.cumsum(times) - times
        ends = np.cumsum(size)
        pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(root != main).tolist():
            mine = group[ends[k] - size[k] : ends[k]]
            mine = mine[times[mine] > 1]
            n = times[mine]
            both = np.bincount(owner[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(node))
            alike = both >= least * (size[k] + size - both) - 1e-9
            alike &= (root != root[k]) & ((root == main) | (node > node[k])) & ((low == high) | (block != block[k]))
            pairs_a.append(np.minimum(node[k], node[alike]))
            pairs_b.append(np.maximum(node[k], node[alike]))
        return pa.table({"a": np.concatenate(pairs_a), "b": np.concatenate(pairs_b)})

    return keyed.join(sets, "node").groupBy("cell", "low", "high").applyInArrow(run, "a long, b long").distinct()


def one_of_each(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each component of near copies, with its columns: of the smallest doc_id, and of its texts the one with the smallest hash.

    Texts whose sets of lower-case word shingles have a Jaccard similarity of at least `least` are linked; texts
    without a word are equal to each other. Rows without a doc_id link nothing and stay. An empty table gives no rows;
    columns besides doc_id and text are not read.
    """
    named = docs.where("doc_id is not null")
    texts = only(named, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    found = stored(_signatures(texts, size), "signatures")
    nodes = stored(found.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "n", "fp", "bands")).alias("first")).select("node", "first.*"), "nodes")
    near = links(nodes, texts, size, least)
    classes = nodes.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = stored(classes.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*"), "kept")
    discard(found, nodes, near)
    return rows_of(docs, keep)
