"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets its Hamming distances to a base pivot and to the base pivot with some bits of one of
four bit groups turned over. By the triangle inequality, two fingerprints within the radius differ by no more than
the radius in any coordinate; and what a group's pivots say beyond the base depends on that group's bits alone, so
with a radius of two at least two of the four groups have equal relative coordinates. Pairs are therefore looked for
only where the relative coordinates of two groups agree, are discarded by their largest coordinate difference, and
the rest is verified. Nothing within the radius is lost.

A cell with many fingerprints (a large family of near copies) is not expanded to pairs: two fingerprints are within
two bits exactly if some value lies within one bit of both, so each names itself and its 64 one-bit neighbours, and
links to the smallest fingerprint that names the same value. That is linear in the cell and exact, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import groups_of_rows, only, rows_of, stored
from obsflow.llm.components import components

GROUPS, GROUP_BITS, PIVOTS = 4, 16, 12
#: Fingerprints of a cell that are still compared pair by pair.
CELL = 24


def bits_in_most(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    lane = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256]
        whole = np.zeros((-(-len(part) // 255), 255), np.uint64)
        whole.reshape(-1)[: len(part)] = part
        for shift in range(8):  # eight one-byte counters in a word; 255 hashes cannot overflow them
            counts = ((whole >> np.uint64(shift)) & lane).sum(1).view(np.uint8).reshape(-1, 8)
            ones[shift::8] += counts.sum(0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * int(ones[k]) > len(hashes)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return digest(b" ".join(tokens), 42)
    joined = map(b" ".join, zip(*(tokens[k:] for k in range(shingle)), strict=False))
    return bits_in_most(np.fromiter((digest(x, 42) for x in joined), np.uint64, len(tokens) - shingle + 1))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs' doc_id, a hash of its text and the signed 64-bit fingerprint, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "text"):
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def pivots(seed: int = 7) -> tuple[int, list[list[int]]]:
    """The base pivot, and for each bit group the pivots that differ from it in that group alone, as signed 64-bit numbers."""
    random = np.random.default_rng(seed)
    base = int(random.integers(0, 1 << 64, dtype=np.uint64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of_group = lambda g: [signed(base ^ (int(m) << (g * GROUP_BITS))) for m in random.integers(1, 1 << GROUP_BITS, PIVOTS)]
    return signed(base), [of_group(g) for g in range(GROUPS)]


def coordinates(fp: Column) -> list[Column]:
    """The pivot table's columns: the base distance, then an array for each group, relative to the base."""
    base, groups = pivots()
    far = lambda p: F.bit_count(fp.bitwiseXOR(F.lit(p).cast("long")))
    return [far(base).alias("c"), *(F.array(*(far(p) - far(base) for p in g)).alias(f"g{k}") for k, g in enumerate(groups))]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints of distinct (fp) that a chain of steps within the radius connects."""
    if radius != 2:
        raise ValueError("the cells and the large-cell path are made for a radius of two bits")
    coordinate_names = [f"g{k}" for k in range(GROUPS)]
    table = stored(distinct.select("fp", *coordinates(F.col("fp"))), "pivots")
    keys = [F.struct(F.lit(10 * i + j).alias("pair"), F.xxhash64(F.lit(10 * i + j), f"g{i}", f"g{j}").alias("cell")) for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    cells = table.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    sizes = cells.groupBy("pair", "cell").count().where("count > 1")
    sized = stored(cells.join(sizes, ["pair", "cell"]), "cells")
    few = sized.where(F.col("count") <= CELL).join(table, "fp")
    left, right = few.select("pair", "cell", "fp", "c", *coordinate_names), few.select("pair", "cell", *(F.col(x).alias(f"{x}_") for x in ("fp", "c", *coordinate_names)))
    # a pivot of group k has the coordinate c + gk[i]; every one of them may differ by the radius at most
    apart = [F.array_max(F.zip_with(g, f"{g}_", lambda x, y: F.abs(x - y + F.col("c") - F.col("c_")))) for g in coordinate_names]
    near = left.join(right, ["pair", "cell"]).where("fp < fp_").where(F.abs(F.col("c") - F.col("c_")) <= radius)
    for difference in apart:
        near = near.where(difference <= radius)
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_"))) <= radius).select(F.col("fp").alias("a"), F.col("fp_").alias("b"))
    many = sized.where(F.col("count") > CELL).select("fp").distinct()
    named = _named(many)
    first = named.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = named.join(first, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(star).distinct()


def _named(fps: DataFrame) -> DataFrame:
    """fp and each value that lies within one bit of it."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long") for k in range(64)))
    return fps.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("value"))


def degrees(linked: DataFrame) -> DataFrame:
    """fp and n_links, the number of other fingerprints within two bits, for each fingerprint of links (a, b).

    Two fingerprints one or two bits apart name exactly two common values, others none, and at most 65 name a value:
    the count needs no pairs. A fingerprint without links has no other within two bits, so links hold all that count.
    """
    named = _named(linked.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    sharers = named.groupBy("value").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return named.join(sharers, "value").groupBy("fp").agg(F.expr("sum(others) div 2").alias("n_links"))


def _marked(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    found = stored(fingerprints(only(docs, doc_id="long", text="string"), shingle), "fingerprints")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = stored(links(distinct.select("fp"), radius), "links")
    roots = components(linked)
    degree = degrees(linked)
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.join(named, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.join(stored(classes, "classes"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_links (distinct fingerprints within the radius) for each row of docs.

    A text without words has fingerprint zero and links like any other. Rows with a null doc_id get a component but
    never name one; a component of such rows alone is null. Equal texts share a fingerprint and so a component, as do
    repeated rows. Columns besides doc_id and text are not read; an empty table gives no rows.
    """
    marked = _marked(docs, shingle, radius)
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component with its columns: of the smallest doc_id, and of its texts the one with the smallest hash.

    Rows without a doc_id name no component and stay.
    """
    marked = _marked(docs, shingle, radius).where("doc_id is not null")
    keep = stored(marked.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*"), "kept")
    return rows_of(docs, keep)
