"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import discard, stored

_LINKS = "a long, b long, moved boolean"


def _star(a: np.ndarray, b: np.ndarray, moved: np.ndarray, last: tuple[int, int, int] | None = None) -> tuple[pa.RecordBatch, tuple[int, int, int]]:
    """Of links in the order (a, b, not moved): a is linked to its smallest b, and so are its other ones; repeats go.

    last: a, b and a's smallest b of the link before these; returned for the link after them.
    """
    before_a, before_b = np.concatenate([a[:1] if last is None else [last[0]], a[:-1]]), np.concatenate([b[:1] if last is None else [last[1]], b[:-1]])
    new = a != before_a
    new[0] |= last is None
    start = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
    least = np.where(start < 0, b[0] if last is None else last[2], b[start])
    keep = new | (b != before_b)
    columns = [pa.array(np.where(new, a, b)[keep]), pa.array(least[keep]), pa.array(np.where(new, moved, True)[keep])]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "moved"]), (int(a[-1]), int(b[-1]), int(least[-1]))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("moved").to_numpy(zero_copy_only=False)


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours are linked to the smallest of them. Each batch does so for itself before the
    shuffle, so a node with very many of them comes to its task with one row for each batch."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, moved in map(_columns, batches):
            if len(a):
                order = np.lexsort((~moved, b, a))
                yield _star(a[order], b[order], moved[order])[0]

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for a, b, moved in map(_columns, batches):
            if len(a):
                found, last = _star(a, b, moved, last)
                yield found

    return links.mapInArrow(near, _LINKS).repartition("a").sortWithinPartitions("a", "b", F.desc("moved")).mapInArrow(far, _LINKS)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node reachable.

    Alternates the large-star and the small-star step until no link changes: a link from a larger to a smaller node goes
    to the smallest neighbour of that smaller node, then each node's smaller neighbours are linked to the smallest of
    them. A node's neighbours are never gathered: the large step is an aggregate that is joined back, so a node with very
    many links is spread by the join, the small one passes over sorted rows. Links know whether they moved, so that the
    end is seen without a further shuffle. The number of rounds grows with the logarithm of the longest path. Links of a
    node to itself and null ends are left out.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    before = None
    for _ in range(most_rounds):
        least = pairs.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = pairs.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        after = stored(_small_star(large), "links")
        if before is not None:
            discard(before)
        pairs, before = after.select("a", "b"), after
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    leaves = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
