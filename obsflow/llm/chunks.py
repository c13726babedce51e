"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; where five of its bits are zero a chunk ends, unless it would be shorter
than LEAST bytes, and a chunk of MOST bytes ends anyway. The bits depend on the last 21 bytes only, so an insertion
moves no boundary beyond the chunk it falls in. Chunks are deduplicated by a 128-bit digest, and runs of neighbouring
repeated chunks that are long enough are reported; a lone short chunk is no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsflow.llm.common import groups_of_rows, only, stored, text_bytes

LEAST, MOST = 16, 2048
MASK = np.uint32(0b11111 << 16)
WINDOW = 32
LAST = (1 << 63) - 1
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each text of the bytes, where its chunks end, as places in the text."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = ends - starts
    # a gap before each text keeps the one before it out of the window
    place = np.arange(len(data)) + WINDOW * (np.repeat(np.arange(len(ends)), lengths) + 1)
    gear = np.zeros(len(data) + WINDOW * len(ends), np.uint32)
    gear[place] = _GEAR[data]
    width = 1
    while width < WINDOW:
        later = gear.copy()
        later[width:] += gear[:-width] << np.uint32(width)
        gear, width = later, 2 * width
    cut = np.flatnonzero(gear[place] & MASK == 0) + 1
    bounds = np.searchsorted(cut, starts, side="right"), np.searchsorted(cut, ends, side="right")
    for start, n, a, b in zip(starts.tolist(), lengths.tolist(), *(x.tolist() for x in bounds), strict=True):
        out, last = [], 0
        for c in (*(cut[a:b] - start).tolist(), n):
            while c - last > MOST:
                last += MOST
                out.append(last)
            if c - last >= LEAST:
                out.append(c)
                last = c
        if last < n:
            out.append(n)
        yield np.asarray(out, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """(hi, lo, d, r, size, pos) for each chunk of each text of docs (d, r, text), a repeated one once with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "text", 2 << 20):
            data, ends = text_bytes(batch.column("text"))
            if not len(data):
                continue
            raw, base, digests, pos, size, counts = data.tobytes(), 0, [], [], [], []
            for end, cuts in zip(ends.tolist(), boundaries(data, ends), strict=True):
                begin = np.concatenate([[0], cuts[:-1]]) if len(cuts) else cuts
                digests += [xxhash.xxh3_128_digest(raw[base + a : base + b]) for a, b in zip(begin.tolist(), cuts.tolist(), strict=True)]
                pos.append(begin)
                size.append(cuts - begin)
                counts.append(len(cuts))
                base = end
            hi, lo = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
            of, places, sizes = np.repeat(np.arange(batch.num_rows), counts), np.concatenate(pos), np.concatenate(size)
            order = np.lexsort((places, lo, hi, of))
            hi, lo, of, places = hi[order], lo[order], of[order], places[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
            d, r = (batch.column(n).to_numpy(zero_copy_only=False)[of[first]] for n in ("d", "r"))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (hi[first], lo[first], d, r, sizes[order][first])), lists], ["hi", "lo", "d", "r", "size", "pos"])

    return docs.mapInArrow(run, "hi long, lo long, d long, r long, size long, pos array<long>")


def repeated_passages(docs: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(doc_id, start, end, n_chunks, first_doc_id): runs of at least least_bytes bytes whose chunks a smaller document has.

    first_doc_id is the smallest document among those that hold a chunk of the run first. The first document of a
    passage is not reported for it. Rows without a doc_id count as larger than all others and equal to each other, and
    are reported with null. Rows that share a doc_id do not repeat each other; their passages are told apart by text, and
    rows equal in both are reported once. Null and empty texts have no chunks; a very long text is cut whole in its
    task; an empty table gives no rows; columns besides doc_id and text are not read.
    """
    plain = only(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("r"), "text")
    all_chunks = stored(chunks(plain), "chunks")
    first = all_chunks.groupBy("hi", "lo").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("hi", "lo", "first")
    again = all_chunks.join(first, ["hi", "lo"]).where("d > first").select("d", "r", F.explode("pos").alias("pos"), "size", "first").distinct()
    in_doc = Window.partitionBy("d", "r").orderBy("pos", "size")
    fresh = F.coalesce(F.col("pos") > F.max(F.col("pos") + F.col("size")).over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = again.withColumn("run", F.sum(fresh.cast("long")).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("d", "r", "run").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("size")).alias("end"), F.count("*").alias("n_chunks"), F.min("first").alias("first_doc_id")
    )
    return spans.where(F.col("end") - F.col("start") >= least_bytes).select(
        F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "start", "end", "n_chunks", "first_doc_id"
    )
