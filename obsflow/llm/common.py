"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Spark can drop an execution's shuffle files when it ends; used only around a write whose plan is not read again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, as in tests, is one made where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="obsflow-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextlib.contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that stored() makes inside go when the block ends; results must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(*_scratch.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_end_with_the_write(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scratch:
        _scratch[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() made and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, in the types the operators work with; other columns cannot clash then."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def rows_of(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text_hash) is in keep, one of each, and all rows without a doc_id; their columns may have any names."""
    own = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    found = own.join(keep.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")), ["i", "h"], "left_semi").dropDuplicates(["i", "h"])
    return found.select("row.*").unionByName(docs.where("doc_id is null"))


def words(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after the other, and where each row ends (null: empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]] if len(ends) else raw[:0], (ends[1:] - ends[0]) if len(ends) else np.zeros(0, np.int64)


def groups_of_rows(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold about most_bytes of a column, so that long texts do not add up in memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
