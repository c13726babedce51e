"""Table maintenance: versions, replays, additive merges, retention, comparison of stores."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """One row per key: that with the highest version, then the highest ties. Aggregated, not sorted."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(version, *ties) if ties else F.col(version)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def keep_most_complete(df: DataFrame, key: str = "trace_id") -> DataFrame:
    return latest(df, [key], "span_count")


def sum_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("minute", "parent_service", "child_service").agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration_ns_sum").alias("duration_ns_sum")
    )


def minute_of(ts_ns: Column) -> Column:
    """The start of the minute in seconds."""
    return F.floor((ts_ns - ts_ns % 60_000_000_000) / 1_000_000_000).cast("long")


def template_minutes(hits: DataFrame) -> DataFrame:
    """Distinct (template, minute, log): a rollup that merges by union and counts replays once."""
    return hits.select("template_id", minute_of(F.col("ts_ns")).alias("minute"), "log_id").distinct()


def template_minute_sketches(hits: DataFrame, lg_k: int = 12) -> DataFrame:
    """(template_id, minute, logs): a distinct-count sketch of each minute's logs.

    Sketches merge without the log ids, and a replay adds nothing. The estimate of one of 2^lg_k registers has a relative
    standard error of about 1.04 / sqrt(2^lg_k): 1.6 % for 12; counts far under 2^lg_k / 8 are all but exact.
    """
    return hits.groupBy("template_id", minute_of(F.col("ts_ns")).alias("minute")).agg(F.hll_sketch_agg("log_id", lg_k).alias("logs"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of rollups (of replays, of other minutes) as one for each of keys."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("logs").alias("logs"))


def backfill_minutes(hits: DataFrame, rollup: DataFrame) -> DataFrame:
    """The rollup with the minutes of hits up to its earliest one, or of all hits if it is empty."""
    first = rollup.agg(F.min("minute").alias("first"))
    older = template_minutes(hits).join(F.broadcast(first), F.col("first").isNull() | (F.col("minute") <= F.col("first")))  # one row
    return rollup.select("template_id", "minute", "log_id").unionByName(older.drop("first")).distinct()


def apply_retention(df: DataFrame, ts_ns: str, days: int, now: int) -> DataFrame:
    """Rows that are not past their time to live at now (seconds)."""
    return df.where(F.col(ts_ns) >= (now - days * 86400) * 1_000_000_000)


def drop_expired(spark: SparkSession, path: str, ts_ns: str, days: int, now: int) -> None:
    """Retention of a table that write_raw made: day folders that lie wholly before the limit go, without being read.

    Only the day in which the limit falls is read; its living rows replace it. A run that is repeated, or ends between
    the steps, finds the table whole: the edge day is written beside the table first and then put in its place.
    """
    limit = now - days * 86400
    edge = spark.range(1).select(F.date_format(F.timestamp_seconds(F.lit(limit)), "yyyy-MM-dd")).first()[0]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {f.getPath().getName(): f.getPath() for f in files.listStatus(hadoop(path)) if f.isDirectory()}
    for name, folder in folders.items():
        if name.startswith("date=") and name < f"date={edge}":
            files.delete(folder, True)
    if f"date={edge}" in folders:
        day = spark.read.parquet(f"{path}/date={edge}").where(F.col(ts_ns) >= limit * 1_000_000_000)
        beside = f"{path}/_edge-{uuid.uuid4().hex}"
        day.write.parquet(beside)
        files.delete(folders[f"date={edge}"], True)
        files.rename(hadoop(beside), hadoop(f"{path}/date={edge}"))


def routing_key(df: DataFrame, by_service_only: bool = False) -> DataFrame:
    """df with key_kind and key: the trace id where it is valid, else the service."""
    valid = F.col("trace_id").rlike("^[0-9a-f]{32}$") & (F.col("trace_id") != "0" * 32) & F.lit(not by_service_only)
    return df.withColumn("key_kind", F.when(valid, "trace").otherwise("service")).withColumn("key", F.when(valid, F.col("trace_id")).otherwise(F.col("service")))


def drop_oversized(df: DataFrame, max_bytes: int = 900_000) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON fits, and a one-row count of the others."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.where(size <= max_bytes), df.where(size > max_bytes).agg(F.count("*").alias("dropped"))


def extract_traces(spans: DataFrame, only_errors: bool, service: str | None, max_traces: int) -> DataFrame:
    """Whole traces with an error and/or a span of the service; the smallest trace ids first."""
    ids = spans.select("trace_id").distinct()
    if only_errors:
        ids = ids.join(spans.where("status = 'error'").select("trace_id"), "trace_id", "left_semi")
    if service:
        ids = ids.join(spans.where(F.col("service") == service).select("trace_id"), "trace_id", "left_semi")
    return spans.join(ids.orderBy("trace_id").limit(max_traces), "trace_id", "left_semi")


def sample_traces(spans: DataFrame, n: int, now_ns: int, settle_s: int = 60) -> DataFrame:
    """The n settled trace ids with the smallest hashes. Each partition keeps its n smallest, so the sample is the same however spans are dealt."""
    settled = spans.where("trace_id <> ''").groupBy("trace_id").agg(F.max("start_ns").alias("last")).where(F.col("last") <= now_ns - settle_s * 1_000_000_000)
    return settled.select("trace_id").orderBy(F.md5("trace_id"), "trace_id").limit(n)


def verify_sample(a: DataFrame, b: DataFrame, n: int, now_ns: int, settle_s: int = 60) -> DataFrame:
    """Of a sample of n traces of a: those whose distinct span counts in b differ."""
    ids = sample_traces(a, n, now_ns, settle_s)
    return compare_span_counts(a.join(ids, "trace_id", "left_semi"), b.join(ids, "trace_id", "left_semi"), now_ns, settle_s)


def compare_span_counts(a: DataFrame, b: DataFrame, now_ns: int, settle_s: int = 60) -> DataFrame:
    """Traces settled in either store whose distinct span counts differ."""
    count = lambda df, n: df.groupBy("trace_id").agg(F.countDistinct("span_id").alias(n), F.max("start_ns").alias(f"{n}_last"))
    both = count(a, "left_spans").join(count(b, "right_spans"), "trace_id", "full_outer")
    settled = F.greatest(F.coalesce("left_spans_last", F.lit(0)), F.coalesce("right_spans_last", F.lit(0))) <= now_ns - settle_s * 1_000_000_000
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.where(settled).select("trace_id", zero("left_spans"), zero("right_spans")).where("left_spans <> right_spans")


def dedup_spans(spans: DataFrame, *order: str) -> DataFrame:
    """The first span of each id in a trace; spans without an id all stay. Ends never precede starts."""
    own = spans.where("span_id <> ''")
    keys = ["trace_id", "span_id"]
    rest = [c for c in spans.columns if c not in keys]
    first = own.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*spans.columns)
    return first.unionByName(spans.where("span_id = ''")).withColumn("end_ns", F.greatest("end_ns", "start_ns"))


def dedup_logs(logs: DataFrame) -> DataFrame:
    return logs.dropDuplicates(["trace_id", "ts_ns", "span_id", "body"])
