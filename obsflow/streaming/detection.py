"""Detection passes over what was mined so far, with a state table that moves only with stored alerts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.operators import alerts as D

STATE = "key string, value long, updated_at long, version long"


def _versions(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("version") < before)
    except AnalysisException:  # the first pass
        return spark.createDataFrame([], schema)


def stored_alerts(spark: SparkSession, path: str, before: int = 1 << 62) -> DataFrame:
    return _versions(spark, f"{path}/alerts", D.ALERT, before)


def stored_watermark(spark: SparkSession, path: str, partitions: DataFrame, now_ns: int, before: int = 1 << 62) -> int:
    """The smallest watermark that the assigned partitions (part) have reached; 0 before any pass."""
    keys = partitions.select(F.concat(F.lit("watermark/p"), F.col("part").cast("string")).alias("key"))
    writes = _versions(spark, f"{path}/state", STATE, before)
    if D.state_values(writes, "watermark").isEmpty():
        return 0
    return D.shared_watermark(writes, keys, "watermark", now_ns).first().watermark_ns


def run_pass(
    path: str, version: int, hits: DataFrame, templates: DataFrame, settings: DataFrame, partitions: DataFrame, now: int, epoch_ns: int = 0, r: D.Rules = D.Rules(), own_s: int = 3600
) -> int:
    """One pass under a version number: stores its alerts, then the watermark of each assigned partition, and returns it.

    The state read is that of earlier versions. Alerts are stored first: a pass that fails before its state is written
    is run again over the same range, and under its number it replaces what it wrote. The watermark stays where it is
    while no service is owned and records may remain.
    """
    spark, now_ns = hits.sparkSession, now * D.S
    watermark = stored_watermark(spark, path, partitions, now_ns, version)
    states = D.partition_states(partitions, now_ns, watermark)
    newest = D.data_now(hits, now, r).first().data_now_ns or 0
    clock = D.pass_clock(states, newest, now_ns).first()
    owned = D.owned_services(hits, now, own_s)
    found = D.detect_alerts(hits, templates, stored_alerts(spark, path, version), settings, now, watermark, epoch_ns, version, r, owned)
    found.drop("version").write.mode("overwrite").parquet(f"{path}/alerts/version={version}")
    moves = clock.behind == 0 or not owned.isEmpty()
    target = max(watermark, clock.clock_ns) if moves else watermark
    rows = partitions.select(F.concat(F.lit("watermark/p"), F.col("part").cast("string")).alias("key"), F.lit(target).cast("long").alias("value"), F.lit(now).cast("long").alias("updated_at"))
    rows.write.mode("overwrite").parquet(f"{path}/state/version={version}")
    return target
