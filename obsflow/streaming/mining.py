"""Log templates that evolve across micro-batches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obsflow.operators.mining import STATE, Config, assignments, mine, template_hits, tokenised


def state_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The rows that batches before this one have left."""
    try:
        return spark.read.schema(f"{STATE}, batch_id bigint").parquet(f"{path}/state").where(F.col("batch_id") < batch_id).drop("batch_id")
    except AnalysisException:  # the first batch
        return spark.createDataFrame([], STATE)


def mine_batch(batch: DataFrame, batch_id: int, path: str, config: Config = Config()) -> None:
    """Mines the logs of one batch on top of what earlier ones left: adds the changed rows to state and the batch's hits.

    Both are written under the batch's id, from the state of earlier ids only, so a batch that comes again replaces what
    it wrote. Lines are counted into distinct sequences before any Python sees them. A batch may be one file, which one
    task would read: its lines are dealt to all tasks before they are masked, and masked once for the state and the hits.
    """
    spark = batch.sparkSession
    lines = tokenised(batch.repartition("log_id", "ts_ns"), config).persist()
    try:
        mine(lines, config, state_before(spark, path, batch_id)).write.mode("overwrite").parquet(f"{path}/state/batch_id={batch_id}")
        added = spark.read.schema(STATE).parquet(f"{path}/state/batch_id={batch_id}")
        template_hits(lines, assignments(added), config).write.mode("overwrite").parquet(f"{path}/hits/batch_id={batch_id}")
    finally:
        lines.unpersist()


def mine_stream(logs: DataFrame, path: str, checkpoint: str, config: Config = Config(), **trigger: str | bool) -> StreamingQuery:
    """mine_batch on each micro-batch of streamed logs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        mine_batch(batch, batch_id, path, config)

    return logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
