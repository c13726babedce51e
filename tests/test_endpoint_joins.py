"""What has a row for each endpoint meets traces in every task: dealt by endpoints they would stand in a few tasks."""

from pyspark.sql import functions as F

from obsflow.operators import baselines, stories

KEYS = "endpoint_service string, endpoint_name string"


def joins(df):
    return [line.strip() for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]


def test_traces_are_not_dealt_by_endpoint(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are large on paper
    try:
        summaries = spark.createDataFrame([(f"t{k}", "s", f"e{k % 2}", 100 + k, k, 1, False) for k in range(60)], f"trace_id string, {KEYS}, duration_ns long, ts_ns long, span_count long, is_error boolean")
        caps = spark.createDataFrame([("s", "e0", 120)], f"{KEYS}, cap long")
        base = spark.createDataFrame([("s", "e0", 50, 2.0)], f"{KEYS}, traces long, p99 double")
        kept = baselines.kept_summaries(summaries, summaries.where("trace_id = 't3'"), caps, 0, 100)
        rows = stories._with_normal(summaries, base, None, baselines.Thresholds())
        slow = baselines.slow_traces(summaries, base)
        by_endpoint = lambda df: [j for j in joins(df) if "endpoint_name" in j]
        assert len(by_endpoint(kept)) == 2 and all("broadcast" in j for j in by_endpoint(kept))
        assert any("strategy=broadcast" in j for j in by_endpoint(rows)) and all("strategy=broadcast" in j for j in by_endpoint(slow))
        assert kept.where("kept").count() == 11 + 29 and kept.agg(F.min("cap")).first()[0] == 120
        assert rows.where("p99 = 2").count() == 30 and slow.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
