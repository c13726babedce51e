"""The analysis of a batch: one gathering of its traces, and the same errors as from spans joined with logs."""

from pyspark.sql import functions as F
from test_traces import LOG, MS, frame, span

from obsflow.operators import traces
from obsflow.operators.stories import told_traces
from obsflow.streaming import assembly


def case(spark):
    spans = frame(
        spark, span("t0", "", 0, 50, "a", trace="t"), span("t1", "t0", 1, 20, "b", trace="t"), span("t2", "t1", 2, 9, "c", "error", message="no", trace="t"), span("t3", "t9", 3, 9, "c", trace="t"),
        span("u0", "", 0, 50, "a", trace="u"), span("u1", "u0", 1, 20, "b", trace="u"), span("v0", "v1", 0, 50, "a", trace="v"), span("v1", "v0", 1, 20, "b", trace="v"), span("w0", "", 0, 9, "a", trace="w"),
    )
    logs = [("l1", 4 * MS, "b", 17, "t", "t1", "bad"), ("l2", 4 * MS, "b", 17, "t", "t1", "bad again"), ("l3", 4 * MS, "b", 9, "t", "t3", "fine"), ("l4", 4 * MS, "b", 21, "u", "gone", "bad"), ("l5", 4 * MS, "b", 17, "u", "", "bad")]
    logs += [("l6", 4 * MS, "b", 17, "v", "v1", "bad"), ("l7", 4 * MS, "b", 17, "v", None, "bad"), ("l8", 4 * MS, "b", 17, "none", "n0", "bad"), ("l9", 4 * MS, "b", 17, "", "", "bad")]
    return spans, spark.createDataFrame(logs, LOG)


def test_rows_of_traces_have_the_errors_of_joined_spans(spark):
    spans, logs = case(spark)
    rows = traces.with_error_flags(told_traces(spans, logs).withColumn("severe_at", traces.severe_places()))
    found = rows.select("trace_id", F.explode("spans").alias("s")).select("trace_id", "s.span_id", "s.is_error")
    want = traces.error_flags(spans, logs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("trace_id", "span_id", "is_error").collect()))
    told = lambda df: sorted(repr(r) for r in df.withColumn("op_durations", F.map_entries("op_durations")).collect())
    assert told(traces.summaries_of(rows)) == told(traces.trace_summaries(want))
    columns = ["minute", "parent_service", "child_service", "calls", "errors", "duration_ns_sum"]
    assert sorted(map(tuple, traces.edges_of(rows).select(columns).collect())) == sorted(map(tuple, traces.service_edges(want).select(columns).collect()))


def test_a_batch_is_gathered_once(spark, tmp_path, monkeypatch):
    cuts, cut = [], assembly.cut
    monkeypatch.setattr(assembly, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    spans, logs = case(spark)
    batch = assembly.records_of(spans, logs).withColumn("closing", F.when(F.col("trace_id") == "u", "truncated").otherwise("closed"))
    assembly.analyze_batch(batch, 0, str(tmp_path), spans.schema, logs.schema)
    assert len(cuts) == 2  # the batch and its traces; all tables come from the latter
    assert spark.read.parquet(f"{tmp_path}/summaries").count() == 4
    flags = {r.trace_id: r.flags for r in spark.read.parquet(f"{tmp_path}/stories").collect()}
    assert flags == {"t": ["incomplete"], "u": ["truncated"], "v": ["incomplete"]}
