"""Live operators: assembly, analysis, raw copies and detection passes, with replays and repeated batches."""

import time

from pyspark.sql import functions as F

from obsflow.operators import alerts as D
from obsflow.operators import traces
from obsflow.streaming import assembly, detection
from test_traces import LOG, MS, frame, span

S = 1_000_000_000


def spans_of(*traces_):
    return [span(f"{t}{k}", f"{t}0" if k else "", k, 50 - k, service=f"s{k % 2}", trace=t) for t, n in traces_ for k in range(n)]


class Fed:
    """A stream over files that are added while it runs."""

    def __init__(self, spark, tmp_path, **limits):
        self.spark, self.at, self.n = spark, str(tmp_path), 0
        spans, logs = frame(spark), spark.createDataFrame([], LOG)
        self.schema = assembly.records_of(spans, logs).schema
        spark.createDataFrame([], self.schema).write.parquet(f"{self.at}/in")
        self.out = assembly.assemble_traces(spark.readStream.schema(self.schema).parquet(f"{self.at}/in"), **limits)

    def start(self):
        self.query = self.out.writeStream.format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/state").start()
        return self

    def add(self, spans, logs=()):
        made = assembly.records_of(frame(self.spark, *spans), self.spark.createDataFrame(list(logs), LOG))
        made.coalesce(1).write.mode("append").parquet(f"{self.at}/in")

    def wait(self, wanted, seconds=60):
        """What has come out for each trace, once it is what is wanted."""
        until = time.time() + seconds
        while True:
            rows = self.spark.read.schema(self.out.schema).parquet(f"{self.at}/out").groupBy("trace_id", "kind", "closing").count().collect()
            found = {(r.trace_id, r.kind, r.closing): r["count"] for r in rows}
            if wanted.items() <= found.items() or time.time() > until:
                return found
            time.sleep(0.5)


def test_traces_close_by_gap_age_and_count(spark, tmp_path):
    fed = Fed(spark, tmp_path, gap_ms=6000, max_age_ms=9000, max_spans=3).start()
    try:
        logs = [("l1", 5, "a", 9, "gap", "gap0", "x"), ("l2", 5, "a", 9, "gap", "gap0", "x"), ("l3", 6, "a", 9, "", "", "no trace")]
        fed.add([*spans_of(("gap", 2), ("many", 4), ("same", 3)), *spans_of(("same", 3)), span("", "", 1, 2, trace="same")][:-1], logs)
        # four spans are more than three; three that come twice are not
        found = fed.wait({("many", "span", "truncated"): 4})
        assert found == {("many", "span", "truncated"): 4}
        fed.add([*spans_of(("many", 6))[4:], *spans_of(("same", 3)), *spans_of(("age", 1))])
        assert fed.wait({("many", "span", "late"): 2})[("many", "span", "late")] == 2
        found = fed.wait({("gap", "span", "closed"): 2, ("same", "span", "closed"): 3, ("age", "span", "closed"): 1})
        assert found[("gap", "span", "closed")] == 2 and found[("gap", "log", "closed")] == 1  # of logs that are the same, one
        assert found[("same", "span", "closed")] == 3 and found[("age", "span", "closed")] == 1
        began = time.time()
        for k in range(40):  # never quiet for the gap
            fed.add([span(f"busy{k % 3}", "", 0, 1, trace="busy")])
            if fed.wait({("busy", "span", "closed"): 1}, 0.1).get(("busy", "span", "closed")):
                break
            time.sleep(1)
        assert 5 < time.time() - began < 60
        assert fed.wait({("busy", "span", "closed"): 3}).get(("busy", "span", "closed")) in (1, 2, 3)
    finally:
        fed.query.stop()


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    spans = frame(spark, *spans_of(("t", 4), ("u", 3)), span("u9", "u0", 3, 9, "s1", "error", message="no", trace="u"))
    logs = spark.createDataFrame([("l1", 4 * MS, "s1", 17, "t", "t1", "bad")], LOG)
    records = assembly.records_of(spans, logs)
    out = [records.where("trace_id = 't'").withColumn("closing", F.lit("truncated")), records.where("trace_id = 'u'").withColumn("closing", F.lit("closed"))]
    out[1] = out[1].unionByName(records.where("trace_id = 't'").withColumn("closing", F.lit("late")))
    tables = lambda: {n: sorted(map(repr, spark.read.parquet(f"{tmp_path}/{n}").drop("batch_id").collect())) for n in ("summaries", "stories", "edges")}
    for k, batch in enumerate(out):
        assembly.analyze_batch(batch, k, str(tmp_path), spans.schema, logs.schema)
    once = tables()
    for k, batch in enumerate(out):
        assembly.analyze_batch(batch, k, str(tmp_path), spans.schema, logs.schema)
    assert tables() == once
    flagged = traces.error_flags(spans, logs)
    edges = spark.read.parquet(f"{tmp_path}/edges").groupBy("parent_service", "child_service").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    want = traces.service_edges(flagged).select("parent_service", "child_service", "calls", "errors")
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, want.collect()))
    flags = {r.trace_id: (r.cause_id, r.flags) for r in spark.read.parquet(f"{tmp_path}/stories").collect()}
    assert flags == {"t": ("t1", ["truncated"]), "u": ("u9", [])}


def test_raw_batches_replace_themselves(spark, tmp_path):
    rows = frame(spark, *spans_of(("t", 4)))
    for _ in range(2):
        assembly.write_batch(rows, f"{tmp_path}/raw", 0)
    assembly.write_batch(rows.limit(1), f"{tmp_path}/raw", 1)
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 5


HIT = "log_id string, template_id string, service string, ts_ns long, severity_number int, trace_id string, span_id string"
TEMPLATE = "template_id string, service string, first_seen long, last_seen long, lines long, max_severity int, template string"
PART = "part int, position long, high long, next_offset long, last_record_ns long, max_ns long"


def test_passes_over_split_data_equal_one(spark, tmp_path):
    """Templates that are new are told once, whether their range is passed in one go or in three, one of which fails half way."""
    base = 1_700_000_000
    templates = [(f"t{k}", "a", (base + 60 * k) * S, (base + 60 * k) * S, 1, 9, f"line {k}") for k in range(60)] + [("o", "other", base * S, base * S, 1, 9, "x")]
    hits = [(f"l{k}", f"t{k}", "a", (base + 60 * k) * S, 9, f"tr{k}", "") for k in range(60)]
    templates, hits = spark.createDataFrame(templates, TEMPLATE), spark.createDataFrame(hits, HIT)
    settings = spark.createDataFrame([], "template_id string, enabled boolean, minutes int")
    none = spark.createDataFrame([], "service string")

    def go(path, version, upto):
        seen = base + 60 * upto
        parts = spark.createDataFrame([(0, 0, 9, 9, seen * S, seen * S), (1, 0, 0, None, None, None)], PART)
        own = hits.where(F.col("ts_ns") <= seen * S)
        return detection.run_pass(path, version, own, templates.where(F.col("first_seen") <= seen * S), settings, parts, seen + 1)

    one, three = str(tmp_path / "one"), str(tmp_path / "three")
    go(one, 0, 59)
    marks = [go(three, 0, 20), go(three, 1, 40), go(three, 2, 59)]
    assert marks == [(base + 60 * k) * S for k in (20, 40, 59)]
    go(three, 2, 59)  # again under its number
    told = lambda path: sorted(tuple(r) for r in detection.stored_alerts(spark, path).select("alert_id", "template_id", "started_at", F.array_join("example_trace_ids", ",")).collect())
    assert told(one) == told(three) and {r[1] for r in told(one)} == {f"t{k}" for k in range(15, 60)}
    assert D.scoped(hits, none).isEmpty()


def test_alerts_carry_peak_baseline_comparators_and_examples(spark):
    now = 1_700_000_000 - 1_700_000_000 % 60
    rows = [(f"c{k}", "t", "a", (now - 100 + k) * S, 17, f"tr{k % 7}", "") for k in range(60)]  # now
    rows += [(f"b{k}", "t", "a", (now - 400 - 60 * (k % 58)) * S, 17, "", "") for k in range(58)]  # the hour before
    rows += [(f"d{k}", "t", "a", (now - 86400 - 100 - k) * S, 17, "", "") for k in range(3)]  # a day before
    rows += [(f"o{k}", "x", "b", (now - 50) * S, 17, "", "") for k in range(99)]
    first = (now - 9 * 86400) * S
    templates = spark.createDataFrame([("t", "a", first, now * S, 9, 17, "boom"), ("x", "b", first, now * S, 9, 17, "else")], TEMPLATE)
    known = spark.createDataFrame([("old", "spike", "t", "a", "boom", now - 300, now - 60, 50, 77, 1.0, [], 1, None, None)], D.ALERT)
    settings = spark.createDataFrame([], "template_id string, enabled boolean, minutes int")
    owned = spark.createDataFrame([("a",)], "service string")
    (row,) = D.detect_alerts(spark.createDataFrame(rows, HIT), templates, known, settings, now, first, 0, 5, services=owned).collect()
    assert (row.alert_id, row.kind, row.started_at, row.last_at, row.window_count, row.peak_count, row.version) == ("old", "spike", now - 300, now, 60, 77, 5)
    assert 4 < row.baseline_per_window < 6 and (row.baseline_day, row.baseline_week) == (3.0, None)
    assert row.example_trace_ids == ["tr3", "tr2", "tr1", "tr0", "tr6"]


def test_state_is_dropped_by_age(spark):
    writes = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, 5)], "key string, value long, updated_at long")
    assert [(r.key, r.value) for r in D.drop_state(writes, 10).collect()] == [("a", 2)]
