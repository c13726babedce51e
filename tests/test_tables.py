"""Sources, retention, samples and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from obsflow.operators import baselines, tables
from obsflow.plans import read_queries as Q
from obsflow.sources import otlp

S = 1_000_000_000


def request(value):
    return '{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"1","attributes":[{"key":"x","value":' + value + "}]}]}]}]}"


def listed(*values):
    return '{"arrayValue":{"values":[' + ",".join(values) + "]}}"


def mapped(*pairs):
    return '{"kvlistValue":{"values":[' + ",".join(f'{{"key":"{k}","value":{v}}}' for k, v in pairs) + "]}}"


CASES = [
    (listed(listed('{"intValue":"1"}')), '["[\\"1\\"]"]'),
    (mapped(("a", '{"stringValue":"first"}'), ("b", '{"boolValue":false}'), ("a", '{"stringValue":"last"}')), '{"a":"last","b":"false"}'),
    (mapped(("z", '{"intValue":2}'), ("a", listed())), '{"a":"[]","z":"2"}'),
    (listed(mapped(("k", listed('{"doubleValue":0.5}', '{"bytesValue":"/w=="}'))), "{}"), '["{\\"k\\":\\"[\\\\\\"0.5\\\\\\",\\\\\\"ff\\\\\\"]\\"}",""]'),
    ('{"arrayValue":{}}', "[]"), ('{"kvlistValue":{}}', "{}"), ('{"stringValue":"é\\"\\n"}', 'é"\n'), (listed('{"stringValue":"é\\"\\n"}'), '["é\\"\\n"]'), ("{}", ""),
]


def test_nested_values(spark):
    frame = spark.createDataFrame([(k, request(v)) for k, (v, _) in enumerate(CASES)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value")
    assert [r.attrs["x"] for r in otlp.spans_of(frame).collect()] == [w for _, w in CASES]


def test_values_that_nest_too_deep_stop_the_job(spark):
    value = '{"intValue":"1"}'
    for _ in range(otlp.MOST_DEPTH + 1):
        value = listed(value)
    with pytest.raises(Exception, match="nests more than"):
        otlp.spans_of(spark.createDataFrame([(request(value),)], "value string")).collect()


def test_requests_round_trip(spark):
    rows = [("t1", f"{k:02}", "" if k % 3 == 0 else "00", f"s{k % 2}", "op", "server", k, k + 5, "ok", "", {"a": str(k)}) for k in range(6)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, service string, name string, kind string, start_ns long, end_ns long, status string, status_message string, attrs map<string,string>")
    lines = otlp.as_requests(spans)
    assert lines.count() == 1
    back = otlp.spans_of(lines).select(*spans.columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, spans.collect()))
    logs = spark.createDataFrame([(k, f"s{k % 2}", 9, "INFO", f"line {k}", "t1", "00") for k in range(5)], "ts_ns long, service string, severity_number int, severity_text string, body string, trace_id string, span_id string")
    told = otlp.logs_of(otlp.as_log_requests(logs))
    assert sorted(map(repr, told.where("ts_ns > 0").select(*logs.columns).collect())) == sorted(map(repr, logs.where("ts_ns > 0").collect()))


def test_retention_drops_days_and_cuts_the_edge(spark, tmp_path):
    path, now = str(tmp_path / "raw"), 20 * 86400
    rows = [(k * 43200 * S, "a", "") for k in range(40)]
    otlp.write_raw(spark.createDataFrame(rows, "ts_ns long, service string, trace_id string"), "ts_ns", path)
    read = lambda: sorted(r.ts_ns // S for r in spark.read.parquet(path).collect())
    for _ in range(2):  # once more changes nothing
        tables.drop_expired(spark, path, "ts_ns", 3, now + 3600)
        assert read() == [k * 43200 for k in range(40) if k * 43200 >= 17 * 86400 + 3600]
    assert len([p for p in (tmp_path / "raw").iterdir() if p.name.startswith("date=")]) == 3


def test_sample_does_not_depend_on_the_partitions(spark):
    rows = [(f"t{k % 50}", f"s{k}", k * S) for k in range(200)]
    frame = spark.createDataFrame(rows, "trace_id string, span_id string, start_ns long")
    found = [sorted(r.trace_id for r in tables.sample_traces(frame.repartition(n), 7, 10**12).collect()) for n in (1, 3, 17)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 7
    other = frame.where(F.col("span_id") != "s3")
    differing = {r.trace_id for r in tables.verify_sample(frame, other, 50, 10**12).collect()}
    assert differing == {"t3"}


def test_count_sketches_merge_replays(spark):
    rows = [(f"l{k}", f"t{k % 3}", k * 1000 * S % (600 * S)) for k in range(9000)]
    hits = spark.createDataFrame(rows, "log_id string, template_id string, ts_ns long")
    once, again = tables.template_minute_sketches(hits), tables.template_minute_sketches(hits.where("log_id like '%1%'"))
    found = {r.template_id: r.n for r in tables.merged_sketches(once.unionByName(again), "template_id").select("template_id", F.hll_sketch_estimate("logs").alias("n")).collect()}
    alone = {r.template_id: r.n for r in tables.merged_sketches(once, "template_id").select("template_id", F.hll_sketch_estimate("logs").alias("n")).collect()}
    assert found == alone
    assert all(abs(n - 3000) <= 3000 * 3 * 0.0163 for n in found.values())


def test_quantile_sketches_are_within_their_rank_error(spark):
    draw = random.Random(1)
    rows = [("s", f"e{k % 2}", draw.randrange(40) * baselines.HOUR_NS, int(draw.lognormvariate(10, 2)), k % 9 != 0, {"op": k}) for k in range(30_000)]
    kept = spark.createDataFrame(rows, "endpoint_service string, endpoint_name string, ts_ns long, duration_ns long, kept boolean, op_durations map<string,long>")
    sketches = baselines.endpoint_sketches(kept)
    assert sketches.count() == 80
    for r in baselines.merged_endpoint_stats(sketches, 0, 20 * baselines.HOUR_NS).collect():
        own = sorted(x[3] for x in rows if x[1] == r.endpoint_name and x[4] and x[2] < 20 * baselines.HOUR_NS)
        assert (r.kept, r.seen) == (len(own), sum(x[1] == r.endpoint_name and x[2] < 20 * baselines.HOUR_NS for x in rows))
        for value, q in ((r.p50, 0.5), (r.p95, 0.95), (r.p99, 0.99)):
            rank = sum(x <= value for x in own) / len(own)
            assert abs(rank - q) <= 2 * baselines.RANK_ERROR
    few = baselines.merged_endpoint_stats(baselines.endpoint_sketches(kept.limit(30).withColumn("endpoint_name", F.lit("e"))), 0, 1 << 62).first()
    exact = sorted(r.duration_ns for r in kept.limit(30).where("kept").collect())
    assert few.p50 in (exact[(len(exact) - 1) // 2], exact[len(exact) // 2])
    (op, *_) = baselines.merged_op_stats(baselines.op_sketches(kept), 0, 1 << 62).orderBy("endpoint_name").collect()
    assert op.present == sum(x[4] and x[1] == "e0" for x in rows)


def test_service_sketches_equal_exact_ones_on_few_calls(spark):
    rows = [(f"s{k % 3}", "server" if k % 4 else "client", k * 7 * S, 1000 + k, "error" if k % 10 == 1 else "ok") for k in range(200)]
    spans = spark.createDataFrame(rows, "service string, kind string, start_ns long, duration_ns long, status string")
    w = Q.Range(0, 1200)
    exact = {r.service: r for r in Q.service_nodes(spans, w).collect()}
    for r in Q.sketched_nodes(Q.service_sketches(spans), w).collect():
        assert (r.calls, r.errors, r.health) == (exact[r.service].calls, exact[r.service].errors, exact[r.service].health)
        assert abs(r.p99 - exact[r.service].p99) <= 15
    buckets = {r.bucket: r for r in Q.service_red(spans, "s1", w).collect()}
    assert {r.bucket: (r.calls, r.errors) for r in Q.sketched_red(Q.service_sketches(spans), "s1", w).collect()} == {b: (r.calls, r.errors) for b, r in buckets.items()}


def test_times_and_windows():
    now = 1_700_000_000
    assert Q.parse_time("15m", now) == now - 900 and Q.parse_time("7d", now) == now - 604800 and Q.parse_time("1699999999", now) == 1_699_999_999
    assert Q.parse_time("2023-11-14T22:13:20Z", now) == now and Q.parse_time("2023-11-14T22:13:20", now) == now
    assert Q.Range.parse({}, now) == Q.Range(now - 3600, now, True)
    assert Q.Range.parse({"since": "30d", "until": "1d"}, now) == Q.Range(now - 604800, now - 86400)
    for bad in ({"since": "soon"}, {"since": "5m", "until": "10m"}):
        with pytest.raises(ValueError):
            Q.Range.parse(bad, now)
    with pytest.raises(ValueError):
        Q.histogram_quantile(None, 1.5)


def test_labels_in_any_order_are_one_series(spark):
    rows = [(0, "m", {"a": "1", "b": "2", "instance": "i"}, 5.0), (60_000, "m", {"instance": "i", "b": "2", "a": "1", "c": ""}, 8.0), (60_000, "m", {"a": "1"}, 1.0), (0, "m", None, 2.0)]
    series = Q.labelled(spark.createDataFrame(rows, "ts_ms long, metric string, labels map<string,string>, value double"))
    rates = Q.counter_rate(Q.metric_buckets(series, "m", 0, 10**6, 60, Q.LABELLED), ["a", "b"], 60, Q.LABELLED).collect()
    assert [(r.a, r.b, r.bucket, r.rate) for r in rates] == [("1", "2", 60, 0.05)]
