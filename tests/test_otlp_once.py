"""Requests are parsed once and grouped with one shuffle; service names of every kind."""

from pyspark.sql import functions as F

from obsflow.sources import otlp


def test_a_request_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"resourceSpans":[]}',)], "value string")
    plan = otlp.spans_of(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(resourceSpans") == 1


def test_requests_take_one_shuffle(spark):
    kinds = "trace_id string, span_id string, parent_span_id string, service string, name string, kind string, start_ns long, end_ns long, status string, status_message string, attrs map<string,string>"
    rows = [(t, f"{t}{k}", "", f"s{k % 2}", "n", "server", 1, 2, "ok", "", {"a": "b"}) for t in "xyz" for k in range(4)]
    made = otlp.as_requests(spark.createDataFrame(rows, kinds))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert made.count() == 3
    back = otlp.spans_of(made).select("trace_id", "span_id", "service", F.col("attrs")["a"].alias("a"))
    assert sorted(map(tuple, back.collect())) == sorted((r[0], r[1], r[3], "b") for r in rows)


def test_service_names(spark):
    given = {'{"stringValue":"a"}': "a", '{"stringValue":""}': "unknown_service", '{"intValue":"7"}': "7", '{"arrayValue":{"values":[{"stringValue":"x"}]}}': '["x"]', "{}": "unknown_service", "null": "unknown_service"}
    line = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":%s}]},"scopeSpans":[{"spans":[{"spanId":"1"}]}]}]}'
    for value, name in given.items():
        assert [r.service for r in otlp.spans_of(spark.createDataFrame([(line % value,)], "value string")).collect()] == [name], value
