"""Only traces with logs are looked at for the places of logs; children are counted without a join of spans with themselves."""

from obsflow.operators import traces


def test_places_and_children(spark):
    kinds = "trace_id string, span_id string, parent_span_id string, start_ns long"
    spans = spark.createDataFrame([("t", "a", "", 1), ("t", "b", "a", 2), ("t", "c", "a", 3), ("t", "d", "gone", 0), ("t", "e", "e", 9), ("u", "a", "", 1), ("v", "x", "y", 2), ("v", "y", "x", 3)], kinds)
    logs = spark.createDataFrame([("t", "b", 1), ("t", "zz", 2), ("", "a", 3), ("w", "a", 4), ("v", "", 5)], "trace_id string, span_id string, n long")
    placed = traces.attach_logs(spans, logs)
    assert {(r.trace_id, r.n, r.at_span) for r in placed.collect()} == {("t", 1, "b"), ("t", 2, "d"), ("v", 5, "x")}
    assert "LeftSemi" in placed._jdf.queryExecution().optimizedPlan().toString()
    counted = traces.with_children(spans)
    assert {(r.trace_id, r.span_id): r.n_children for r in counted.collect()} == {("t", "a"): 2, ("t", "b"): 0, ("t", "c"): 0, ("t", "d"): 0, ("t", "e"): 0, ("u", "a"): 0, ("v", "x"): 1, ("v", "y"): 1}
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
