"""Lines of services beyond the cluster limit pass in order; none are gathered."""

from obsflow.operators import mining


def test_lines_are_not_gathered(spark):
    texts = ["alpha one", "beta two", "gamma three", "delta four", "alpha five", "delta four", "beta two"]
    logs = spark.createDataFrame([(f"{k}", k, "s", 9, "", "", t) for k, t in enumerate(texts)], "log_id string, ts_ns long, service string, severity_number int, trace_id string, span_id string, body string")
    found = mining.mine(logs, mining.Config(max_clusters=2))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    hits = mining.template_hits(logs, mining.assignments(found), mining.Config(max_clusters=2)).collect()
    names = {r.log_id: r.template_id for r in hits}
    assert len(names) == len(texts) and names["1"] == names["6"] and names["2"] == names["3"] == names["5"] and len(set(names.values())) == 3
