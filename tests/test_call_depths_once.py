"""The depths of services compute their edges once, whatever they come from."""

from obsflow.plans import dashboards


def test_edges_are_computed_once(spark):
    met = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    kinds = "parent_service string, child_service string"
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "x"), ("y", "z"), ("z", "y")], kinds).mapInArrow(run, kinds)
    found = {r.service: r.depth for r in dashboards.call_depths(edges).collect()}
    assert found == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 0, "z": 1}
    assert met.value == 6
