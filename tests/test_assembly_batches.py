"""The assembler's exchange of bundles, and how often the analysis of a batch runs the assembly that it comes from."""

from test_assembly_calls import Clock, Handle

from obsflow.plans.registry_streams import replayed
from obsflow.sources.fixtures import logs, spans
from obsflow.streaming import assembly

DATA = "/root/testdata/sf0.001"


def test_bundles_hold_the_records_in_their_order(spark):
    rows = [(f"t{k % 7}" if k % 11 else None, "log" if k % 5 == 0 else "span", f"i{k}" if k % 3 else None, f"r{k}") for k in range(200)]
    found = assembly.bundled(spark.createDataFrame(rows, "trace_id string, kind string, id string, row string").coalesce(1)).collect()
    assert len(found) == 8
    for bundle in found:
        assert [(bundle.trace_id, *r) for r in zip(bundle.kinds, bundle.ids, bundle.rows, strict=True)] == [r for r in rows if r[0] == bundle.trace_id]


def test_a_call_to_state_holds_what_came_together():
    handle, made = Handle(), assembly._Bundled(100, 1000, 60, 5000)
    made.init(handle)
    bundle = {"kinds": ["span"] * 50, "ids": [f"s{k}" for k in range(50)], "rows": [str(k) for k in range(50)]}
    assert list(made.handleInputRows(("t",), iter([bundle, bundle]), Clock(0))) == []
    assert list(made.handleInputRows(("t",), iter([bundle, {"kinds": ["log"], "ids": ["s1"], "rows": ["l"]}]), Clock(40))) == []
    assert len(made._records.value) == 2  # a value for each call, none for a record
    (out,) = made.handleExpiredTimer(("t",), Clock(140), None)
    assert out.rows == [*map(str, range(50)), "l"] and out.kinds == ["span"] * 50 + ["log"] and out.closing == "closed"


def test_analysis_runs_the_assembly_of_a_batch_once(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    records = replayed(spark, DATA).dropDuplicates(["trace_id", "kind", "id"])
    n = records.count()
    batch = records.selectExpr("trace_id", "kind", "row", "'closed' AS closing").mapInArrow(run, "trace_id string, kind string, row string, closing string")
    assembly.analyze_batch(batch, 0, str(tmp_path), spans(spark, DATA).schema, logs(spark, DATA).schema)
    assert met.value == n
    assert spark.read.parquet(f"{tmp_path}/summaries").count() == spans(spark, DATA).select("trace_id").distinct().count()
