"""Operators whose work must follow their input: what they compute against plain Python, and how their plans look."""

import random

import pyarrow as pa

from obsflow.operators import baselines, trace_trees, traces
from obsflow.plans import registry


def test_ancestors_take_one_shuffle_and_no_job_to_plan(spark):
    up = {("t", f"s{k}"): {f"s{k - 1}"} for k in range(1, 60)} | {("c", "a"): {"b"}, ("c", "b"): {"a"}, ("c", "x"): {"a"}, ("d", "m"): {"n", "o"}, ("d", "n"): {"o"}, ("d", "o"): {"p"}}
    links = spark.createDataFrame([(t, s, p) for (t, s), above in up.items() for p in above] + [("t", "s0", None)], "trace_id string, span_id string, parent_id string")
    spark.sparkContext.setJobGroup("ancestors", "")
    found = traces.ancestors(links, most_rows=7)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("ancestors")
    spark.sparkContext.setJobGroup("else", "")
    want = set()
    for t, s in up:
        met, level, n = {s}, {s}, 0
        while level := {p for x in level for p in up.get((t, x), ())} - met:
            n, met = n + 1, met | level
            want |= {(t, s, p, n) for p in level}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_differences_have_no_more_rows_than_traces(spark):
    had = {f"t{k}": {f"op{j}": 100_000_000 * (j % 5 + 1) for j in range(40) if (j * 7 + k) % 3} for k in range(30)} | {"none": {}}
    summaries = spark.createDataFrame([(t, "s", "e" if t != "t3" else "unknown", ops) for t, ops in had.items()], "trace_id string, endpoint_service string, endpoint_name string, op_durations map<string, long>")
    known = {f"op{j}": (j % 4 / 3, 90_000_000.0 * (j % 3)) for j in range(20, 50)}
    ops = spark.createDataFrame([("s", "e", op, *v) for op, v in known.items()] + [("s", "few", "op1", 1.0, 1.0)], "endpoint_service string, endpoint_name string, op string, presence double, p95 double")
    base = spark.createDataFrame([("s", "e", 50), ("s", "few", 49)], "endpoint_service string, endpoint_name string, traces long")
    found = baselines.baseline_diff(summaries, base, ops)
    want = {}
    for t, mine in had.items():
        new = sorted(op for op in mine if known.get(op, (0, 0))[0] < 0.01)
        slower = sorted(op for op, ns in mine.items() if op not in new and ns > max(known[op][1] * 2, known[op][1] + 50_000_000))
        want[t] = (new, sorted(op for op, (share, _) in known.items() if op not in mine and share > 0.95), slower)
    del want["t3"]
    assert {r.trace_id: (r.new_ops, r.missing_ops, r.slower_ops) for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_roots_and_longest_of_rows():
    draw = random.Random(3)
    for _ in range(3000):
        n = draw.randrange(1, 7)
        ids = [draw.choice(["", "a", "b", "c", "d", "e", f"x{k}", f"y{k}"]) for k in range(n)]
        parents, starts = [draw.choice([*ids, "", "gone"]) for _ in ids], [draw.randrange(3) for _ in ids]
        assert trace_trees.root_of(ids, parents, starts) == trace_trees.tree_of(ids, parents, starts).root
    ops = [[draw.choice(["s:a", "s:ä", "s:B", "t:z"]) for _ in range(draw.randrange(5))] for _ in range(50)]
    ns = [[draw.randrange(99) for _ in row] for row in ops]
    for low, high in ((0, 50), (7, 31), (9, 9)):
        found = trace_trees._longest(pa.array(ops, pa.list_(pa.string())).slice(low, high - low), pa.array(ns, pa.list_(pa.int64())).slice(low, high - low))
        want = [[{"op": op, "ns": max(v for o, v in zip(a, b, strict=True) if o == op)} for op in sorted(set(a), key=str.encode)] for a, b in zip(ops[low:high], ns[low:high], strict=True)]
        assert found.to_pylist() == want


def test_slow_traces_are_summarised_once(spark):
    plan = registry.QUERIES["A23_slow_traces"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "ArrowEvalPython" not in plan  # the summaries are a table by then
