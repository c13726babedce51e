"""The path of critical spans takes one shuffle, and equals a plain walk on odd traces."""

import random

from obsflow.operators import critical_path, trace_trees


def walk(ids, parents, starts, ends):
    ends = [max(a, b) for a, b in zip(starts, ends, strict=True)]
    at = {s: k for k, s in enumerate(ids)}
    up = [at.get(p) if p != s else None for s, p in zip(ids, parents, strict=True)]
    tops = [k for k, u in enumerate(up) if u is None]
    if not tops:
        return set()
    out, todo = set(), [min(tops, key=lambda k: (starts[k] - ends[k], starts[k], ids[k]))]
    while todo:
        i = todo.pop()
        out.add(i)
        bound = ends[i] if up[i] is None else min(ends[i], ends[up[i]])
        for k in sorted((k for k, u in enumerate(up) if u == i), key=lambda k: (-ends[k], starts[k], ids[k])):
            if min(ends[k], ends[i]) <= bound:
                bound = starts[k]
                todo.append(k)
    return out


def test_places_equal_a_walk_and_take_no_join(spark):
    draw = random.Random(4)
    for _ in range(2000):
        n = draw.randrange(1, 9)
        ids = [f"s{k}" for k in range(n)]
        parents = [draw.choice(["", "gone", *ids]) for _ in ids]
        starts = [draw.randrange(20) for _ in ids]
        ends = [s + draw.randrange(-2, 20) for s in starts]
        found = trace_trees.critical_places_of(ids, parents, starts, ends)
        assert len(found) == len(set(found)) and set(found) == walk(ids, parents, starts, ends)
    deep = [("t", f"s{k}", f"s{k - 1}" if k else "", k, 10_000) for k in range(3000)] + [("loop", "a", "b", 0, 1), ("loop", "b", "a", 0, 1)]
    spans = spark.createDataFrame(deep, "trace_id string, span_id string, parent_span_id string, start_ns long, end_ns long")
    spark.sparkContext.setJobGroup("critical", "")
    df = critical_path.critical_spans(spans)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("critical")
    spark.sparkContext.setJobGroup("else", "")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.span_id for r in df.collect()} == {f"s{k}" for k in range(3000)}
