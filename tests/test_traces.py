"""Trace operators on hand-built traces."""

import random

from pyspark.sql import functions as F

from obsflow.operators import critical_path, stories, trace_trees, traces
from obsflow.operators.tables import dedup_spans, latest

SPAN = "trace_id string, span_id string, parent_span_id string, service string, name string, kind string, start_ns long, end_ns long, status string, status_message string, attrs map<string,string>, events array<struct<ts_ns:bigint,name:string,attrs:map<string,string>>>"
LOG = "log_id string, ts_ns long, service string, severity_number int, trace_id string, span_id string, body string"
MS = 1_000_000


def span(i, parent, start, end, service="a", status="ok", kind="internal", message="", name="op", events=(), trace="t"):
    return (trace, i, parent, service, name, kind, start * MS, end * MS, status, message, {}, list(events))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SPAN)


def no_logs(spark):
    return spark.createDataFrame([], LOG)


def test_failing_callee_is_the_cause(spark):
    spans = frame(spark, span("1", "", 0, 100, "web", "error", "server", "502", "GET /buy"), span("2", "1", 10, 90, "cart", "error", "client", "x"), span("3", "2", 20, 80, "pay", "error", "server", "card 1234 refused"))
    (story,) = stories.error_stories(spans, no_logs(spark)).collect()
    assert (story.cause_id, story.cause_service, story.path_services) == ("3", "pay", ["web", "cart", "pay"])
    assert story.summary == "pay op failed: card 1234 refused"
    assert story.also_failed == [] and story.flags == [] and story.baseline_diff is None
    assert sum(x.end_ns - x.start_ns for x in story.critical_path) == 100 * MS


def test_unreachable_callee(spark):
    spans = frame(spark, span("1", "", 0, 100, "web"), span("2", "1", 10, 90, "cart", "error", "client", "refused"))
    spans = spans.withColumn("attrs", F.create_map(F.lit("url.full"), F.lit("http://u@pay:8080/x")))
    (story,) = stories.error_stories(spans, no_logs(spark)).collect()
    assert story.summary == "cart could not reach pay (op): refused"


def test_first_error_to_end_wins_and_exceptions_count(spark):
    event = (5, "exception", {"exception.message": "boom", "exception.type": "E"})
    spans = frame(spark, span("1", "", 0, 100), span("2", "1", 10, 50, events=[event]), span("3", "1", 10, 40, status="error"))
    (row,) = traces.root_causes(traces.error_flags(spans)).collect()
    assert (row.cause_id, row.also_failed) == ("3", ["2"])
    told = {r.span_id: (r.message, r.exception_type) for r in traces.error_messages(spans).collect()}
    assert told["2"] == ("boom", "E") and told["3"] == ("error", "")


def test_logs_mark_spans_and_messages(spark):
    logs = spark.createDataFrame([("l1", 5, "a", 17, "t", "2", "bad thing"), ("l2", 6, "a", 17, "t", "gone", "lost")], LOG)
    spans = frame(spark, span("1", "", 0, 100), span("2", "1", 10, 50))
    assert {r.span_id for r in traces.error_flags(spans, logs).where("is_error").collect()} == {"1", "2"}
    assert {r.span_id: r.message for r in traces.error_messages(spans, logs).collect()} == {"1": "lost", "2": "bad thing"}


def test_missing_parent_and_two_roots_are_incomplete(spark):
    spans = frame(spark, span("1", "", 0, 100), span("2", "nowhere", 1, 2), span("9", "", 0, 1, trace="whole"))
    assert {r.trace_id: (r.root_id, r.incomplete) for r in traces.span_tree(spans).collect()} == {"t": ("1", True), "whole": ("9", False)}


def test_deep_chain(spark):
    n = 300
    spans = frame(spark, *(span(str(k), str(k - 1) if k else "", k, 1000 - k) for k in range(n)))
    above = traces.ancestors(traces.parents(spans).select("trace_id", "span_id", "parent_id"))
    assert above.count() == n * (n - 1) // 2
    assert above.where(f"span_id = '{n - 1}'").agg(F.max("distance")).first()[0] == n - 1


def test_cycles_are_cut_once(spark):
    spans = frame(spark, span("1", "3", 5, 9), span("2", "1", 6, 9), span("3", "2", 7, 9), span("4", "2", 7, 9))
    rows = {r.span_id: (r.parent_id, r.cut) for r in traces.cut_cycles(spans).collect()}
    assert rows == {"1": (None, True), "2": ("1", False), "3": ("2", False), "4": ("2", False)}


def climbed(spans):
    """The spans that lose their parent, found by climbing from one span after the other."""
    by_id = {s[1]: s for s in spans}
    up = {s[1]: s[2] for s in spans if s[2] in by_id and s[2] != s[1]}
    reached, lost = set(), set()

    def reach(top):
        todo = [top]
        while todo:
            i = todo.pop()
            if i not in reached:
                reached.add(i)
                todo += [c for c, p in up.items() if p == i]

    for s in spans:
        if s[1] not in up:
            reach(s[1])
    for s in sorted(spans, key=lambda s: (s[6], s[1])):
        if s[1] not in reached:
            met, i = set(), s[1]
            while i not in met:
                met.add(i)
                i = up[i]
            del up[i]
            lost.add(i)
            reach(i)
    return lost


def test_cycles_are_cut_where_a_climb_meets_them(spark):
    draw = random.Random(9)
    rows, want = [], set()
    for t in range(40):
        own = [span(f"{k:02}", f"{draw.randrange(16 if t % 2 else 12):02}", draw.randint(0, 6), 9, trace=f"t{t}") for k in range(12)]
        rows += own
        want |= {(f"t{t}", i) for i in climbed(own)}
    found = traces.cut_cycles(frame(spark, *rows))
    assert found.count() == len(rows)
    assert {(r.trace_id, r.span_id) for r in found.where("cut").collect()} == want and len(want) > 20
    assert traces.cut_cycles(frame(spark)).count() == 0


def marked(spans):
    """Spans of the path from the longest root, visited one by one."""
    by_id = {s[1]: s for s in spans}
    roots = [s for s in spans if s[2] not in by_id or s[2] == s[1]]
    if not roots:
        return set()
    top = min(roots, key=lambda s: (s[6] - s[7], s[6], s[1]))
    out, todo = set(), [(top, top[7])]
    while todo:
        s, bound = todo.pop()
        out.add(s[1])
        for c in sorted((c for c in spans if c[2] == s[1] and c[1] != s[1]), key=lambda c: (-c[7], c[6], c[1])):
            if min(c[7], s[7]) <= bound:
                todo.append((c, min(c[7], s[7])))
                bound = c[6]
    return out


def test_critical_spans_equal_a_walk(spark):
    draw = random.Random(5)
    rows, want = [], set()
    for t in range(30):
        own = []
        for k in range(20):
            parent = f"{draw.randrange(k):02}" if k and draw.random() < 0.9 else ""
            a = draw.randint(0, 40)
            own.append(span(f"{k:02}", parent, a, a + draw.randint(0, 40), trace=f"t{t}"))
        own += [span(f"x{k}", f"x{(k + 1) % 3}", 0, 9, trace=f"t{t}") for k in range(3)]
        rows += own
        want |= {(f"t{t}", i) for i in marked(own)}
    found = critical_path.critical_spans(frame(spark, *rows)).collect()
    assert len(found) == len(want) and {(r.trace_id, r.span_id) for r in found} == want


def walk(spans, root, skew):
    """The same path, one span after the other."""
    by_id = {s[1]: s for s in spans}
    children = {}
    for s in spans:
        if s[2] in by_id:
            children.setdefault(s[2], []).append(s)
    out, stack = [], [(root, by_id[root][6], by_id[root][7])]
    while stack:
        i, lo, hi = stack.pop()
        kids = [(min(c[7], hi), c[1], max(c[6], lo)) for c in children.get(i, []) if c[7] <= hi + skew and c[7] > lo and c[6] < hi]
        cursor = hi
        for e, k, s in sorted(kids, reverse=True):
            if e > cursor:
                if not (s < cursor and e - cursor <= skew):
                    continue
                e = cursor
            if cursor > e:
                out.append((i, e, cursor))
            stack.append((k, s, e))
            cursor = s
        if cursor > lo:
            out.append((i, lo, cursor))
    return sorted(out, key=lambda x: x[1])


def test_critical_path_tiles_the_root(spark):
    draw = random.Random(4)
    rows, want = [], {}
    for t in range(12):
        own = [span("00", "", 0, 1000, trace=f"t{t}")]
        for k in range(1, 20):
            p = own[draw.randrange(len(own))]
            a = draw.randint(p[6] // MS - 3, p[7] // MS)
            own.append(span(f"{k:02}", p[1], max(0, a), max(0, a) + draw.randint(0, max(1, p[7] // MS - a + 4)), trace=f"t{t}"))
        rows += own
        want[f"t{t}"] = walk(own, "00", trace_trees.SKEW_NS)
    found = critical_path.critical_path(frame(spark, *rows)).collect()
    for t, segments in want.items():
        got = sorted(((r.span_id, r.start_ns, r.end_ns) for r in found if r.trace_id == t), key=lambda x: x[1])
        assert got == segments
        assert got[0][1] == 0 and got[-1][2] == 1000 * MS and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


def test_self_time_merges_overlapping_children(spark):
    spans = frame(spark, span("1", "", 0, 100), span("2", "1", 10, 40), span("3", "1", 30, 60), span("4", "1", 90, 130))
    assert {r.span_id: r.self_ns // MS for r in traces.span_self_ns(spans).collect()} == {"1": 40, "2": 30, "3": 30, "4": 40}


def test_latest_and_dedup(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 1), ("b", 1, 2)], "k string, version int, x int")
    assert {r.k: r.x for r in latest(rows, ["k"], "version", "x").collect()} == {"a": 4, "b": 2}
    spans = frame(spark, span("1", "", 5, 3), span("1", "", 9, 10), span("", "", 1, 2), span("", "", 1, 2))
    once = dedup_spans(spans, "start_ns").collect()
    assert len(once) == 3 and all(r.end_ns >= r.start_ns for r in once)


def test_slow_story_blames_the_longest_part(spark):
    from obsflow.operators.stories import slow_stories

    spans = frame(spark, span("1", "", 0, 900, "web", name="GET /x"), span("2", "1", 100, 850, "db", name="query"), span("9", "", 0, 100, "web", name="GET /x", trace="quick"))
    baselines = spark.createDataFrame([("web", "GET /x", 60, 1e8, 1e8, 2e8)], "endpoint_service string, endpoint_name string, traces long, p50 double, p95 double, p99 double")
    (story,) = slow_stories(spans, no_logs(spark), baselines).collect()
    assert (story.trace_id, story.cause_id) == ("t", "2")
    assert story.summary == "web GET /x took 900.0 ms (p99 200.0 ms); most time in db query (750.0 ms on the critical path)"


def test_deep_chain_has_a_row_for_each_span(spark):
    n = 10_000
    rows = [(trace, f"s{k:05}", f"s{k - 1:05}" if k else "", k, 30_000 - k, "error" if k in (4000, 9000) else "ok") for trace in ("t", "u") for k in range(n)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start_ns long, end_ns long, status string")
    found = trace_trees.nested_intervals(spans)
    assert found.count() == 2 * n
    assert found.where("trace_id = 't' and span_id = 's04000'").select("parent_id", "depth", "first", "last", "cut").first() == ("s03999", 4000, 4000, n - 1, False)
    causes = traces.root_causes(spans.withColumn("is_error", F.col("status") == "error")).collect()
    assert {(r.trace_id, r.cause_id, tuple(r.also_failed)) for r in causes} == {("t", "s09000", ()), ("u", "s09000", ())}
    assert critical_path.critical_path(spans).groupBy("trace_id").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("ns")).collect()[0].ns == 30_000


def test_intervals_equal_climbing(spark):
    """Random links with missing parents, cycles and equal starts: intervals nest as the climbs do."""
    draw = random.Random(7)
    rows = []
    for t in range(60):
        ids = [f"{k:02}" for k in range(draw.randint(1, 12))]
        rows += [span(i, draw.choice([*ids, "", "gone"]), draw.randint(0, 3), draw.randint(4, 9), trace=f"t{t:02}") for i in ids]
    found = {(r.trace_id, r.span_id): r for r in trace_trees.nested_intervals(frame(spark, *rows)).collect()}
    assert len(found) == len(rows)
    for (trace, i), r in found.items():
        above, at = set(), r.parent_id
        while at is not None:
            above.add(at)
            at = found[trace, at].parent_id
        assert r.depth == len(above)
        assert {j for (t, j), x in found.items() if t == trace and x.first < r.first <= x.last} == above
    trees = {r.trace_id: r for r in traces.span_tree(frame(spark, *rows)).collect()}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        tops = [r for r in own if found[t, r[1]].parent_id is None]
        genuine = [r for r in tops if not found[t, r[1]].cut] or tops
        assert trees[t].root_id == min((r[6], r[1]) for r in genuine)[1]
    assert {k for k, r in found.items() if r.cut} == {(t, i) for t in {r[0] for r in rows} for i in climbed([r for r in rows if r[0] == t])}


def test_a_trace_that_is_one_cycle_has_a_story(spark):
    spans = frame(spark, span("1", "2", 0, 9, "web"), span("2", "1", 1, 5, "cart", "error", message="no"))
    (tree,) = traces.span_tree(spans).collect()
    assert (tree.root_id, tree.n_roots, tree.incomplete) == ("1", 0, True)
    (story,) = stories.error_stories(spans, no_logs(spark)).collect()
    assert (story.cause_id, story.path_services, story.flags) == ("2", ["web", "cart"], ["incomplete"])


def test_all_fields_of_an_error_story(spark):
    spans = frame(
        spark, span("a", "", 0, 100, "frontend", kind="server", name="POST /api/checkout"), span("b", "a", 10, 90, "checkout", "error", "client", "rpc error", "Charge"),
        span("c", "b", 20, 80, "payment", "error", "server", "Invalid token 1234", "Charge"), span("d", "b", 82, 86, "mail", "error", "server", "", "Send"), span("z", "gone", 5, 6, "ad", name="GetAds"),
    )
    logs = spark.createDataFrame([("l1", 25, "payment", 9, "t", "c", "charging card"), ("l2", 70, "payment", 17, "t", "c", "charge failed"), ("l0", 1, "x", 9, "t", "lost", "far away")], LOG)
    flags = spark.createDataFrame([("t", ["truncated"])], "trace_id string, window_flags array<string>")
    base = spark.createDataFrame([("frontend", "POST /api/checkout", 60, 5e8)], "endpoint_service string, endpoint_name string, traces long, p99 double")
    ops = spark.createDataFrame([("frontend", "POST /api/checkout", o, p, ms * 1e6) for o, p, ms in (("frontend:POST /api/checkout", 1.0, 20.0), ("checkout:Charge", 0.9, 20.0), ("payment:Charge", 0.005, 1.0), ("cart:Get", 0.99, 1.0), ("ad:GetAds", 0.5, 10.0))], "endpoint_service string, endpoint_name string, op string, presence double, p95 double")
    (s,) = stories.stories(spans, logs, base, ops, window_flags=flags).collect()
    assert (s.story_id, s.kind, s.ts_ns, s.duration_ns, s.endpoint_service, s.endpoint_name, s.span_count) == ("t", "error", 0, 100 * MS, "frontend", "POST /api/checkout", 5)
    assert tuple(s.cause) == ("c", "payment", "Charge", "server", "error", 20 * MS, 60 * MS)
    assert (s.message, s.exception_type, s.summary) == ("Invalid token 1234", "", "payment Charge failed: Invalid token 1234")
    assert s.path_services == ["frontend", "checkout", "payment"] and [x.span_id for x in s.path_spans] == ["a", "b", "c"]
    assert [(x.span_id, x.start_ns // MS, x.end_ns // MS) for x in s.critical_path] == [("a", 0, 10), ("b", 10, 20), ("c", 20, 80), ("b", 80, 82), ("d", 82, 86), ("b", 86, 90), ("a", 90, 100)]
    assert [(x.span_id, x.service, x.self_time_ns // MS) for x in s.top_contributors] == [("c", "payment", 60), ("a", "frontend", 20), ("b", "checkout", 16)]
    assert s.baseline_diff.new_ops == ["mail:Send", "payment:Charge"] and s.baseline_diff.missing_ops == ["cart:Get"]
    assert [tuple(x) for x in s.baseline_diff.slower_ops] == [("checkout:Charge", 80 * MS, 20 * MS), ("frontend:POST /api/checkout", 100 * MS, 20 * MS)]
    assert [(x.severity_number, x.body) for x in s.logs] == [(17, "charge failed"), (9, "far away"), (9, "charging card")]
    assert [x.span_id for x in s.also_failed] == ["d"] and s.flags == ["truncated", "incomplete"]
    (other,) = stories.stories(spans.withColumn("status_message", F.regexp_replace("status_message", "1234", "98765")), logs).collect()
    assert other.fingerprint == s.fingerprint and other.baseline_diff is None


def test_slow_story_has_a_path_and_logs_are_capped(spark):
    spans = frame(spark, span("r", "", 0, 1000, "frontend", name="GET /"), span("c", "r", 100, 900, "cart", name="GetCart"))
    logs = spark.createDataFrame([(f"l{k}", k, "a", 9, "t", "c", f"line {k}") for k in range(80)], LOG)
    base = spark.createDataFrame([("frontend", "GET /", 100, 1e8)], "endpoint_service string, endpoint_name string, traces long, p99 double")
    ops = spark.createDataFrame([("frontend", "GET /", "frontend:GET /", 1.0, 5e7)], "endpoint_service string, endpoint_name string, op string, presence double, p95 double")
    (s,) = stories.slow_stories(spans, logs, base, ops).collect()
    assert s.summary == "frontend GET / took 1000.0 ms (p99 100.0 ms); most time in cart GetCart (800.0 ms on the critical path)"
    assert (s.cause_service, s.message, s.path_services, len(s.logs)) == ("cart", "slow", ["frontend", "cart"], 50)
    assert s.baseline_diff.new_ops == ["cart:GetCart"] and s.baseline_diff.slower_ops[0].op == "frontend:GET /"


def test_stories_take_one_shuffle(spark):
    spans = frame(spark, span("1", "", 0, 100, "web"))
    plan = stories.stories(spans, no_logs(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(trace_id") == 1 and plan.count("Exchange") == 1
