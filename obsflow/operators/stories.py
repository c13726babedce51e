"""Stories: what went wrong or took long in a trace, with everything a reader needs to see it.

A trace's spans and logs come together in one shuffle (`trace_trees.bundles`); each further part of a story is an
expression over that row. Attributes and events are boiled down to what stories need before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.functions.text import endpoint_name, operation_of, peer_of
from obsflow.operators import trace_trees as trees
from obsflow.operators.baselines import KEYS, Thresholds, slow_limit
from obsflow.operators.traces import SEVERITY_ERROR, story_fingerprint

MOST_LOGS, MOST_CONTRIBUTORS = 50, 3


def _ms(ns: Column) -> Column:
    return F.format_string("%.1f", ns.cast("double") / 1_000_000)


def _told_spans(spans: DataFrame, *more: str) -> DataFrame:
    """The columns of spans that stories read, and more."""
    exceptions = F.filter("events", lambda e: e["name"] == "exception")
    of = lambda key: F.get(F.filter(F.transform(exceptions, lambda e: e["attrs"][key]), lambda v: v.isNotNull()), F.lit(0))
    return spans.select(
        "trace_id", "span_id", "parent_span_id", "service", "name", "kind", "status", "status_message", "start_ns", "end_ns", (F.size(exceptions) > 0).alias("thrown"),
        of("exception.message").alias("exception_message"), of("exception.type").alias("exception_type"), endpoint_name(F.col("name"), F.col("attrs")).alias("endpoint"),
        peer_of(F.col("attrs")).alias("peer"), operation_of(F.col("name"), F.col("attrs")).alias("operation"), *more,
    )


def _told_logs(logs: DataFrame) -> DataFrame:
    text = F.col("severity_text") if "severity_text" in logs.columns else F.lit("")
    return logs.select("trace_id", "log_id", "ts_ns", "service", "span_id", F.col("severity_number").cast("int").alias("severity_number"), text.alias("severity_text"), "body")


def span_ref(s: Column) -> Column:
    return F.struct(*(s[c].alias(c) for c in ("span_id", "service", "name", "kind", "status", "start_ns")), (s["end_ns"] - s["start_ns"]).alias("duration_ns"))


def _with_normal(rows: DataFrame, baselines: DataFrame | None, ops: DataFrame | None, t: Thresholds) -> DataFrame:
    """rows with p99 and the operations (normal) of their endpoint's trusted baseline; nulls where there is none.

    Baselines, a row for each endpoint, go to every task, so that traces of one endpoint need not meet in one.
    """
    if baselines is None:
        return rows.withColumns({"p99": F.lit(None).cast("double"), "normal": F.lit(None).cast("array<struct<op:string,presence:double,p95:double>>")})
    trusted = baselines.where(F.col("traces") >= t.min_traces).select(*KEYS, F.col("p99").cast("double").alias("p99"))
    entry = F.struct("op", F.col("presence").cast("double").alias("presence"), F.col("p95").cast("double").alias("p95"))
    known = (trusted.select(*KEYS, F.lit(None).cast("string").alias("op"), F.lit(0.0).alias("presence"), F.lit(0.0).alias("p95")).limit(0) if ops is None else ops).groupBy(*KEYS).agg(F.collect_list(entry).alias("normal"))
    whole = trusted.join(known, KEYS, "left").withColumn("normal", F.coalesce("normal", F.array().cast("array<struct<op:string,presence:double,p95:double>>")))
    return rows.join(F.broadcast(whole), KEYS, "left")


def difference(durations: Column, normal: Column, t: Thresholds = Thresholds()) -> Column:
    """new_ops, missing_ops and slower_ops of a trace's longest durations against its endpoint's baseline (null: none)."""
    expected = lambda op: F.get(F.filter(normal, lambda b: (b["op"] == op) & (b["presence"] >= t.new_presence)), F.lit(0))
    judged = F.transform(durations, lambda d: F.struct(d["op"].alias("op"), d["ns"].alias("ns"), expected(d["op"]).alias("b")))
    late = lambda p95: F.greatest(p95 * t.op_factor, p95 + t.op_extra_ns)
    slower = F.filter(judged, lambda d: d["b"].isNotNull() & (d["ns"] > late(d["b"]["p95"])))
    gone = F.filter(normal, lambda b: (b["presence"] > t.missing_presence) & ~F.exists(durations, lambda d: d["op"] == b["op"]))
    return F.when(
        normal.isNotNull(),
        F.struct(
            F.transform(F.filter(judged, lambda d: d["b"].isNull()), lambda d: d["op"]).alias("new_ops"),
            F.array_sort(F.transform(gone, lambda b: b["op"])).alias("missing_ops"),
            F.transform(slower, lambda d: F.struct(d["op"].alias("op"), d["ns"].alias("duration_ns"), d["b"]["p95"].cast("long").alias("baseline_p95_ns"))).alias("slower_ops"),
        ),
    )


def told_traces(spans: DataFrame, logs: DataFrame, *more: str) -> DataFrame:
    """What stories_of reads: whole traces with tree and root; more: further columns of spans."""
    return trees.with_tree(trees.bundles(_told_spans(spans, *more), _told_logs(logs))).withColumn("root", F.get("spans", F.col("tree.root")))


def stories(
    spans: DataFrame, logs: DataFrame, baselines: DataFrame | None = None, ops: DataFrame | None = None, t: Thresholds = Thresholds(), window_flags: DataFrame | None = None
) -> DataFrame:
    """One row per failing trace, and per slow one of an endpoint with a trusted baseline.

    baselines: KEYS, traces, p99; ops: KEYS, op, presence, p95; window_flags: (trace_id, window_flags), what the
    assembler said when it closed the trace. A slow story blames the span with the most time on the critical path.
    """
    rows = told_traces(spans, logs)
    return stories_of(rows if window_flags is None else rows.join(window_flags, "trace_id", "left"), baselines, ops, t)


def stories_of(rows: DataFrame, baselines: DataFrame | None = None, ops: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """stories of told_traces, which may have window_flags."""
    failed = F.exists("spans", lambda s: (s["status"] == "error") | s["thrown"]) | F.exists("logs", lambda x: x["severity_number"] >= SEVERITY_ERROR)
    rows = rows.withColumns({
        "is_error": failed, "ts_ns": F.col("root.start_ns"), "duration_ns": F.col("root.end_ns") - F.col("root.start_ns"), "endpoint_service": F.col("root.service"), "endpoint_name": F.col("root.endpoint")
    })
    rows = rows.where("is_error") if baselines is None else rows
    rows = _with_normal(rows, baselines, ops, t)
    slow = F.col("duration_ns") > slow_limit(F.col("p99"), t)
    rows = rows.withColumn("kind", F.when(F.col("is_error"), "error").when(slow, "slow")).where("kind is not null")
    rows = trees.with_critical_path(trees.with_errors(rows, SEVERITY_ERROR))
    longest = F.get("critical.self_times", F.lit(0))
    rows = rows.withColumns({
        "place": F.when(F.col("kind") == "error", F.get("errors.leaves", F.lit(0))).otherwise(F.coalesce(longest["span"], F.col("tree.root"))),
        "most_ns": F.coalesce(longest["ns"], F.col("duration_ns")),
    })
    rows = trees.with_path(rows, F.col("place")).withColumns({"cause": F.get("spans", F.col("place")), "durations": trees.op_durations()})
    return _written(rows, t)


def _written(rows: DataFrame, t: Thresholds) -> DataFrame:
    """The columns of stories from rows with tree, errors, critical, cause, path and normal."""
    spans, cause, is_error = F.col("spans"), F.col("cause"), F.col("kind") == "error"
    here = lambda x: (x["span_id"] == cause["span_id"]) | ((F.col("place") == F.col("tree.root")) & ~F.array_contains("spans.span_id", x["span_id"]))
    said = F.filter("logs", lambda x: (x["severity_number"] >= SEVERITY_ERROR) & here(x))
    first_log = F.get(F.array_sort(F.transform(said, lambda x: F.struct(x["ts_ns"].alias("ts_ns"), x["log_id"].alias("log_id"), x["body"].alias("body")))), F.lit(0))["body"]
    message = F.coalesce(F.when(cause["status_message"] != "", cause["status_message"]), cause["exception_message"], first_log, F.lit("error"))
    rows = rows.withColumns({
        "cause_id": cause["span_id"], "cause_service": cause["service"], "cause_name": cause["name"], "message": F.when(is_error, message).otherwise("slow"),
        "exception_type": F.when(is_error, F.coalesce(cause["exception_type"], F.lit(""))).otherwise(""),
    })
    far = F.concat("cause_service", F.lit(" could not reach "), cause["peer"], F.lit(" ("), cause["operation"], F.lit("): "), "message")
    near = F.concat("cause_service", F.lit(" "), "cause_name", F.lit(" failed: "), "message")
    alone = (cause["kind"] == "client") & ~F.array_contains("tree.up", F.col("place"))
    took = F.concat("endpoint_service", F.lit(" "), "endpoint_name", F.lit(" took "), _ms(F.col("duration_ns")), F.lit(" ms (p99 "), _ms(F.col("p99").cast("long")), F.lit(" ms)"))
    where = F.concat(F.lit("; most time in "), "cause_service", F.lit(" "), "cause_name", F.lit(" ("), _ms(F.col("most_ns")), F.lit(" ms on the critical path)"))
    services = F.transform(trees.at(spans, F.col("path")), lambda s: s["service"])
    neighbours = F.filter(F.transform(services, lambda s, i: F.when((i == 0) | (s != F.get(services, i - 1)), s)), lambda s: s.isNotNull())
    order = F.transform("logs", lambda x: F.struct((-x["severity_number"]).alias("minus"), *(x[c].alias(c) for c in ("ts_ns", "service", "span_id", "body", "severity_text"))))
    kept = F.transform(F.slice(F.array_sort(order), 1, MOST_LOGS), lambda x: F.struct(x["ts_ns"], x["service"], x["span_id"], (-x["minus"]).alias("severity_number"), x["severity_text"], x["body"]))
    named = lambda x, *more: F.struct(*(F.get(spans, x["span"])[c].alias(c) for c in ("span_id", "service", "name")), *more)
    no_flags = F.array().cast("array<string>")
    window = F.coalesce("window_flags", no_flags) if "window_flags" in rows.columns else no_flags
    return rows.select(
        F.col("trace_id").alias("story_id"), "trace_id", "kind", "ts_ns", "duration_ns", *KEYS, "cause_id", "cause_service", "cause_name", span_ref(cause).alias("cause"), "message", "exception_type",
        F.when(is_error, F.when(alone, far).otherwise(near)).otherwise(F.concat(took, where)).alias("summary"),
        neighbours.alias("path_services"), F.transform(trees.at(spans, F.col("path")), span_ref).alias("path_spans"),
        F.transform("critical.segments", lambda x: named(x, x["start_ns"].alias("start_ns"), x["end_ns"].alias("end_ns"))).alias("critical_path"),
        F.transform(F.slice("critical.self_times", 1, MOST_CONTRIBUTORS), lambda x: named(x, x["ns"].alias("self_time_ns"))).alias("top_contributors"),
        difference(F.col("durations"), F.col("normal"), t).alias("baseline_diff"), kept.alias("logs"),
        F.transform(trees.at(spans, F.slice("errors.leaves", 2, F.greatest(F.size("errors.leaves") - 1, F.lit(0)))), span_ref).alias("also_failed"),
        F.size(spans).cast("long").alias("span_count"), F.concat(window, F.when(F.col("tree.incomplete"), F.array(F.lit("incomplete"))).otherwise(no_flags)).alias("flags"),
        story_fingerprint("kind", *KEYS, "cause_service", "cause_name", "message").alias("fingerprint"),
    )


def error_stories(spans: DataFrame, logs: DataFrame) -> DataFrame:
    return stories(spans, logs)


def slow_stories(spans: DataFrame, logs: DataFrame, baselines: DataFrame, ops: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    return stories(spans, logs, baselines, ops, t).where("kind = 'slow'")
