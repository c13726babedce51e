"""Traces: parents, ancestors, root causes, summaries, edges, self times.

What needs a trace's shape works on rows that hold whole traces (`trace_trees`), after one shuffle by trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsflow.functions.text import endpoint_name, mask, operation_of, peer_of, short_hash
from obsflow.operators import trace_trees as trees

SEVERITY_ERROR = 17


def parents(spans: DataFrame) -> DataFrame:
    """spans with parent_id: the parent if the trace has it (null: a root), and missing: it names one that is not there."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("span_id").alias("parent_id")).distinct()
    out = spans.join(known, ["trace_id", "parent_span_id"], "left")
    there = F.when(F.col("parent_id") != F.col("span_id"), F.col("parent_id"))
    return out.select(*spans.columns, there.alias("parent_id"), (there.isNull() & (F.col("parent_span_id") != "")).alias("missing"))


def span_tree(spans: DataFrame) -> DataFrame:
    """One row per trace: root_id (the earliest parentless span, else the earliest one at which a cycle was cut), n_roots (parentless spans), n_spans, incomplete."""
    rows = trees.with_tree(trees.bundles(spans.select("trace_id", "span_id", "parent_span_id", "start_ns")))
    tops = F.size(F.filter("tree.up", lambda u: u < 0)) - F.size(F.filter("tree.cut", lambda c: c))
    root = F.get("spans", F.col("tree.root"))["span_id"].alias("root_id")
    return rows.select("trace_id", root, tops.cast("long").alias("n_roots"), F.size("spans").cast("long").alias("n_spans"), "tree.incomplete")


def ancestors(links: DataFrame, most_rows: int = 1 << 16) -> DataFrame:
    """(trace_id, span_id, ancestor_id, distance) for each span and each span above it; distance 1 is the parent.

    links: (trace_id, span_id, parent_id). One shuffle brings a trace's links together; each span climbs from there, and
    rows leave a task in batches of most_rows, so that all pairs of a deep trace never stand in memory. On a parent cycle
    the climb ends where a span was met before; no span is above itself. Of several ways up the shortest counts.
    """
    link = F.struct("span_id", "parent_id")
    rows = links.where("parent_id is not null and parent_id <> span_id").groupBy("trace_id").agg(F.collect_set(link).alias("links"))
    columns = ["trace_id", "span_id", "ancestor_id", "distance"]
    kinds = ", ".join(f"{c} {'int' if c == 'distance' else links.schema[c.replace('ancestor', 'parent')].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        batch = lambda: pa.RecordBatch.from_arrays([*(pa.array(c) for c in out[:3]), pa.array(out[3], pa.int32())], columns)
        for part in batches:
            for trace, found in zip(part.column("trace_id"), part.column("links"), strict=True):
                name, pairs = trace.as_py(), found.as_py()
                up: dict[str, list[str]] = {}
                for pair in pairs:
                    up.setdefault(pair["span_id"], []).append(pair["parent_id"])
                for span in up:
                    met, level, distance = {span}, [span], 0
                    while level := list(dict.fromkeys(p for s in level for p in up.get(s, ()) if p not in met)):
                        distance += 1
                        met.update(level)
                        for above in level:
                            for column, value in zip(out, (name, span, above, distance), strict=True):
                                column.append(value)
                        if len(out[0]) >= most_rows:
                            yield batch()
                            out = [[], [], [], []]
        if out[0]:
            yield batch()

    return rows.mapInArrow(run, kinds)


def cut_cycles(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, parent_id, cut): links without cycles.

    Of spans that reach no root, the earliest one (ties by id) climbs, and the first span that it meets twice loses its
    parent.
    """
    return trees.nested_intervals(spans).select("trace_id", "span_id", "parent_id", "cut")


def attach_logs(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Logs of traces with at_span: their span if the trace has it, else the root. Only traces that have logs are looked at."""
    said = logs.where("trace_id <> ''")
    asked = spans.select("trace_id", "span_id", "parent_span_id", "start_ns").join(said.select("trace_id").distinct(), "trace_id", "left_semi")
    roots = trees.with_root(trees.bundles(asked)).select("trace_id", F.get("spans", F.col("root"))["span_id"].alias("root_id"))
    own = asked.select("trace_id", "span_id", F.col("span_id").alias("own_id")).distinct()
    return said.join(roots, "trace_id").join(own, ["trace_id", "span_id"], "left").withColumn("at_span", F.coalesce("own_id", "root_id")).drop("own_id", "root_id")


def error_flags(spans: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """spans with is_error: by status, an exception event, or an attached log of severity error."""
    own = (F.col("status") == "error") | F.exists("events", lambda e: e["name"] == "exception")
    if logs is None:
        return spans.withColumn("is_error", own)
    bad = attach_logs(spans, logs.where(F.col("severity_number") >= SEVERITY_ERROR)).select("trace_id", F.col("at_span").alias("span_id")).distinct().withColumn("_log", F.lit(True))
    return spans.join(bad, ["trace_id", "span_id"], "left").withColumn("is_error", own | F.coalesce("_log", F.lit(False))).drop("_log")


def severe_places() -> Column:
    """Of a row of bundles with logs and root: the ids at which its logs of severity error stand, as attach_logs has it."""
    said = F.array_distinct(F.transform(F.filter("logs", lambda x: x["severity_number"] >= SEVERITY_ERROR), lambda x: x["span_id"]))
    elsewhere = F.size(F.array_except(said, F.col("spans.span_id"))) > 0
    return F.concat(F.array_intersect(said, F.col("spans.span_id")), F.when(elsewhere, F.array("root.span_id")).otherwise(F.array().cast("array<string>")))


def with_error_flags(rows: DataFrame) -> DataFrame:
    """error_flags of whole traces: rows (spans with thrown, and severe_at, see severe_places) whose spans and root have is_error."""

    def marked(s: Column) -> Column:
        return s.withField("is_error", (s["status"] == "error") | s["thrown"] | F.coalesce(F.array_contains("severe_at", s["span_id"]), F.lit(False)))

    return rows.withColumns({"spans": F.transform("spans", marked), "root": marked(F.col("root"))})


def root_causes(flagged: DataFrame) -> DataFrame:
    """Per failing trace the error span without errors below it that ended first, and also_failed: the others in the order they ended."""
    rows = trees.bundles(flagged.select("trace_id", "span_id", "parent_span_id", "start_ns", "end_ns", "is_error")).where(F.exists("spans", lambda s: s["is_error"]))
    leaves = F.transform(trees.at(F.col("spans"), trees.error_leaves(F.col("spans.is_error"))), lambda s: s["span_id"])
    found = rows.withColumn("leaves", leaves)
    return found.select("trace_id", F.get("leaves", F.lit(0)).alias("cause_id"), F.slice("leaves", 2, F.greatest(F.size("leaves") - 1, F.lit(0))).alias("also_failed"))


def error_messages(spans: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """spans with message and exception_type."""
    exceptions = F.filter("events", lambda e: e["name"] == "exception")
    of = lambda key: F.get(F.filter(F.transform(exceptions, lambda e: e["attrs"][key]), lambda v: v.isNotNull()), F.lit(0))
    out = spans
    first_log = F.lit(None).cast("string")
    if logs is not None:
        own = attach_logs(spans, logs.where(F.col("severity_number") >= SEVERITY_ERROR)).groupBy("trace_id", F.col("at_span").alias("span_id")).agg(
            F.min_by("body", F.struct("ts_ns", "log_id")).alias("_body")
        )
        out, first_log = out.join(own, ["trace_id", "span_id"], "left"), F.col("_body")
    message = F.coalesce(F.when(F.col("status_message") != "", F.col("status_message")), of("exception.message"), first_log, F.lit("error"))
    return out.withColumn("message", message).withColumn("exception_type", F.coalesce(of("exception.type"), F.lit(""))).drop("_body")


def explain(spans: DataFrame) -> DataFrame:
    """spans (with message and n_children) with summary."""
    far = F.concat("service", F.lit(" could not reach "), peer_of(F.col("attrs")), F.lit(" ("), operation_of(F.col("name"), F.col("attrs")), F.lit("): "), "message")
    near = F.concat("service", F.lit(" "), "name", F.lit(" failed: "), "message")
    return spans.withColumn("summary", F.when((F.col("kind") == "client") & (F.col("n_children") == 0), far).otherwise(near))


def with_children(spans: DataFrame) -> DataFrame:
    # a parent that the trace does not have meets no span
    counts = spans.where("parent_span_id <> span_id").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("n_children"))
    return spans.join(counts, ["trace_id", "span_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def _roots(flagged: DataFrame) -> DataFrame:
    own = flagged.select("trace_id", "span_id", "parent_span_id", "start_ns", "end_ns", "service", "name", "is_error")
    return trees.with_tree(trees.bundles(own)).withColumn("root", F.get("spans", F.col("tree.root")))


def trace_summaries(flagged: DataFrame) -> DataFrame:
    """Per trace: ts, endpoint, root duration, is_error, span_count, and the longest duration of each operation."""
    own = flagged.withColumn("endpoint", endpoint_name(F.col("name"), F.col("attrs"))).select("trace_id", "span_id", "parent_span_id", "start_ns", "end_ns", "service", "name", "is_error", "endpoint")
    return summaries_of(trees.with_root(trees.bundles(own)).withColumn("root", F.get("spans", F.col("root"))))


def summaries_of(rows: DataFrame) -> DataFrame:
    """trace_summaries of whole traces (trees.bundles) with root, the root span."""
    return rows.select(
        "trace_id", F.col("root.start_ns").alias("ts_ns"), F.col("root.service").alias("endpoint_service"), F.col("root.endpoint").alias("endpoint_name"),
        (F.col("root.end_ns") - F.col("root.start_ns")).alias("duration_ns"), F.map_from_entries(trees.op_durations()).alias("op_durations"),
        F.exists("spans", lambda s: s["is_error"]).alias("is_error"), F.size("spans").cast("long").alias("span_count"),
    )


def service_edges(flagged: DataFrame) -> DataFrame:
    """Calls between services by the minute their trace starts: calls, errors and time."""
    return edges_of(_roots(flagged))


def edges_of(rows: DataFrame) -> DataFrame:
    """service_edges of whole traces (trees.bundles) with tree and root, the root span."""

    def call(s, i):  # noqa: ANN001, ANN202
        above = F.get("spans", F.get("tree.up", i))["service"]
        return F.struct(above.alias("parent_service"), s["service"].alias("child_service"), s["is_error"].alias("is_error"), (s["end_ns"] - s["start_ns"]).alias("ns"))

    minute = ((F.col("root.start_ns") - F.col("root.start_ns") % 60_000_000_000) / 1_000_000_000).cast("long").alias("minute")
    crossing = F.filter(F.transform("spans", call), lambda c: c["parent_service"] != c["child_service"])
    calls = rows.select(minute, F.explode(crossing).alias("c")).select("minute", "c.*")
    return calls.groupBy("minute", "parent_service", "child_service").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.sum("ns").alias("duration_ns_sum"))


def span_self_ns(spans: DataFrame) -> DataFrame:
    """spans with self_ns: the duration without what direct children cover of it."""
    up = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("start_ns").alias("low"), F.col("end_ns").alias("high"))
    inside = parents(spans).join(up, ["trace_id", "parent_id"]).select("trace_id", "parent_id", F.greatest("start_ns", "low").alias("s"), F.least("end_ns", "high").alias("e")).where("e > s")
    before = Window.partitionBy("trace_id", "parent_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    covered = inside.withColumn("seen", F.max("e").over(before)).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(
        F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("seen", F.col("s"))))).alias("covered")
    )
    return spans.join(covered, ["trace_id", "span_id"], "left").withColumn("self_ns", F.col("end_ns") - F.col("start_ns") - F.coalesce("covered", F.lit(0))).drop("covered")


def story_fingerprint(kind: str, service: str, name: str, cause_service: str, cause_name: str, message: str):  # noqa: ANN201
    return short_hash(F.col(kind), F.col(service), F.col(name), F.col(cause_service), F.col(cause_name), mask(F.col(message)))
