"""The critical path: segments that tile the root's window, each named after the span that ran it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.operators import trace_trees as trees


def critical_path(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, start_ns, end_ns) segments; none is empty. One shuffle, however deep the traces are."""
    rows = trees.with_critical_path(trees.bundles(spans.select("trace_id", "span_id", "parent_span_id", "start_ns", "end_ns")))
    named = F.transform("critical.segments", lambda x: F.struct(F.get("spans", x["span"])["span_id"].alias("span_id"), x["start_ns"].alias("start_ns"), x["end_ns"].alias("end_ns")))
    return rows.select("trace_id", F.explode(named).alias("x")).select("trace_id", "x.*")


def critical_spans(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) on the path from the longest root where no story names one: from each span the child that ends
    last before the cursor, then those that end before that one started. A span without time of its own counts.

    One shuffle brings a trace together, however deep it is.
    """
    rows = trees.bundles(spans.select("trace_id", "span_id", "parent_span_id", "start_ns", "end_ns"))
    on_path = trees.critical_places()
    return rows.select("trace_id", F.explode(F.transform(on_path, lambda i: F.get("spans", i)["span_id"])).alias("span_id"))


def self_times(segments: DataFrame) -> DataFrame:
    """Time of each span on its trace's path, with its rank: the largest first, ties by span."""
    total = segments.groupBy("trace_id", "span_id").agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("self_time_ns"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("self_time_ns")).alias("t"), F.col("span_id").alias("id"))))
    ranked = total.groupBy("trace_id").agg(order.alias("all")).select("trace_id", F.posexplode("all").alias("rank", "x"))
    return ranked.select("trace_id", F.col("x.id").alias("span_id"), (-F.col("x.t")).alias("self_time_ns"), (F.col("rank") + 1).alias("rank"))


def top_contributors(segments: DataFrame, n: int = 3) -> DataFrame:
    return self_times(segments).where(F.col("rank") <= n)
