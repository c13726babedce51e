"""Dashboard computations: dense series, deltas, maps, depths, waterfalls, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsflow.operators.tables import latest
from obsflow.operators import trace_trees as trees
from obsflow.plans.read_queries import Range, bucket, stories
from obsflow.sources.checkpoint import cut


def dense_series(sparse: DataFrame, w: Range, most: int = 240) -> DataFrame:
    """Every bucket of the window, zero where there was none; the newest of too many."""
    step = w.bucket_s()
    first, last = w.start - w.start % step, w.end - 1 - (w.end - 1) % step
    first = max(first, last - (most - 1) * step)
    grid = sparse.sparkSession.range(first, last + 1, step).withColumnRenamed("id", "bucket")  # at most `most` rows
    return grid.join(sparse, "bucket", "left").na.fill(0)


def window_delta(rows: DataFrame, w: Range, ts_ns: str = "ts_ns") -> DataFrame:
    length, s = w.end - w.start, 1_000_000_000
    both = rows.where((F.col(ts_ns) >= (w.start - length) * s) & (F.col(ts_ns) < w.end * s))
    return both.agg(F.count_if(F.col(ts_ns) >= w.start * s).alias("current"), F.count_if(F.col(ts_ns) < w.start * s).alias("previous")).withColumn("delta", F.col("current") - F.col("previous"))


def alert_activity(alerts: DataFrame, w: Range) -> DataFrame:
    """Alerts open in each bucket."""
    step = w.bucket_s()
    own = latest(alerts, ["alert_id"], "version").where((F.col("started_at") < w.end) & (F.col("last_at") >= w.start))
    slot = lambda c: c - c % step
    slots = F.sequence(slot(F.greatest("started_at", F.lit(w.start))), slot(F.least("last_at", F.lit(w.end - 1))), F.lit(step).cast("long"))
    return own.select(F.explode(slots).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("open"))


def active_alert_counts(alerts: DataFrame, now: int) -> DataFrame:
    own = latest(alerts, ["alert_id"], "version").where((F.col("last_at") >= now - 600) & (F.col("started_at") <= now))
    return own.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("new", "spike", "silence")))


def alerts_timeline(alerts: DataFrame, w: Range) -> DataFrame:
    """Alerts by bucket and kind; a silence stands where it was last seen, at the end of the window at most."""
    own = latest(alerts, ["alert_id"], "version").where((F.col("started_at") < w.end) & (F.col("last_at") >= w.start))
    at = F.when(F.col("kind") == "silence", F.least("last_at", F.lit(w.end - 1))).otherwise(F.greatest("started_at", F.lit(w.start)))
    step = w.bucket_s()
    counts = own.withColumn("at", at).groupBy((F.col("at") - F.col("at") % step).alias("bucket")).pivot("kind", ["new", "spike", "silence"]).count()
    return counts.na.fill(0)


def hide_infra(edges: DataFrame, infra: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges without the named services, and for each caller which of them it calls."""
    hidden = F.col("child_service").isin(infra) | F.col("parent_service").isin(infra)
    badges = edges.where(F.col("child_service").isin(infra) & ~F.col("parent_service").isin(infra))
    return edges.where(~hidden), badges.groupBy("parent_service").agg(F.array_join(F.array_sort(F.collect_set("child_service")), ",").alias("calls_infra"))


def neighbours(edges: DataFrame, service: str) -> DataFrame:
    callers = edges.where(F.col("child_service") == service).select(F.lit("caller").alias("side"), F.col("parent_service").alias("service"), "calls")
    return callers.unionByName(edges.where(F.col("parent_service") == service).select(F.lit("callee").alias("side"), F.col("child_service").alias("service"), "calls"))


def map_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): every service seen, and distinct calls between two."""
    links = edges.where("parent_service <> child_service").select("parent_service", "child_service").distinct()
    return edges.select(F.col("parent_service").alias("service")).union(edges.select("child_service")).distinct(), links


def call_depths(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Hops from the services that nothing calls; of what they do not reach, the alphabetically first starts again."""
    nodes, links = map_graph(cut(edges.select("parent_service", "child_service").distinct()))  # edges are computed once
    depths = cut(nodes.join(links.select(F.col("child_service").alias("service")), "service", "left_anti").withColumn("depth", F.lit(0)))
    level = depths
    for _ in range(most_rounds):
        level = level.withColumnRenamed("service", "parent_service").join(links, "parent_service").groupBy(F.col("child_service").alias("service")).agg(F.min(F.col("depth") + 1).alias("depth"))
        level = cut(level.join(depths.select("service"), "service", "left_anti"))
        if level.isEmpty():
            rest = nodes.join(depths, "service", "left_anti")
            level = cut(rest.agg(F.min("service").alias("service")).where("service is not null").withColumn("depth", F.lit(0)))
            if level.isEmpty():
                return depths
        depths = cut(depths.unionByName(level))
    raise RuntimeError(f"services are more than {most_rounds} steps from those that nothing calls")


def edge_tones(edges: DataFrame) -> DataFrame:
    return edges.withColumn("tone", F.when(F.col("errors") * 100 >= F.col("calls"), "failing").otherwise("ok"))


def map_summary(edges: DataFrame) -> DataFrame:
    return edge_tones(edges).agg(F.count("*").alias("n_edges"), F.count_if(F.col("tone") == "failing").alias("failing"), F.sum("calls").alias("calls"))


def job_status(up: DataFrame, now: int, stale_s: int = 180) -> DataFrame:
    """up: (job, bucket, value). The newest bucket decides; an old one means down."""
    newest = up.groupBy("job").agg(F.max_by("value", "bucket").alias("value"), F.max("bucket").alias("bucket"))
    return newest.select("job", F.when((F.col("value") >= 1) & (F.col("bucket") >= now - stale_s), "up").otherwise("down").alias("state"))


def trace_rows(found: DataFrame, low_ns: int, high_ns: int, start_ns: int, end_ns: int, *order: str) -> DataFrame:
    """Found traces (with story_kind) in a brushed rectangle with their tone, sorted by several keys (a minus sign: descending), ties newest first, then by id."""
    own = found.where(F.col("duration_ns").between(low_ns, high_ns) & F.col("ts_ns").between(start_ns, end_ns))
    tone = F.when(F.col("is_error") | F.coalesce(F.col("story_kind") == "error", F.lit(False)), "err").when(F.col("story_kind") == "slow", "slow").otherwise("accent")
    return own.withColumn("tone", tone).orderBy(*(F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order), F.desc("ts_ns"), "trace_id")


def waterfall(spans: DataFrame) -> DataFrame:
    """Depth-first rows of each trace: row, depth, parent row, children, the end of the subtree, offset and width as shares of the trace."""
    rows = trees.with_tree(trees.bundles(spans.select("trace_id", "span_id", "parent_span_id", "start_ns", "end_ns")))
    rows = rows.withColumns({"low": F.array_min("spans.start_ns"), "high": F.array_max("spans.end_ns")})
    length = F.greatest(F.col("high") - F.col("low"), F.lit(1))

    def one(s, i):  # noqa: ANN001, ANN202
        of = lambda c: F.get(f"tree.{c}", i)
        return F.struct(
            s["span_id"].alias("span_id"), of("first").alias("row"), of("depth").alias("depth"), F.when(of("up") >= 0, F.get("tree.first", of("up"))).alias("parent_row"),
            of("n_kids").alias("n_children"), of("last").alias("subtree_end"), ((s["start_ns"] - F.col("low")) / length).alias("offset"), ((s["end_ns"] - s["start_ns"]) / length).alias("width"),
        )

    return rows.select("trace_id", F.explode(F.transform("spans", one)).alias("x")).select("trace_id", "x.*")


def visible_matches(spans: DataFrame, only: str = "all", query: str = "") -> DataFrame:
    """The spans (with error and critical) that a filter ("all", "errors", "critical") and a text search let through."""
    text = query.strip().lower()
    own = spans if only == "all" else spans.where("error" if only == "errors" else "critical")
    has = lambda c: F.contains(F.lower(c), F.lit(text))
    attrs = F.exists(F.map_entries("attrs"), lambda e: has(e["key"]) | has(e["value"]))
    return own if not text else own.where(has(F.col("service")) | has(F.col("name")) | F.coalesce(attrs, F.lit(False)))


def waterfall_filter(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """(trace_id, span_id, is_context): the matching spans, and their ancestors as context."""
    return trees.with_context(spans, matches)


def compact_rows(tiers: DataFrame, most: int) -> DataFrame:
    """tiers: (trace_id, span_id, tier, duration_ns). The best tiers of each trace, then the longest spans."""
    w = Window.partitionBy("trace_id").orderBy("tier", F.desc("duration_ns"), "span_id")
    return tiers.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def series_points(series: DataFrame, scale: float, now: int, step: int) -> DataFrame:
    """Scaled points without the newest bucket while it still fills."""
    newest = series.agg(F.max("bucket").alias("newest"))
    filling = (F.col("bucket") == F.col("newest")) & (F.col("bucket") + step > now)
    return series.crossJoin(F.broadcast(newest)).where(~filling).select("bucket", (F.col("value") * scale).alias("value"))  # one row


def stories_per_minute(rows: DataFrame) -> DataFrame:
    return stories(rows).groupBy(bucket("ts_ns", 60).alias("minute"), "kind").agg(F.count("*").alias("n"))


def top_groups(rows: DataFrame, most: int = 20) -> DataFrame:
    """The story groups with most stories: their number, first and last time and newest summary."""
    own = stories(rows).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.max_by("summary", F.struct("ts_ns", "story_id")).alias("summary"))
    return own.orderBy(F.desc("n"), "fingerprint").limit(most)


def latest_alerts(alerts: DataFrame, most: int = 50) -> DataFrame:
    """The alerts last seen, newest first."""
    return latest(alerts, ["alert_id"], "version").orderBy(F.desc("last_at"), "alert_id").limit(most)


def stories_by_cause(rows: DataFrame, most: int = 15) -> DataFrame:
    return stories(rows).groupBy("cause_service").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause_service").limit(most)


def node_calls(edges: DataFrame) -> DataFrame:
    sides = edges.select(F.col("parent_service").alias("service"), "calls", "errors").unionByName(edges.select(F.col("child_service").alias("service"), "calls", "errors"))
    return sides.groupBy("service").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))


def edge_table(edges: DataFrame) -> DataFrame:
    own = edges.groupBy("parent_service", "child_service").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration_ns_sum").alias("ns"))
    return own.select("parent_service", "child_service", "calls", F.round(F.col("errors") * 100 / F.col("calls"), 2).alias("error_pct"), F.round(F.col("ns") / F.col("calls") / 1_000_000, 2).alias("mean_ms"))


def alerts_per_hour(alerts: DataFrame) -> DataFrame:
    own = latest(alerts, ["alert_id"], "version")
    return own.groupBy((F.col("started_at") - F.col("started_at") % 3600).alias("hour"), "kind").agg(F.count("*").alias("n"))


def new_templates_per_hour(templates: DataFrame) -> DataFrame:
    return templates.groupBy(bucket("first_seen", 3600).alias("hour"), "service").agg(F.count("*").alias("n"))


def top_templates(hits: DataFrame, templates: DataFrame, most: int = 20) -> DataFrame:
    top = hits.groupBy("template_id").agg(F.countDistinct("log_id").alias("n")).orderBy(F.desc("n"), "template_id").limit(most)
    return top.join(templates.select("template_id", "service", "template"), "template_id")


def group_lag(committed: DataFrame, high: DataFrame) -> DataFrame:
    """Newest offsets less committed ones, one partition to many groups, summed by group."""
    return committed.join(high, ["topic", "part"]).groupBy("grp").agg(F.sum(F.col("high") - F.col("committed")).alias("lag"))
