"""The read queries: stories, traces, logs, services, metrics. Windows are half-open [start, end) in seconds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsflow.operators.baselines import SKETCH_K, quantiles
from obsflow.operators.tables import latest
from obsflow.operators.traces import span_self_ns

S = 1_000_000_000
SERVED = ["server", "consumer"]


@dataclass(frozen=True)
class Range:
    """A query window; row lists of a live window read a minute past its end."""

    start: int
    end: int
    live: bool = False

    @property
    def upper(self) -> int:
        return self.end + 60 if self.live else self.end

    @classmethod
    def of(cls, since: int, until: int, now: int, retention_s: int = 7 * 86400) -> Range:
        """At most seven days, not before what is retained; live if it reaches now."""
        end = min(until, now)
        return cls(max(since, end - 7 * 86400, now - retention_s), end, until >= now)

    @classmethod
    def parse(cls, params: dict[str, str], now: int, since: str = "1h") -> Range:
        """From request parameters: since and until as seconds since 1970, ISO times or spans before now such as 15m, 6h, 7d."""
        start, end = parse_time(params.get("since") or since, now), parse_time(params.get("until") or "0s", now)
        if start >= end:
            raise ValueError(f"the window from {start} to {end} is empty")
        return cls.of(start, end, now)

    def bucket_s(self, most: int = 120) -> int:
        """Whole minutes, so that there are at most so many buckets."""
        return max(60, -(-(self.end - self.start) // (most * 60)) * 60)

    def rows(self, ts_ns: str = "ts_ns") -> Column:
        return (F.col(ts_ns) >= self.start * S) & (F.col(ts_ns) < self.upper * S)

    def inside(self, ts_ns: str = "ts_ns") -> Column:
        return (F.col(ts_ns) >= self.start * S) & (F.col(ts_ns) < self.end * S)


def parse_time(text: str, now: int) -> int:
    """Seconds since 1970 of a time or of a span before now."""
    if found := re.fullmatch(r"([0-9]+)([smhd])", text):
        return now - int(found[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[found[2]]
    if re.fullmatch(r"[0-9]+", text):
        return int(text)
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"not a time: {text!r}") from None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())


def bucket(ts_ns: str, step: int) -> Column:
    whole = step * S
    return F.floor((F.col(ts_ns) - F.col(ts_ns) % whole) / S).cast("long")


def wanted(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows equal to the given values; None means any."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def stories(df: DataFrame, w: Range | None = None, slack_s: int = 600) -> DataFrame:
    """Newest version of each story; with a window, of rows near it only, so that the scan prunes by time."""
    if w is not None:
        df = df.where((F.col("ts_ns") >= (w.start - slack_s) * S) & (F.col("ts_ns") < (w.upper + slack_s) * S))
    return latest(df, ["story_id"], "span_count")


def story_groups(df: DataFrame, w: Range, kind: str | None = None, service: str | None = None, most: int = 100) -> DataFrame:
    """Newest first by size; service is the one of the root cause."""
    own = wanted(stories(df, w).where(w.rows()), kind=kind, cause_service=service)
    groups = own.groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.max_by("summary", F.struct("ts_ns", "story_id")).alias("summary"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
        F.min("kind").alias("kind"), F.max_by("story_id", F.struct("ts_ns", "story_id")).alias("sample_id"),
    )
    return groups.orderBy(F.desc("n"), "fingerprint").limit(most)


def group_buckets(df: DataFrame, w: Range, **filters: str | None) -> DataFrame:
    kept = story_groups(df, w, **filters).select("fingerprint")
    own = stories(df, w).where(w.rows()).join(kept, "fingerprint", "left_semi")
    return own.groupBy("fingerprint", bucket("ts_ns", w.bucket_s()).alias("bucket")).agg(F.count("*").alias("n"))


def story_group(df: DataFrame, fingerprint: str, w: Range, newest: int = 20) -> DataFrame:
    own = stories(df, w).where(w.rows()).where(F.col("fingerprint") == fingerprint)
    return own.orderBy(F.desc("ts_ns"), "story_id").limit(newest)


def story(df: DataFrame, story_id: str) -> DataFrame:
    return stories(df.where(F.col("story_id") == story_id))


def trace_spans(spans: DataFrame, trace_id: str, most: int = 10_000) -> DataFrame:
    """Distinct spans of a trace with self time, earliest first."""
    own = spans.where(F.col("trace_id") == trace_id)
    first = Window.partitionBy("span_id").orderBy("start_ns")
    once = own.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").orderBy("start_ns", "span_id").limit(most)
    return span_self_ns(once)


def trace_view(spans: DataFrame, logs: DataFrame, story_rows: DataFrame, trace_id: str, most: int = 5000, most_logs: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans with self_ns, logs, story) of a trace: replays once, the earliest first, the newest version of its story."""
    said = logs.where(F.col("trace_id") == trace_id).dropDuplicates(["log_id"]).orderBy("ts_ns", "log_id").limit(most_logs)
    return trace_spans(spans, trace_id, most), said, stories(story_rows.where(F.col("trace_id") == trace_id))


def template_detail(hits: DataFrame, templates: DataFrame, alerts: DataFrame, template_id: str, w: Range, newest: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(template, its hits by bucket, its newest hits, its alerts of the seven days before the window's end)."""
    one = templates.where(F.col("template_id") == template_id)
    own = latest(alerts.where(F.col("template_id") == template_id), ["alert_id"], "version").where((F.col("last_at") >= w.end - 7 * 86400) & (F.col("started_at") < w.upper))
    return one, template_buckets(hits, one, w), latest_hits(hits, template_id, w, newest), own.orderBy(F.desc("last_at"), "alert_id")


def stories_series(df: DataFrame, w: Range) -> DataFrame:
    own = stories(df, w).where(w.inside())
    counts = own.groupBy(bucket("ts_ns", w.bucket_s()).alias("bucket")).pivot("kind", ["error", "slow"]).count()
    return counts.select("bucket", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("error", "slow")))


def log_alerts(alerts: DataFrame, examples: DataFrame, story_rows: DataFrame, w: Range, kind: str | None = None, service: str | None = None, most: int = 200) -> DataFrame:
    """Alerts that overlap the window, whether active at its end, and which of their example traces have a story."""
    own = wanted(latest(alerts, ["alert_id"], "version"), kind=kind, service=service).where((F.col("started_at") < w.upper) & (F.col("last_at") >= w.start))
    top = own.withColumn("active", F.col("last_at") > w.end - 600).orderBy(F.desc("last_at"), "alert_id").limit(most)
    traces = top.join(examples, "template_id").select("alert_id", F.explode("traces").alias("trace_id"))
    linked = traces.join(stories(story_rows).select("trace_id", "story_id"), "trace_id").groupBy("alert_id").agg(F.array_sort(F.collect_list("story_id")).alias("stories"))
    return top.join(linked, "alert_id", "left").withColumn("n_stories", F.coalesce(F.size("stories"), F.lit(0)))


def log_templates(hits: DataFrame, templates: DataFrame, alerts: DataFrame, silences: DataFrame, w: Range, service: str | None = None, q: str | None = None, most: int = 200) -> DataFrame:
    counts = hits.where(w.inside()).groupBy("template_id").agg(F.countDistinct("log_id").alias("n"))
    listed = wanted(counts.join(templates, "template_id"), service=service)
    if q:
        listed = listed.where(F.lower("template").contains(q.lower()))
    alerting = latest(alerts, ["alert_id"], "version").where("kind <> 'silence'").where((F.col("last_at") > w.end - 600) & (F.col("started_at") < w.end)).select("template_id").distinct().withColumn("alerting", F.lit(True))
    silenced = silences.where("enabled").select("template_id").withColumn("silenced", F.lit(True))
    out = listed.join(alerting, "template_id", "left").join(silenced, "template_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("alerting", "silenced")}).orderBy(F.desc("n"), "template_id").limit(most)


def template_buckets(hits: DataFrame, ids: DataFrame, w: Range) -> DataFrame:
    own = hits.where(w.inside()).join(ids.select("template_id"), "template_id", "left_semi")
    return own.groupBy("template_id", bucket("ts_ns", w.bucket_s()).alias("bucket")).agg(F.countDistinct("log_id").alias("n"))


def latest_hits(hits: DataFrame, template_id: str, w: Range, newest: int = 20) -> DataFrame:
    own = hits.where((F.col("template_id") == template_id) & (F.col("ts_ns") < w.end * S)).dropDuplicates(["log_id"])
    return own.orderBy(F.desc("ts_ns"), "log_id").limit(newest)


def trace_log_templates(logs: DataFrame, hits: DataFrame, alerts: DataFrame, trace_id: str, lead_s: int = 300, active_s: int = 600) -> DataFrame:
    """Template of each log of a trace and the kind of alert active around it; a spike comes before the other kinds."""
    own = logs.where(F.col("trace_id") == trace_id).select("log_id", "ts_ns", "body").join(hits.where(F.col("trace_id") == trace_id).select("log_id", "template_id").distinct(), "log_id")
    near = latest(alerts, ["alert_id"], "version").select("template_id", "kind", "started_at", "last_at")
    at = F.col("ts_ns") / S
    inside = (near["template_id"] == own["template_id"]) & (at >= F.col("started_at") - lead_s) & (at <= F.col("last_at") + active_s)
    rank = F.when(F.col("kind") == "spike", 3).when(F.col("kind") == "new", 2).when(F.col("kind") == "silence", 1)
    best = own.join(near, inside, "left").groupBy("log_id", "ts_ns", "body", own["template_id"]).agg(F.max_by("kind", rank).alias("alert_kind"))
    return best


def service_map(edges: DataFrame, w: Range, most: int = 500) -> DataFrame:
    own = edges.where((F.col("minute") >= w.start) & (F.col("minute") < w.end)).groupBy("parent_service", "child_service").agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration_ns_sum").alias("duration_ns_sum")
    )
    return own.select(
        "parent_service", "child_service", "calls", "errors", (F.col("errors") / F.col("calls")).alias("error_rate"), (F.col("duration_ns_sum") / F.col("calls")).alias("mean_ns")
    ).orderBy(F.desc("calls"), "parent_service", "child_service").limit(most)


def service_nodes(spans: DataFrame, w: Range, baseline_s: int = 86400) -> DataFrame:
    """Served spans per service: calls, errors, p99, the p99 of the day before the minute of the end, and health.

    A service is in error when at least 5 % of its calls failed, and slow when its p99 is over twice a positive baseline.
    """
    served = spans.where(F.col("kind").isin(SERVED))
    end = w.end - w.end % 60
    now = served.where(w.inside("start_ns")).groupBy("service").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.percentile("duration_ns", 0.99).alias("p99"))
    day = served.where((F.col("start_ns") >= (end - baseline_s) * S) & (F.col("start_ns") < end * S)).groupBy("service").agg(F.percentile("duration_ns", 0.99).alias("base_p99"))
    slow = (F.col("base_p99") > 0) & (F.col("p99") > 2 * F.col("base_p99"))
    health = F.when(F.col("errors") * 20 >= F.col("calls"), "error").when(slow, "slow").otherwise("ok")
    return now.join(day, "service", "left").withColumn("health", health)


def service_sketches(spans: DataFrame, step_s: int = 60) -> DataFrame:
    """Per service and slice of time: served calls, errors and durations as a quantile sketch; to be stored and merged."""
    served = spans.where(F.col("kind").isin(SERVED)).groupBy("service", bucket("start_ns", step_s).alias("slot"))
    return served.agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.kll_sketch_agg_bigint("duration_ns", F.lit(SKETCH_K)).alias("durations"))


def _merged(sketches: DataFrame, start: int, end: int, *by: str) -> DataFrame:
    own = sketches.where((F.col("slot") >= start) & (F.col("slot") < end)).groupBy(*by)
    return own.agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.kll_merge_agg_bigint("durations").alias("q"))


def sketched_nodes(sketches: DataFrame, w: Range, baseline_s: int = 86400) -> DataFrame:
    """service_nodes from service_sketches, of whole slices; the ranks of p99 are within RANK_ERROR."""
    end = w.end - w.end % 60
    now = _merged(sketches, w.start, w.end, "service").select("service", "calls", "errors", quantiles(F.col("q"), 0.99)[0].alias("p99"))
    day = _merged(sketches, end - baseline_s, end, "service").select("service", quantiles(F.col("q"), 0.99)[0].alias("base_p99"))
    slow = (F.col("base_p99") > 0) & (F.col("p99") > 2 * F.col("base_p99"))
    return now.join(day, "service", "left").withColumn("health", F.when(F.col("errors") * 20 >= F.col("calls"), "error").when(slow, "slow").otherwise("ok"))


def sketched_red(sketches: DataFrame, service: str, w: Range) -> DataFrame:
    """service_red from service_sketches; the ranks of quantiles are within RANK_ERROR."""
    step = w.bucket_s()
    own = sketches.where(F.col("service") == service).withColumn("bucket", F.col("slot") - F.col("slot") % step)
    named = (q.alias(n) for q, n in zip(quantiles(F.col("q"), 0.5, 0.95, 0.99), ("p50", "p95", "p99"), strict=True))
    return _merged(own, w.start, w.end, "bucket").select("bucket", "calls", "errors", *named)


def overview(story_rows: DataFrame, alerts: DataFrame, spans: DataFrame, w: Range) -> DataFrame:
    counts = stories(story_rows, w).where(w.inside()).agg(F.count_if(F.col("kind") == "error").alias("error_stories"), F.count_if(F.col("kind") == "slow").alias("slow_stories"))
    active = latest(alerts, ["alert_id"], "version").where((F.col("last_at") > w.end - 600) & (F.col("started_at") < w.end)).agg(F.count("*").alias("active_alerts"))
    rate = spans.where(w.inside("start_ns")).agg((F.count("*") / (w.end - w.start)).alias("spans_per_s"))
    return counts.crossJoin(F.broadcast(active)).crossJoin(F.broadcast(rate))  # a row each


def traces_search(summaries: DataFrame, story_rows: DataFrame, w: Range, service: str | None = None, only_errors: bool = False, min_ms: int = 0, most: int = 100, slack_s: int = 600) -> DataFrame:
    """Newest version of each trace, filtered after that; versions that a newer one outside the window replaces go."""
    scan = summaries.where((F.col("ts_ns") >= (w.start - slack_s) * S) & (F.col("ts_ns") < (w.upper + slack_s) * S))
    own = wanted(latest(scan, ["trace_id"], "span_count", "ts_ns").where(w.rows()), endpoint_service=service).where(F.col("duration_ns") >= min_ms * 1_000_000)
    if only_errors:
        own = own.where("is_error")
    top = own.orderBy(F.desc("ts_ns"), "trace_id").limit(most + 50)
    newest = summaries.join(top.select("trace_id"), "trace_id", "left_semi").groupBy("trace_id").agg(F.max("span_count").alias("_most"))
    found = story_rows.join(top.select("trace_id"), "trace_id", "left_semi")
    kinds = stories(found).select("trace_id", F.col("kind").alias("story_kind"))
    current = top.join(newest, "trace_id").where("span_count = _most").drop("_most").join(kinds, "trace_id", "left")
    return current.orderBy(F.desc("ts_ns"), "trace_id").limit(most)


def touched(summaries: DataFrame, spans: DataFrame, service: str) -> DataFrame:
    return summaries.join(spans.where(F.col("service") == service).select("trace_id"), "trace_id", "left_semi")


def services(spans: DataFrame, now: int, most: int = 500) -> DataFrame:
    return spans.where((F.col("start_ns") >= (now - 86400) * S) & (F.col("start_ns") < now * S)).select("service").distinct().orderBy("service").limit(most)


def service_red(spans: DataFrame, service: str, w: Range) -> DataFrame:
    own = spans.where((F.col("service") == service) & F.col("kind").isin(SERVED) & w.inside("start_ns"))
    q = F.percentile("duration_ns", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = own.groupBy(bucket("start_ns", w.bucket_s()).alias("bucket")).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), q.alias("q"))
    return out.select("bucket", "calls", "errors", *(F.col("q")[k].alias(n) for k, n in enumerate(("p50", "p95", "p99"))))


def search(spans: DataFrame, templates: DataFrame, story_rows: DataFrame, q: str, most: int = 8) -> DataFrame:
    """Services, templates and story groups that contain the text, and the trace with that id; a few of each."""
    low = q.lower()
    hit = lambda df, name, label, kind: df.where(F.lower(label).contains(low)).select(F.lit(kind).alias("kind"), F.col(name).alias("id"), F.col(label).alias("label")).distinct().orderBy("label", "id").limit(most)
    out = hit(spans.select("service"), "service", "service", "service").unionByName(hit(templates, "template_id", "template", "template")).unionByName(hit(stories(story_rows), "fingerprint", "summary", "story"))
    if len(q) == 32 and all(c in "0123456789abcdef" for c in low):
        out = out.unionByName(spans.where(F.col("trace_id") == low).select(F.lit("trace").alias("kind"), F.col("trace_id").alias("id"), F.col("trace_id").alias("label")).limit(1))
    return out


# metrics: samples (ts_ms, job, metric, instance, value); a series is all columns but time and value

SERIES = ["job", "metric", "instance"]
#: The keys of series that have any labels, see labelled().
LABELLED = ["metric", "labels_text", "instance"]


def canonical(labels: Column) -> Column:
    """A map of labels as JSON text in the order of their names: the same for maps that hold the same."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def labelled(samples: DataFrame) -> DataFrame:
    """Samples (ts_ms, metric, labels, value) keyed by LABELLED: the instance apart, all other labels as one text."""
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    others = F.map_filter(labels, lambda k, v: (k != "instance") & (v != ""))  # an empty label is none
    return samples.select("ts_ms", "metric", canonical(others).alias("labels_text"), F.coalesce(labels["instance"], F.lit("")).alias("instance"), "value")


def with_labels(series: DataFrame, *names: str) -> DataFrame:
    """Series keyed by LABELLED with columns for some labels, empty where a series has no such label."""
    found = F.from_json("labels_text", "map<string,string>")
    return series.withColumns({n: F.coalesce(found[n], F.lit("")) for n in names})


def metric_buckets(samples: DataFrame, metric: str, start_ms: int, end_ms: int, step_s: int, keys: list[str] = SERIES) -> DataFrame:
    """The last finite sample of each series in each bucket."""
    finite = F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.abs(F.col("value").cast("double")) < float("inf"))
    own = samples.where((F.col("metric") == metric) & (F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms) & finite)
    at = F.floor((F.col("ts_ms") - F.col("ts_ms") % (step_s * 1000)) / 1000).cast("long")
    return own.groupBy(*keys, at.alias("bucket")).agg(F.max_by("value", "ts_ms").alias("value"), F.max("ts_ms").alias("at_ms"))


def series_increases(buckets: DataFrame, step_s: int, keys: list[str] = SERIES) -> DataFrame:
    """Increase since the bucket before in each series, and the time between the two buckets; after a reset it is the new value.

    A series without an instance whose other keys also occur with one is a target between spells of several replicas:
    only its adjacent buckets are paired.
    """
    w = Window.partitionBy(*keys).orderBy("bucket")
    pairs = buckets.withColumn("last", F.lag("value").over(w)).withColumn("elapsed_ms", (F.col("bucket") - F.lag("bucket").over(w)) * 1000).where("last is not null")
    if "instance" in keys:
        others = [k for k in keys if k != "instance"]
        replicated = buckets.where("instance <> ''").select(*others).distinct().withColumn("_replicated", F.lit(True))
        alone = (F.coalesce("instance", F.lit("")) == "") & F.coalesce("_replicated", F.lit(False))
        pairs = pairs.join(replicated, others, "left").where(~alone | (F.col("elapsed_ms") <= step_s * 1000)).drop("_replicated")
    return pairs.withColumn("increase", F.when(F.col("value") < F.col("last"), F.col("value")).otherwise(F.col("value") - F.col("last")))


def counter_rate(buckets: DataFrame, by: list[str], step_s: int, keys: list[str] = SERIES) -> DataFrame:
    rates = series_increases(buckets, step_s, keys)
    rates = with_labels(rates, *(n for n in by if n not in rates.columns))
    return rates.groupBy(*by, "bucket").agg(F.sum(F.col("increase") * 1000 / F.col("elapsed_ms")).alias("rate"))


def gauge(buckets: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Last values summed over series. Of a metric that every replica reports whole (up, ..._data_lag_seconds,
    ..._templates) series that differ in their instance only count once, with the largest value."""
    whole = (F.col("metric") == "up") | F.col("metric").rlike("(_data_lag_seconds|_templates)$")
    replica = F.when(~whole, F.col("instance"))
    once = buckets.groupBy(*(k for k in keys if k != "instance"), replica.alias("_replica"), "bucket").agg(F.max("value").alias("value"))
    return once.groupBy("metric", "bucket").agg(F.sum("value").alias("value"))


def histogram_quantile(increases: DataFrame, q: float) -> DataFrame:
    """Prometheus' quantile of cumulative buckets (bucket, le, increase): linear within the bucket that holds it.

    There is none where the bucket without an upper bound is missing or is the only one.
    """
    if not 0 <= q <= 1:
        raise ValueError(f"a quantile lies between 0 and 1, not at {q}")
    sums = increases.groupBy("bucket", F.col("le").cast("double").alias("le")).agg(F.sum("increase").alias("n"))
    up = Window.partitionBy("bucket").orderBy("le")
    whole = Window.partitionBy("bucket")
    rising = sums.withColumn("n", F.max("n").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    edged = rising.withColumns({"low": F.lag("le").over(up), "below": F.coalesce(F.lag("n").over(up), F.lit(0)), "total": F.max("n").over(whole), "top": F.max(F.when(F.col("le") < float("inf"), F.col("le"))).over(whole), "last": F.max("le").over(whole)})
    at = edged.where((F.col("total") > 0) & (F.col("last") == float("inf")) & F.col("top").isNotNull()).withColumn("rank", F.col("total") * q).where((F.col("n") >= F.col("rank")) & ((F.col("below") < F.col("rank")) | F.col("low").isNull()))
    inside = F.coalesce("low", F.lit(0.0)) + (F.col("le") - F.coalesce("low", F.lit(0.0))) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("top")).when(F.col("low").isNull() & (F.col("le") <= 0), F.col("le")).when(F.col("n") == F.col("below"), F.col("le")).otherwise(inside)
    return at.groupBy("bucket").agg(F.min(value).alias("value"))


def consumer_lag(offsets: DataFrame) -> DataFrame:
    """Per group and topic; a partition that was never committed (-1) counts as a whole."""
    behind = F.greatest(F.lit(0), F.when(F.col("committed") < 0, F.col("high")).otherwise(F.col("high") - F.col("committed")))
    return offsets.groupBy("grp", "topic").agg(F.sum(behind).alias("lag"))
