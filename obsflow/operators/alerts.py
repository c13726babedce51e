"""Log alerts: spikes against recent and seasonal baselines, new templates, silences, and the state behind them.

Times named now, start and end are seconds; columns ending in _ns are nanoseconds. now is always an argument.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsflow.functions.text import short_hash
from obsflow.operators.mining import OVERFLOW
from obsflow.operators.tables import latest, minute_of

S = 1_000_000_000


@dataclass(frozen=True)
class Rules:
    """Fixed defaults of the detector."""

    spike_s: int = 300
    baseline_s: int = 3600
    min_count: int = 10
    factor: float = 5.0
    least_coverage: float = 0.5
    active_s: int = 600
    new_age_s: int = 900
    recent_s: int = 600
    lookback_s: int = 3 * 86400


def template_windows(hits: DataFrame, templates: DataFrame, now: int, r: Rules = Rules()) -> DataFrame:
    """Distinct hits in the spike window and in the baseline before it, of templates with enough current hits."""
    spike, start = (now - r.spike_s) * S, (now - r.spike_s - r.baseline_s) * S
    recent = hits.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < now * S))
    counts = recent.groupBy("template_id").agg(
        F.countDistinct(F.when(F.col("ts_ns") >= spike, F.col("log_id"))).alias("current"), F.countDistinct(F.when(F.col("ts_ns") < spike, F.col("log_id"))).alias("baseline")
    )
    return counts.where(F.col("current") >= r.min_count).join(templates, "template_id")


def covered_minutes(hits: DataFrame, now: int, r: Rules = Rules()) -> DataFrame:
    start, end = (now - r.spike_s - r.baseline_s) * S, (now - r.spike_s) * S
    return hits.where((F.col("ts_ns") >= start) & (F.col("ts_ns") < end)).select(minute_of(F.col("ts_ns")).alias("minute")).distinct()


def template_coverage(windows: DataFrame, minutes: DataFrame, now: int, r: Rules = Rules()) -> DataFrame:
    """windows with covered: minutes of the baseline that have data since the template was first seen."""
    start, whole = now - r.spike_s - r.baseline_s, r.baseline_s // 60
    since = F.greatest(F.floor(F.col("first_seen") / S / 60).cast("long") * 60, F.lit(start - start % 60))
    seen = minutes.agg(F.array_sort(F.collect_list("minute")).alias("minutes"))  # at most a row for each baseline minute
    return windows.crossJoin(F.broadcast(seen)).withColumn("covered", F.least(F.size(F.filter("minutes", lambda m: m >= since)), F.lit(whole))).drop("minutes")


def spike_baseline(covered: DataFrame, now: int, r: Rules = Rules()) -> DataFrame:
    """windows with expected (hits to expect in a spike window; null where not judged) and status: spike, none or skip_coverage.

    Lines of the overflow template, templates younger than recent_s and those that existed for less than a spike window
    before it are not judged. A baseline covered in full is divided by its whole spike windows, a shorter one by the
    minutes that have data.
    """
    spike, whole = r.spike_s // 60, r.baseline_s // 60
    age = F.expr(f"({now * S} - first_seen) div {60 * S}")
    possible = F.least(age - spike, F.lit(whole))
    divisor = F.least(possible, F.col("covered"))
    judged = (F.col("template") != OVERFLOW) & (age >= r.recent_s // 60) & (age - spike >= spike)
    thin = F.col("covered") < possible * r.least_coverage
    full = F.col("baseline") / F.greatest(F.floor(divisor / spike), F.lit(1))
    expected = F.when(judged & ~thin, F.when(divisor >= whole, full).otherwise(F.col("baseline") * spike / divisor))
    fires = (F.col("current") >= r.min_count) & (F.col("current") >= r.factor * F.greatest(F.col("expected"), F.lit(1.0)))
    status = F.when(~judged, "none").when(thin, "skip_coverage").when(fires, "spike").otherwise("none")
    return covered.withColumn("expected", expected).withColumn("status", status)


def seasonal_counts(rollup: DataFrame, ids: DataFrame, now: int, shifts: tuple[int, ...] = (86400, 7 * 86400), r: Rules = Rules()) -> DataFrame:
    """(template_id, shift, n): distinct hits in the same window so long ago; null where no template has data there."""
    spark = rollup.sparkSession
    shift = spark.createDataFrame([(s,) for s in shifts], "shift long")  # a row for each shift
    low = now - r.spike_s - F.col("shift")
    own = rollup.join(F.broadcast(shift), (F.col("minute") >= low) & (F.col("minute") < now - F.col("shift")))
    counts = own.groupBy("shift", "template_id").agg(F.countDistinct("log_id").alias("n"))
    covered = own.select("shift").distinct().withColumn("covered", F.lit(True))
    grid = ids.select("template_id").distinct().crossJoin(F.broadcast(shift))
    return grid.join(covered, "shift", "left").join(counts, ["shift", "template_id"], "left").select("template_id", "shift", F.when(F.col("covered"), F.coalesce("n", F.lit(0))).alias("n"))


def seasonal_decision(spikes: DataFrame, seasonal: DataFrame, r: Rules = Rules()) -> DataFrame:
    """spikes with beats_season: above every covered comparator; true where none is covered."""
    most = seasonal.groupBy("template_id").agg(F.max("n").alias("season_max"), F.count("n").alias("season_covered"))
    beats = (F.coalesce("season_covered", F.lit(0)) == 0) | (F.col("current") >= r.factor * F.greatest(F.col("season_max"), F.lit(1)))
    return spikes.join(most, "template_id", "left").withColumn("beats_season", beats)


def spike_alerts(observations: DataFrame, r: Rules = Rules()) -> DataFrame:
    """Observations (template_id, at, current) at most ten minutes apart are one alert; its id holds the start minute."""
    w = Window.partitionBy("template_id").orderBy("at")
    fresh = (F.col("at") - F.lag("at").over(w)) <= r.active_s
    runs = observations.withColumn("run", F.sum((~F.coalesce(fresh, F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alerts = runs.groupBy("template_id", "run").agg(
        F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.max("current").alias("peak"), F.max_by("current", "at").alias("last_count"), F.count("*").alias("n_observations")
    )
    start_minute = F.col("started_at") - F.col("started_at") % 60
    return alerts.withColumn("alert_id", short_hash(F.lit("spike"), F.col("template_id"), start_minute)).drop("run")


def active_spike_alerts(alerts: DataFrame, now: int, r: Rules = Rules()) -> DataFrame:
    return latest(alerts, ["alert_id"], "version").where((F.col("kind") == "spike") & (F.col("last_at") >= now - r.active_s) & (F.col("last_at") <= now))


def new_template_candidates(templates: DataFrame, alerts: DataFrame, since_ns: int) -> DataFrame:
    """Templates first seen after since, without a new-alert yet, with the first sight of their service."""
    oldest = templates.groupBy("service").agg(F.min("first_seen").alias("service_first"))
    return templates.where(F.col("first_seen") > since_ns).join(oldest, "service").join(alerts.where("kind = 'new'").select("template_id"), "template_id", "left_anti")


def new_alerts(candidates: DataFrame, watermark_ns: int, epoch_ns: int, r: Rules = Rules()) -> DataFrame:
    """Candidates seen after the watermark less a minute, of services and a masking epoch that are old enough."""
    age = r.new_age_s * S
    keep = (F.col("first_seen") > watermark_ns - 60 * S) & (F.col("first_seen") - F.col("service_first") >= age) & (F.col("first_seen") - epoch_ns >= age)
    return candidates.where(keep & (F.coalesce("template", F.lit("")) != OVERFLOW)).withColumn("alert_id", short_hash(F.lit("new"), F.col("template_id")))


def data_now(hits: DataFrame, now: int, r: Rules = Rules()) -> DataFrame:
    """One row: the newest hit of the look-back that is not stamped more than a minute ahead."""
    inside = (F.col("ts_ns") >= (now - r.lookback_s) * S) & (F.col("ts_ns") <= (now + 60) * S)
    return hits.where(inside).agg(F.max("ts_ns").alias("data_now_ns"))


def detection_clock(partitions: DataFrame, fallback_ns: int) -> DataFrame:
    """One row from (next_offset, high, max_ts): the oldest partition that is behind, else the newest of all."""
    behind = F.col("next_offset") < F.col("high")
    return partitions.agg(F.coalesce(F.min(F.when(behind, F.col("max_ts"))), F.max("max_ts"), F.lit(fallback_ns)).alias("clock_ns"), F.count_if(behind).alias("behind"))


def silence_inputs(settings: DataFrame, templates: DataFrame, hits: DataFrame, now: int | None, r: Rules = Rules()) -> DataFrame:
    """Per enabled template: minutes, the newest hit of its own (else last_seen) and of its service.

    Hits count from the look-back up to now; without now all of them do.
    """
    recent = hits if now is None else hits.where((F.col("ts_ns") >= (now - r.lookback_s) * S) & (F.col("ts_ns") <= now * S))
    own = recent.groupBy("template_id").agg(F.max("ts_ns").alias("own_last"))
    service = recent.groupBy("service").agg(F.max("ts_ns").alias("service_last"))
    enabled = settings.where("enabled").select("template_id", "minutes").join(templates.select("template_id", "service", "last_seen"), "template_id")
    return enabled.join(own, "template_id", "left").join(service, "service", "left").withColumn("template_last", F.coalesce("own_last", "last_seen")).drop("own_last", "last_seen")


def silence_alerts(inputs: DataFrame, clock_ns: int) -> DataFrame:
    """Templates silent for their minutes while their service speaks; the id holds the start of the silence."""
    quiet = F.least(F.col("service_last"), F.lit(clock_ns)) - F.col("template_last")
    silent = inputs.where(F.col("service_last").isNotNull() & (quiet >= F.col("minutes").cast("long") * (60 * S)))
    return silent.withColumn("alert_id", short_hash(F.lit("silence"), F.col("template_id"), F.col("template_last")))


def example_traces(hits: DataFrame, n: int = 5) -> DataFrame:
    """The newest distinct traces of each template, newest first."""
    newest = hits.where("trace_id <> ''").groupBy("template_id", "trace_id").agg(F.max("ts_ns").alias("last"))
    w = Window.partitionBy("template_id").orderBy(F.desc("last"), "trace_id")
    top = newest.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return top.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "trace_id"))), lambda x: x["trace_id"]).alias("traces"))


def partition_states(partitions: DataFrame, now_ns: int, hold_ns: int, stale_ns: int = 60 * S) -> DataFrame:
    """(part, clock_ns, caught_up) of the assigned partitions that say something about the clock of a pass.

    partitions: part, position, high (both may be unknown), and of what was mined of it next_offset, last_record_ns and
    max_ns (the newest log); next_offset is null where nothing was mined since the start. A partition is behind when
    records remain and its newest one is stale, or when nothing was mined and records remain or may remain: it holds the
    clock. An idle one without logs says nothing.
    """
    fresh = F.col("next_offset").isNull()
    unread = F.coalesce(F.col("position") < F.col("high"), F.lit(True))
    stale = F.lit(now_ns) - F.col("last_record_ns") > stale_ns
    behind = F.when(fresh, unread).otherwise(stale & F.coalesce(F.col("next_offset") < F.col("high"), F.lit(True)))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    held = F.coalesce(F.least(some("max_ns"), some("last_record_ns")), F.lit(hold_ns))
    clock = F.when(behind, F.when(fresh, F.lit(hold_ns)).otherwise(held)).when(~fresh, some("max_ns"))
    return partitions.select("part", clock.cast("long").alias("clock_ns"), (~behind).alias("caught_up")).where("clock_ns is not null")


def pass_clock(states: DataFrame, fallback_ns: int, now_ns: int) -> DataFrame:
    """One row (clock_ns, behind): the oldest clock of the partitions that are behind, else the newest of all, never ahead of now."""
    behind = ~F.col("caught_up")
    clock = F.coalesce(F.min(F.when(behind, F.col("clock_ns"))), F.max("clock_ns"), F.lit(fallback_ns))
    return states.agg(F.least(clock, F.lit(now_ns)).alias("clock_ns"), F.count_if(behind).alias("behind"))


def scoped(df: DataFrame, services: DataFrame | None) -> DataFrame:
    """df of the owned services (null: of all)."""
    return df if services is None else df.join(services.select("service"), "service", "left_semi")


def detect_alerts(
    hits: DataFrame, templates: DataFrame, known: DataFrame, settings: DataFrame, now: int, watermark_ns: int, epoch_ns: int, version: int, r: Rules = Rules(), services: DataFrame | None = None
) -> DataFrame:
    """One pass: spikes that go on or start, new templates and silences, of the owned services (see ALERT).

    hits and templates of other services are left out before anything is counted; what the minutes of the baseline are
    covered by is judged over all of them. A spike that goes on keeps its id, its start and its peak.
    """
    minutes = covered_minutes(hits, now, r)
    hits, templates = scoped(hits, services), scoped(templates, services)
    windows = template_windows(hits, templates, now, r)
    spikes = spike_baseline(template_coverage(windows, minutes, now, r), now, r).where("status = 'spike'")
    near = " or ".join(f"ts_ns >= {(now - shift - r.spike_s) * S} and ts_ns < {(now - shift + 60) * S}" for shift in SHIFTS)
    rollup = hits.where(near).select("template_id", minute_of(F.col("ts_ns")).alias("minute"), "log_id")
    seasonal = seasonal_counts(rollup, spikes, now, SHIFTS, r=r)
    spikes = seasonal_decision(spikes, seasonal, r).where("beats_season")
    before = seasonal.groupBy("template_id").agg(*(F.max(F.when(F.col("shift") == shift, F.col("n"))).cast("double").alias(name) for shift, name in zip(SHIFTS, ("baseline_day", "baseline_week"), strict=True)))
    peak = F.col("peak_count") if "peak_count" in known.columns else F.col("count")
    open_spikes = active_spike_alerts(known.withColumn("_peak", peak), now, r).groupBy("template_id").agg(F.max_by(F.struct("alert_id", "started_at", F.col("_peak").alias("peak")), "last_at").alias("open"))
    minute = F.lit(now - now % 60)
    spike_rows = spikes.join(open_spikes, "template_id", "left").join(before, "template_id", "left").select(
        F.coalesce("open.alert_id", short_hash(F.lit("spike"), F.col("template_id"), minute)).alias("alert_id"), F.lit("spike").alias("kind"), "template_id", "service", "template",
        F.coalesce("open.started_at", F.lit(now)).alias("started_at"), F.lit(now).alias("last_at"), F.col("current").alias("window_count"), F.greatest(F.coalesce("open.peak", F.lit(0)), "current").alias("peak_count"),
        F.col("expected").cast("double").alias("baseline_per_window"), "baseline_day", "baseline_week",
    )
    fresh = new_alerts(new_template_candidates(templates, known, watermark_ns - 60 * S), watermark_ns, epoch_ns, r)
    seen = F.expr("first_seen div 1000000000")
    none = [F.lit(None).cast("double").alias(c) for c in ("baseline_per_window", "baseline_day", "baseline_week")]
    new_rows = fresh.select("alert_id", F.lit("new").alias("kind"), "template_id", "service", "template", seen.alias("started_at"), seen.alias("last_at"), F.lit(1).alias("window_count"), F.lit(1).alias("peak_count"), *none)
    silent = silence_alerts(silence_inputs(settings, templates, hits, now, r), now * S).join(templates.select("template_id", "template"), "template_id")
    began = F.expr("template_last div 1000000000").alias("started_at")
    silent_rows = silent.select("alert_id", F.lit("silence").alias("kind"), "template_id", "service", "template", began, F.lit(now).alias("last_at"), F.lit(0).alias("window_count"), F.lit(0).alias("peak_count"), *none)
    once = new_rows.unionByName(silent_rows).join(known.select("alert_id").distinct(), "alert_id", "left_anti")
    found = spike_rows.unionByName(once)
    examples = example_traces(hits.where((F.col("ts_ns") >= (now - r.lookback_s) * S) & (F.col("ts_ns") <= now * S)).join(found.select("template_id").distinct(), "template_id", "left_semi"))
    told = found.join(examples.withColumnRenamed("traces", "example_trace_ids"), "template_id", "left").withColumn("version", F.lit(version))
    kept = {"example_trace_ids": F.coalesce("example_trace_ids", F.array().cast("array<string>"))}
    return told.withColumns(kept).select(*(F.col(c).cast(kind).alias(c) for c, kind in (x.split() for x in ALERT.split(", "))))


SHIFTS = (86400, 7 * 86400)
ALERT = (
    "alert_id string, kind string, template_id string, service string, template string, started_at long, last_at long, window_count long, peak_count long, baseline_per_window double, "
    "example_trace_ids array<string>, version long, baseline_day double, baseline_week double"
)


def unpublished_alerts(alerts: DataFrame, publications: DataFrame, now: int, most: int = 1000) -> DataFrame:
    newest = latest(alerts, ["alert_id"], "version").where(F.col("version") >= (now - 86400) * S)
    return newest.join(publications.select("alert_id"), "alert_id", "left_anti").orderBy("version", "alert_id").limit(most)


def silence_settings(writes: DataFrame, templates: DataFrame) -> DataFrame:
    """The settings in force: the latest valid write of each known template."""
    valid = writes.where(F.col("minutes").between(1, 1440)).join(templates.select("template_id"), "template_id", "left_semi")
    return latest(valid, ["template_id"], "updated_at")


def owned_services(hits: DataFrame, now: int, window_s: int) -> DataFrame:
    return hits.groupBy("service").agg(F.max("ts_ns").alias("last")).where((F.col("last") >= (now - window_s) * S) & (F.col("last") <= now * S)).select("service")


def state_values(writes: DataFrame, prefix: str = "") -> DataFrame:
    newest = latest(writes, ["key"], "updated_at")
    return newest.where(F.col("key").startswith(prefix)) if prefix else newest


def shared_watermark(writes: DataFrame, partitions: DataFrame, legacy_key: str, now_ns: int) -> DataFrame:
    """One row: the smallest watermark of the partitions, each falling back to the legacy key, never ahead of now."""
    values = state_values(writes)
    legacy = values.where(F.col("key") == legacy_key).agg(F.max("value").alias("legacy"))
    each = partitions.join(values, "key", "left").crossJoin(F.broadcast(legacy))  # one row
    return each.agg(F.least(F.min(F.coalesce("value", "legacy")), F.lit(now_ns)).alias("watermark_ns"))


def drop_state(writes: DataFrame, older_than: int) -> DataFrame:
    """State writes without the values that were last written before older_than; the newest of each key alone."""
    return state_values(writes).where(F.col("updated_at") >= older_than)


def masking_epoch(stored: DataFrame, version: int, now: Column) -> DataFrame:
    """stored (masking_version, epoch_start, has_templates) with the epoch in force: kept, restarted at now, or 0 for a first run."""
    start = F.when(F.col("masking_version") == version, F.col("epoch_start")).when(F.col("has_templates"), now).otherwise(F.lit(0))
    return stored.withColumn("epoch_ns", start)
