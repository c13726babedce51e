"""Endpoint baselines from trace summaries, slow limits and differences from the baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.operators.tables import latest

KEYS = ["endpoint_service", "endpoint_name"]


@dataclass(frozen=True)
class Thresholds:
    """Fixed defaults of the analysis."""

    min_traces: int = 50
    slow_factor: float = 1.5
    slow_extra_ns: int = 100_000_000
    new_presence: float = 0.01
    missing_presence: float = 0.95
    op_factor: float = 2.0
    op_extra_ns: int = 50_000_000
    cap_factor: int = 10
    carry_windows: int = 2


#: How far the versions of one trace's summary may lie apart: a trace stays open for a minute at most.
VERSIONS_NS = 600_000_000_000


def kept_summaries(summaries: DataFrame, slow_ids: DataFrame, caps: DataFrame, start_ns: int, end_ns: int, t: Thresholds = Thresholds()) -> DataFrame:
    """Latest non-error summaries of the window with slow, cap and kept; endpoints without a cap start from ten medians.

    Versions are settled among summaries of the window and VERSIONS_NS around it, so that the filter comes before the
    shuffle and reaches the files. What has a row for each endpoint goes to every task: traces dealt by their endpoint
    would stand in as many tasks as there are endpoints.
    """
    near = summaries.where((F.col("ts_ns") >= start_ns - VERSIONS_NS) & (F.col("ts_ns") < end_ns + VERSIONS_NS))
    own = latest(near, ["trace_id"], "span_count", "ts_ns").where(~F.col("is_error") & (F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))
    flagged = own.join(slow_ids.select("trace_id").distinct().withColumn("_slow", F.lit(True)), "trace_id", "left").withColumn("slow", F.coalesce("_slow", F.lit(False))).drop("_slow")
    medians = flagged.where("not slow").groupBy(*KEYS).agg(F.percentile("duration_ns", 0.5).alias("p50"))
    boot = medians.select(*KEYS, F.ceil(F.col("p50") * t.cap_factor).cast("long").alias("boot"))
    cap = F.coalesce("cap", "boot", F.lit(0)).cast("long")
    return flagged.join(F.broadcast(caps), KEYS, "left").join(F.broadcast(boot), KEYS, "left").withColumn("cap", cap).withColumn("kept", ~F.col("slow") & (F.col("duration_ns") <= F.col("cap"))).drop("boot")


def endpoint_stats(kept: DataFrame) -> DataFrame:
    used = F.when(F.col("kept"), F.col("duration_ns"))
    q = F.percentile(used, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    stats = kept.groupBy(*KEYS).agg(F.count("*").alias("seen"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("excluded"), q.alias("q"))
    return stats.select(*KEYS, "seen", "kept", "excluded", *(F.col("q")[k].alias(n) for k, n in enumerate(("p50", "p95", "p99"))))


def op_stats(kept: DataFrame) -> DataFrame:
    ops = kept.where("kept").select(*KEYS, F.explode("op_durations").alias("op", "duration"))
    return ops.groupBy(*KEYS, "op").agg(F.count("*").alias("present"), F.percentile("duration", 0.95).alias("p95"))


#: Items a level of a quantile sketch keeps. Ranks are off by at most RANK_ERROR of the count, in 99 of 100 sketches.
SKETCH_K, RANK_ERROR = 200, 0.0165
HOUR_NS = 3_600_000_000_000


def endpoint_sketches(kept: DataFrame, k: int = SKETCH_K, slice_ns: int = HOUR_NS) -> DataFrame:
    """Per endpoint and slice of time: seen, excluded, and durations of kept traces as a quantile sketch, to be stored and merged.

    Sketches combine before the shuffle, so no task holds all durations of an endpoint. Up to k durations are exact.
    """
    slot = (F.col("ts_ns") - F.col("ts_ns") % slice_ns).alias("slot_ns")
    used = F.when(F.col("kept"), F.col("duration_ns"))
    return kept.groupBy(*KEYS, slot).agg(F.count("*").alias("seen"), F.count_if(~F.col("kept")).alias("excluded"), F.kll_sketch_agg_bigint(used, F.lit(k)).alias("durations"))


def op_sketches(kept: DataFrame, k: int = SKETCH_K, slice_ns: int = HOUR_NS) -> DataFrame:
    """Per endpoint, operation and slice of time: the traces with it, and its longest durations as a quantile sketch."""
    slot = (F.col("ts_ns") - F.col("ts_ns") % slice_ns).alias("slot_ns")
    ops = kept.where("kept").select(*KEYS, slot, F.explode("op_durations").alias("op", "duration"))
    return ops.groupBy(*KEYS, "op", "slot_ns").agg(F.count("*").alias("present"), F.kll_sketch_agg_bigint("duration", F.lit(k)).alias("durations"))


def quantiles(sketch: Column, *shares: float) -> list[Column]:
    """Quantiles of a merged sketch, as values that occurred; null for an empty one."""
    there = F.kll_sketch_get_n_bigint(sketch) > 0
    return [F.when(there, F.kll_sketch_get_quantile_bigint(sketch, F.lit(q))) for q in shares]


def merged_endpoint_stats(sketches: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """endpoint_stats of the slices from start_ns to end_ns; ranks are within RANK_ERROR."""
    own = sketches.where((F.col("slot_ns") >= start_ns) & (F.col("slot_ns") < end_ns)).groupBy(*KEYS)
    whole = own.agg(F.sum("seen").alias("seen"), F.sum("excluded").alias("excluded"), F.kll_merge_agg_bigint("durations").alias("q"))
    named = (q.alias(n) for q, n in zip(quantiles(F.col("q"), 0.5, 0.95, 0.99), ("p50", "p95", "p99"), strict=True))
    return whole.select(*KEYS, "seen", (F.col("seen") - F.col("excluded")).alias("kept"), "excluded", *named)


def merged_op_stats(sketches: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """op_stats of the slices from start_ns to end_ns; ranks are within RANK_ERROR."""
    own = sketches.where((F.col("slot_ns") >= start_ns) & (F.col("slot_ns") < end_ns)).groupBy(*KEYS, "op")
    whole = own.agg(F.sum("present").alias("present"), F.kll_merge_agg_bigint("durations").alias("q"))
    return whole.select(*KEYS, "op", "present", quantiles(F.col("q"), 0.95)[0].alias("p95"))


def slow_limit(p99: Column, t: Thresholds = Thresholds()) -> Column:
    return F.greatest(p99 * t.slow_factor, p99 + t.slow_extra_ns)


def caps_from(previous: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The slow limits of trusted previous baselines."""
    usable = (F.col("traces") >= t.min_traces) & ~F.isnan("p99") & (F.col("p99") > 0)
    return previous.where(usable).select(*KEYS, F.ceil(slow_limit(F.col("p99"), t)).cast("long").alias("cap"))


def refresh_baselines(
    stats: DataFrame, ops: DataFrame, previous: DataFrame, previous_ops: DataFrame, carried: DataFrame, now: int, window_minutes: int, t: Thresholds = Thresholds()
) -> tuple[DataFrame, DataFrame]:
    """(baselines, operations). A trusted previous baseline is carried for two windows where too few traces were kept.

    previous: KEYS, traces, p50, p95, p99; carried: KEYS, since. Endpoints that were not seen, or of which nothing was
    kept and nothing can be carried, have no baseline. carried_since is null for fresh baselines.
    """
    old = previous.select(*KEYS, *(F.col(c).alias(f"old_{c}") for c in ("traces", "p50", "p95", "p99")))
    since = F.coalesce("since", F.lit(now))
    carry = (F.col("kept") < t.min_traces) & (F.coalesce("old_traces", F.lit(0)) >= t.min_traces) & (F.lit(now) - since < t.carry_windows * window_minutes * 60)
    joined = stats.where("seen > 0").join(old, KEYS, "left").join(carried, KEYS, "left").withColumn("carry", carry)
    usable = F.col("carry") | ((F.col("kept") > 0) & F.col("p50").isNotNull() & F.col("p99").isNotNull())
    pick = lambda new, c: F.when(F.col("carry"), F.col(f"old_{c}")).otherwise(F.col(new)).alias(c)
    baselines = joined.where(usable).select(*KEYS, pick("kept", "traces"), *(pick(c, c) for c in ("p50", "p95", "p99")), F.when(F.col("carry"), since).alias("carried_since"))
    fresh = ops.join(baselines.where("carried_since is null and traces > 0"), KEYS).select(*KEYS, "op", (F.col("present") / F.col("traces")).alias("presence"), ops["p95"].alias("p95"))
    kept_ops = previous_ops.join(baselines.where("carried_since is not null").select(*KEYS), KEYS, "left_semi").select(*KEYS, "op", "presence", "p95")
    return baselines, fresh.unionByName(kept_ops)


def baselines_from_summaries(summaries: DataFrame) -> DataFrame:
    """Offline baselines with nearest-rank quantiles over non-error traces."""
    rank = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration_ns)")
    return summaries.where("not is_error").groupBy(*KEYS).agg(F.count("*").alias("traces"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"))


def offline_op_stats(summaries: DataFrame) -> DataFrame:
    """The operations of offline baselines: presence, the share of an endpoint's non-error traces, and the nearest-rank p95."""
    good = summaries.where("not is_error")
    traces = good.groupBy(*KEYS).agg(F.count("*").alias("traces"))
    ops = good.select(*KEYS, F.explode("op_durations").alias("op", "duration")).groupBy(*KEYS, "op")
    p95 = F.expr("percentile_disc(0.95) within group (order by duration)").cast("long").alias("p95")
    return ops.agg(F.count("*").alias("present"), p95).join(traces, KEYS).select(*KEYS, "op", (F.col("present") / F.col("traces")).alias("presence"), "p95")


def slow_traces(summaries: DataFrame, baselines: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    trusted = baselines.where(F.col("traces") >= t.min_traces).select(*KEYS, "p99")
    return summaries.where("not is_error").join(F.broadcast(trusted), KEYS).where(F.col("duration_ns") > slow_limit(F.col("p99"), t))


def baseline_diff(summaries: DataFrame, baselines: DataFrame, ops: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Per trace of a trusted endpoint: new_ops, missing_ops and slower_ops, each sorted by name.

    summaries: a row for each trace; ops: a row for each operation of an endpoint. An endpoint's operations meet a trace
    as one map, so there are never more rows than traces.
    """
    expected = F.map_from_entries(F.collect_list(F.struct("op", F.struct("presence", "p95"))))
    by_endpoint = ops.groupBy(*KEYS).agg(expected.alias("expected"))  # a row for each endpoint
    trusted = baselines.where(F.col("traces") >= t.min_traces).select(*KEYS).distinct().join(by_endpoint, KEYS, "left")
    nothing = F.map_from_entries(F.array().cast("array<struct<op: string, of: struct<presence: double, p95: double>>>"))
    own = summaries.join(F.broadcast(trusted), KEYS).select("trace_id", F.col("op_durations").alias("had"), F.coalesce("expected", nothing).alias("expected"))
    presence = lambda op: F.col("expected")[op]["presence"]
    unknown = lambda op: F.coalesce(presence(op), F.lit(0.0)) < t.new_presence

    def is_slower(op: Column) -> Column:
        p95 = F.col("expected")[op]["p95"]
        return F.col("had")[op] > F.greatest(p95 * t.op_factor, p95 + t.op_extra_ns)

    names = lambda ops, which: F.array_sort(F.filter(F.map_keys(ops), which))
    return own.where((F.size("had") > 0) | (F.size("expected") > 0)).select(
        "trace_id", names("had", unknown).alias("new_ops"), names("expected", lambda op: ~F.map_contains_key("had", op) & (presence(op) > t.missing_presence)).alias("missing_ops"),
        names("had", lambda op: is_slower(op) & ~unknown(op)).alias("slower_ops"),
    )
