"""Alert delivery: routing, attempts, circuit breaker, payloads and messages, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.operators.tables import latest

MAX_ATTEMPTS, MAX_WAIT_S, MAX_AGE_S, COOLDOWN_S = 8, 300, 3600, 300  # fixed defaults


def route_alerts(alerts: DataFrame, targets: DataFrame, kinds: list[str], now: int, max_age_s: int = MAX_AGE_S) -> DataFrame:
    """Each alert with each target and a decision; without targets one row says so. targets: a configured list, a few rows."""
    routed = alerts.join(F.broadcast(targets), F.lit(True), "left")
    decision = F.when(F.col("target").isNull(), "no_targets").when(~F.col("kind").isin(kinds), "excluded_kind").when(F.col("last_at") < now - max_age_s, "stale").otherwise("deliver")
    return routed.withColumn("decision", decision)


def delivery_plan(routed: DataFrame, deliveries: DataFrame) -> DataFrame:
    state = latest(deliveries, ["alert_id", "target"], "updated_at").select("alert_id", "target", "status", "attempts")
    plan = routed.where("decision = 'deliver'").join(state, ["alert_id", "target"], "left")
    done = F.coalesce(F.col("status").isin("delivered", "failed"), F.lit(False))
    return plan.withColumn("action", F.when(done, "skip").otherwise("attempt")).withColumn("attempts", F.coalesce("attempts", F.lit(0)))


def retry_after_s(value: Column, at_ns: Column) -> Column:
    """Seconds to wait from a Retry-After header: a number, or a date."""
    date = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.coalesce(value.try_cast("bigint"), F.greatest(F.lit(0), F.unix_timestamp(date) - F.floor(at_ns / 1_000_000_000)))


def delivery_outcome(attempts: DataFrame) -> DataFrame:
    """attempts (attempt, http_status, retry_after, at_ns) with outcome and wait_s."""
    status = F.col("http_status")
    retryable = status.isNull() | (status == 429) | (status >= 500)
    outcome = F.when(status.between(200, 299), "delivered").when(~retryable, "permanent").when(F.col("attempt") >= MAX_ATTEMPTS, "gave_up").otherwise("retry")
    wait = F.least(F.greatest(F.pow(F.lit(2), F.least(F.col("attempt"), F.lit(30)) - 1).cast("long"), F.coalesce(retry_after_s(F.col("retry_after"), F.col("at_ns")), F.lit(0))), F.lit(MAX_WAIT_S))
    return attempts.withColumn("outcome", outcome).withColumn("wait_s", F.when(F.col("outcome") == "retry", wait))


def breaker_status(outcomes: DataFrame, now_ns: int, cooldown_s: int = COOLDOWN_S) -> DataFrame:
    """Per target: open while its last delivery or give-up is a give-up within the cooldown."""
    seen = outcomes.groupBy("target").agg(F.max_by("outcome", F.when(F.col("outcome").isin("gave_up", "delivered"), F.col("at_ns"))).alias("last"), F.max(F.when(F.col("outcome").isin("gave_up", "delivered"), F.col("at_ns"))).alias("last_ns"))
    is_open = (F.col("last") == "gave_up") & (F.col("last_ns") + cooldown_s * 1_000_000_000 > now_ns)
    return seen.select("target", F.coalesce(is_open, F.lit(False)).alias("is_open"), F.when(is_open, F.col("last_ns") + cooldown_s * 1_000_000_000).alias("until_ns"))


def rfc3339(seconds: Column) -> Column:
    """UTC with milliseconds, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def silent_minutes() -> Column:
    return F.greatest(F.expr("(last_at - started_at) div 60"), F.lit(0))


def baseline_text() -> Column:
    return F.format_string("%.1f", F.bround(F.coalesce("baseline", F.lit(0.0)), 1))


def summary_text() -> Column:
    """One line on an alert, by its kind."""
    kind, service, template = F.col("kind"), F.col("service"), F.col("template")
    spike = F.concat(template, F.lit(" spiked to "), F.col("count").cast("string"), F.lit(" per window in "), service, F.lit(" (baseline "), baseline_text(), F.lit(")"))
    silence = F.concat(template, F.lit(" has been silent for "), silent_minutes().cast("string"), F.lit(" min in "), service)
    return F.when(kind == "spike", spike).when(kind == "silence", silence).otherwise(F.concat(F.lit("New log template in "), service, F.lit(": "), template))


def template_link(base_url: str) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/logs/templates/"), "template_id")


def trace_links(base_url: str, most: int) -> Column:
    return F.transform(F.slice("traces", 1, most), lambda t: F.concat(F.lit(base_url.rstrip("/") + "/traces/"), t))


def webhook_payload(alerts: DataFrame, base_url: str, most_traces: int = 3) -> DataFrame:
    """alerts: (alert_id, kind, service, template_id, template, started_at, last_at, count, baseline, traces)."""
    body = F.struct(
        "alert_id", "kind", "service", "template_id", "template", rfc3339(F.col("started_at")).alias("started_at"), rfc3339(F.col("last_at")).alias("last_at"), "count",
        F.coalesce("baseline", F.lit(0.0)).alias("baseline"), summary_text().alias("summary"), F.col("traces").alias("example_trace_ids"),
        F.struct(template_link(base_url).alias("template"), trace_links(base_url, most_traces).alias("traces")).alias("links"),
    )
    return alerts.select("alert_id", F.to_json(body).alias("payload"))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def escaped(text: Column, most: int) -> Column:
    """Control characters as entities; a cut text ends before an entity that does not fit, with an ellipsis."""
    whole = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.regexp_replace(F.substring(whole, 1, most - 1), "&[a-z]*$", "")
    return F.when(F.length(whole) > most, F.concat(head, F.lit("…"))).otherwise(whole)


def slack_payload(alerts: DataFrame, base_url: str, most_traces: int = 3, header_max: int = 150, template_max: int = 2800, text_max: int = 3000) -> DataFrame:
    """A text, and blocks: a header, the template as code without backticks, fields by kind, buttons to the template and to traces."""
    plain = lambda text: F.struct(F.lit("plain_text").alias("type"), text.alias("text"))
    mark = lambda text: F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))
    field = lambda name, value: mark(F.concat(F.lit(f"*{name}*\n"), value))
    button = lambda action, label, url: F.struct(F.lit("button").alias("type"), action.alias("action_id"), plain(label).alias("text"), url.alias("url"))
    titles = F.when(F.col("kind") == "spike", "Log spike").when(F.col("kind") == "silence", "Log silence").otherwise("New log template")
    header = F.struct(F.lit("header").alias("type"), plain(shortened(F.concat(titles, F.lit(" in "), "service"), header_max)).alias("text"))
    code = F.concat(F.lit("```"), escaped(F.replace(F.col("template"), F.lit("`"), F.lit("ˋ")), template_max), F.lit("```"))
    section = F.struct(F.lit("section").alias("type"), mark(code).alias("text"))
    per_window = F.lit(" per window")
    baseline, started = field("Baseline", F.concat(baseline_text(), per_window)), rfc3339(F.col("started_at"))
    spike = F.array(field("Count", F.concat(F.col("count").cast("string"), per_window)), baseline, field("Started", started))
    silence = F.array(field("Silent for", F.concat(silent_minutes().cast("string"), F.lit(" min"))), field("Last hit", started), baseline)
    by_kind = F.when(F.col("kind") == "spike", spike).when(F.col("kind") == "silence", silence).otherwise(F.array(field("First seen", started)))
    fields = F.struct(F.lit("section").alias("type"), by_kind.alias("fields"))
    numbered = lambda url, i: button(F.concat(F.lit("trace-"), (i + 1).cast("string")), F.concat(F.lit("Trace "), (i + 1).cast("string")), url)
    buttons = F.concat(F.array(button(F.lit("template"), F.lit("Open template"), template_link(base_url))), F.transform(trace_links(base_url, most_traces), numbered))
    actions = F.struct(F.lit("actions").alias("type"), buttons.alias("elements"))
    text = F.to_json(F.struct(escaped(summary_text(), text_max).alias("text")))
    blocks = F.concat_ws(",", *(F.to_json(b) for b in (header, section, fields, actions)))
    return alerts.select("alert_id", F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"blocks":['), blocks, F.lit("]}")).alias("payload"))


def story_messages(stories: DataFrame) -> DataFrame:
    return stories.select(F.col("fingerprint").alias("key"), F.to_json(F.struct(*stories.columns)).alias("value"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Null fields, such as absent seasonal counts, are left out of the JSON."""
    return alerts.select(F.col("template_id").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))
