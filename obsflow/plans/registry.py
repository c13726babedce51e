"""The registered queries of the telemetry operators on the derived views, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.functions import text as T
from obsflow.operators import alerts as D
from obsflow.operators import baselines as B
from obsflow.operators import critical_path as C
from obsflow.operators import delivery as N
from obsflow.operators import mining as L
from obsflow.operators import tables as M
from obsflow.operators import traces as A
from obsflow.plans import read_queries as Q
from obsflow.operators import stories as ST
from obsflow.operators import trace_trees as TT
from obsflow.sources.checkpoint import cut
from obsflow.sources.fixtures import LOG_END, SPAN_END, logs, spans, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
S = 1_000_000_000
SPANS = Q.Range(SPAN_END - 15000, SPAN_END)
#: All traces, at any size of the tables.
WHOLE = Q.Range(SPAN_END - 15000, SPAN_END + 4_000_000_000)
MINUTE = "CAST((ts_ns - ts_ns % 60000000000) / 1000000000 AS BIGINT)"


def add(name: str, run: Query, sql: str | None = None, *views: str) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = with_views(sql, *views) if views else sql


def flagged(s: SparkSession, d: str) -> DataFrame:
    return A.error_flags(spans(s, d))


def kinds(df: DataFrame, *more: str) -> DataFrame:
    """Maps (and more) as JSON text, so that results compare as values."""
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("map", *more)) else F.col(c) for c, t in df.dtypes))


# tables and sources

MASK = "regexp_replace(regexp_replace(regexp_replace({0}, '\\b[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}\\b', '<*>', 'g'), '\\b(?:0x)?[0-9a-fA-F]{{8,}}\\b', '<*>', 'g'), '\\d+(?:\\.\\d+)?', '<*>', 'g')"

add(
    "M5_log_id", lambda s, d: logs(s, d).select("log_id", T.log_id(F.col("trace_id"), F.col("span_id"), F.col("ts_ns"), F.col("body")).alias("stable_id")),
    "SELECT log_id, substring(md5(trace_id || chr(0) || span_id || chr(0) || ts_ns || chr(0) || body || chr(0)), 1, 16) AS stable_id FROM fx_logs", "fx_logs",
)
add(
    "M6_routing_key", lambda s, d: M.routing_key(logs(s, d)).groupBy("key_kind").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_keys")),
    """SELECT key_kind, count(*) AS n, count(DISTINCT key) AS n_keys FROM (
      SELECT CASE WHEN v THEN 'trace' ELSE 'service' END AS key_kind, CASE WHEN v THEN trace_id ELSE service END AS key
      FROM (SELECT *, regexp_full_match(trace_id, '[0-9a-f]{32}') AND trace_id <> repeat('0', 32) AS v FROM fx_logs)) GROUP BY 1""", "fx_logs",
)
add(
    "M7_drop_oversized", lambda s, d: M.drop_oversized(logs(s, d), 330)[1],
    """SELECT count(*) AS dropped FROM fx_logs WHERE strlen('{"log_id":"' || log_id || '","ts_ns":' || ts_ns || ',"service":"' || service || '","severity_number":' || severity_number || ',"trace_id":"' || trace_id
       || '","span_id":"' || span_id || '","body":"' || body || '"}') > 330""", "fx_logs",
)
add(
    "M11_latest", lambda s, d: M.latest(view(s, d, "fx_summaries"), ["trace_id"], "span_count", "ts_ns"),
    """SELECT trace_id, ts_ns, endpoint_service, endpoint_name, duration_ns, is_error, span_count FROM fx_summaries
       QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY span_count DESC, ts_ns DESC) = 1""", "fx_summaries",
)
add(
    "M12_sum_edges", lambda s, d: M.sum_edges(view(s, d, "fx_edges").unionByName(view(s, d, "fx_edges").where("calls > 1"))),
    """SELECT minute, parent_service, child_service, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(duration_ns_sum) AS BIGINT) AS duration_ns_sum
       FROM (SELECT * FROM fx_edges UNION ALL SELECT * FROM fx_edges WHERE calls > 1) GROUP BY 1, 2, 3""", "fx_edges",
)
add(
    "M13_template_minutes", lambda s, d: M.template_minutes(view(s, d, "fx_hits")).groupBy("template_id", "minute").agg(F.count("*").alias("n")),
    f"SELECT template_id, {MINUTE} AS minute, count(DISTINCT log_id) AS n FROM fx_hits GROUP BY 1, 2", "fx_hits",
)
add(
    "M13_minute_sketches",
    lambda s, d: M.merged_sketches(M.template_minute_sketches(view(s, d, "fx_hits")).unionByName(M.template_minute_sketches(view(s, d, "fx_hits").where("severity_number > 5"))), "template_id", "minute").select("template_id", "minute", F.hll_sketch_estimate("logs").alias("n")),
    f"SELECT template_id, {MINUTE} AS minute, count(DISTINCT log_id) AS n FROM fx_hits GROUP BY 1, 2", "fx_hits",
)
add(
    "M14_backfill_minutes",
    lambda s, d: M.backfill_minutes(view(s, d, "fx_hits"), M.template_minutes(view(s, d, "fx_hits").where(F.col("ts_ns") >= (LOG_END - 3000) * S))).groupBy("template_id").agg(F.count("*").alias("n")),
    "SELECT template_id, count(DISTINCT log_id) AS n FROM fx_hits GROUP BY 1", "fx_hits",
)
add(
    "M15_apply_retention", lambda s, d: M.apply_retention(logs(s, d), "ts_ns", 1, LOG_END + 80000).groupBy("service").agg(F.count("*").alias("n")),
    f"SELECT service, count(*) AS n FROM fx_logs WHERE ts_ns >= {(LOG_END + 80000 - 86400) * S} GROUP BY 1", "fx_logs",
)
TEXTS = {"story_id", "trace_id", "fingerprint", "kind", "endpoint_service", "endpoint_name", "cause_service", "summary", "alert_id", "template_id", "service", "template"}


def as_json(columns: str) -> str:
    """SQL for the JSON text of a row, of values that need no escapes; a null field is left out."""
    one = lambda c: f"""'"{c}":"' || {c} || '"'""" if c in TEXTS else f"""'"{c}":' || {c}"""
    return "'{' || concat_ws(',', " + ", ".join(one(c) for c in columns.split()) + ") || '}'"


add(
    "M19_story_messages", lambda s, d: N.story_messages(view(s, d, "fx_stories")),
    f"SELECT fingerprint AS key, {as_json('story_id trace_id fingerprint kind ts_ns duration_ns endpoint_service endpoint_name cause_service summary span_count')} AS value FROM fx_stories", "fx_stories",
)
add(
    "M20_alert_messages", lambda s, d: N.alert_messages(view(s, d, "fx_alerts").withColumn("baseline_day", F.when(F.col("kind") == "spike", F.col("count")))),
    f"SELECT template_id AS key, {as_json('alert_id kind template_id service template started_at last_at count version baseline_day')} AS value FROM (SELECT *, CASE WHEN kind = 'spike' THEN count END AS baseline_day FROM fx_alerts)", "fx_alerts",
)
add(
    "M21_extract_traces", lambda s, d: M.extract_traces(spans(s, d), True, "svc3", 50).groupBy("trace_id").agg(F.count("*").alias("n")),
    """SELECT trace_id, count(*) AS n FROM fx_spans WHERE trace_id IN (SELECT trace_id FROM fx_spans WHERE status = 'error' INTERSECT SELECT trace_id FROM fx_spans WHERE service = 'svc3' ORDER BY 1 LIMIT 50)
       GROUP BY 1""", "fx_spans",
)
add(
    "M22_compare_span_counts", lambda s, d: M.compare_span_counts(view(s, d, "fx_spans"), view(s, d, "fx_spans").where("span_id not like '%5'"), SPAN_END * S),
    f"""SELECT trace_id, l AS left_spans, r AS right_spans FROM (SELECT trace_id, count(DISTINCT span_id) AS l, count(DISTINCT CASE WHEN span_id NOT LIKE '%5' THEN span_id END) AS r, max(start_ns) AS m
       FROM fx_spans GROUP BY 1) WHERE l <> r AND m <= {(SPAN_END - 60) * S}""", "fx_spans",
)

add(
    "M22_sample", lambda s, d: M.sample_traces(view(s, d, "fx_spans"), 200, SPAN_END * S),
    f"SELECT trace_id FROM fx_spans GROUP BY 1 HAVING max(start_ns) <= {(SPAN_END - 60) * S} ORDER BY md5(trace_id), trace_id LIMIT 200", "fx_spans",
)
add(
    "M22_verify_sample", lambda s, d: M.verify_sample(view(s, d, "fx_spans"), view(s, d, "fx_spans").where("span_id not like '%5'"), 200, SPAN_END * S),
    f"""SELECT trace_id, count(DISTINCT span_id) AS left_spans, count(DISTINCT span_id) FILTER (span_id NOT LIKE '%5') AS right_spans FROM fx_spans
        WHERE trace_id IN (SELECT trace_id FROM fx_spans GROUP BY 1 HAVING max(start_ns) <= {(SPAN_END - 60) * S} ORDER BY md5(trace_id), trace_id LIMIT 200)
        GROUP BY 1 HAVING count(DISTINCT span_id) <> count(DISTINCT span_id) FILTER (span_id NOT LIKE '%5')""", "fx_spans",
)

# trace assembly on stored data

REPLAYED = "SELECT * FROM fx_spans UNION ALL SELECT * FROM fx_spans WHERE CAST(span_id AS BIGINT) % 2 = 0"
add(
    "T1_dedup_spans", lambda s, d: M.dedup_spans(spans(s, d).unionByName(spans(s, d).where("right(span_id, 1) in ('0', '2', '4', '6', '8')")), "start_ns").groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("ns")),
    f"SELECT trace_id, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS ns FROM (SELECT DISTINCT * FROM ({REPLAYED})) GROUP BY 1", "fx_spans",
)
add(
    "T2_dedup_logs", lambda s, d: M.dedup_logs(logs(s, d).unionByName(logs(s, d).where("severity_number = 9"))).groupBy("service").agg(F.count("*").alias("n")),
    "SELECT service, count(*) AS n FROM (SELECT DISTINCT service, trace_id, ts_ns, span_id, body FROM fx_logs) GROUP BY 1", "fx_logs",
)
add(
    "T7_keep_most_complete", lambda s, d: M.keep_most_complete(view(s, d, "fx_summaries")).select("trace_id", "span_count"),
    "SELECT trace_id, max(span_count) AS span_count FROM fx_summaries GROUP BY 1", "fx_summaries",
)

# traces

add(
    "A1_endpoint_name", lambda s, d: spans(s, d).select("span_id", T.endpoint_name(F.col("name"), F.col("attrs")).alias("endpoint")),
    "SELECT span_id, name || CASE WHEN url_path = '' THEN '' ELSE ' /orders/<*>' END AS endpoint FROM fx_spans", "fx_spans",
)
add(
    "A2_normalize_path", lambda s, d: view(s, d, "pages").select("page_id", T.normalize_path(F.col("url")).alias("path")),
    r"""SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, array_to_string(list_transform(string_split(
        regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '^.*?://[^/]*', '', 's'), '/'), lambda x: CASE WHEN strlen(x) > 24 OR regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), '/') AS p FROM pages)""",
)
KNOWN = "SELECT c.*, p.span_id AS parent_id FROM fx_spans c LEFT JOIN fx_spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id AND p.span_id <> c.span_id"
add(
    "A3_span_tree", lambda s, d: A.span_tree(spans(s, d)),
    f"""SELECT trace_id, arg_min(span_id, CASE WHEN parent_id IS NULL THEN start_ns END) AS root_id, count(*) FILTER (parent_id IS NULL) AS n_roots, count(*) AS n_spans,
        bool_or(parent_id IS NULL AND parent_span_id <> '') OR count(*) FILTER (parent_id IS NULL) <> 1 AS incomplete FROM ({KNOWN}) GROUP BY 1""", "fx_spans",
)


def looped(s: SparkSession, d: str) -> DataFrame:
    """Spans of which one trace in ten has its root below its first child."""
    child = F.concat(F.substring("span_id", 1, 15), F.lit("1"))
    return spans(s, d).withColumn("parent_span_id", F.when((F.col("parent_span_id") == "") & (F.substring("trace_id", 32, 1) == "7"), child).otherwise(F.col("parent_span_id")))


add(
    "A4_cut_cycles", lambda s, d: A.cut_cycles(looped(s, d)).where("cut"),
    """SELECT r.trace_id, r.span_id, CAST(NULL AS VARCHAR) AS parent_id, true AS cut FROM fx_spans r JOIN fx_spans c ON c.trace_id = r.trace_id AND c.span_id = substring(r.span_id, 1, 15) || '1'
       WHERE r.parent_span_id = '' AND substring(r.trace_id, 32, 1) = '7' AND c.parent_span_id = r.span_id""", "fx_spans",
)
add(
    "A4_looped_roots", lambda s, d: A.span_tree(looped(s, d).where("substring(trace_id, 32, 1) = '7'")).select("trace_id", "root_id", "incomplete"),
    f"""WITH k AS ({KNOWN}), t AS (SELECT trace_id, arg_min(span_id, start_ns) FILTER (parent_id IS NULL AND parent_span_id <> '') AS orphan, max(span_id) FILTER (parent_span_id = '') AS top,
          bool_or(parent_span_id <> '' AND span_id = substring(span_id, 1, 15) || '1') AS looped FROM k WHERE substring(trace_id, 32, 1) = '7' GROUP BY 1)
        SELECT trace_id, CASE WHEN looped THEN coalesce(orphan, top) ELSE top END AS root_id, true AS incomplete FROM t""", "fx_spans",
)
ROOTS = f"(SELECT trace_id, arg_min(span_id, CASE WHEN parent_id IS NULL THEN start_ns END) AS root_id FROM ({KNOWN}) GROUP BY 1)"
#: Logs at their span, else at the root, which in the fixture is the one span without a parent id.
LOGS_AT = """placed AS MATERIALIZED (SELECT l.log_id, l.trace_id, l.ts_ns, l.body, l.severity_number, coalesce(s.span_id, r.span_id) AS span_id FROM fx_logs l
  JOIN (SELECT trace_id, span_id FROM fx_spans WHERE parent_span_id = '') r ON r.trace_id = l.trace_id LEFT JOIN (SELECT trace_id, span_id FROM fx_spans) s ON s.trace_id = l.trace_id AND s.span_id = l.span_id WHERE l.trace_id <> '')"""
add(
    "A5_attach_logs", lambda s, d: A.attach_logs(spans(s, d), logs(s, d)).select("log_id", "at_span"),
    f"WITH {LOGS_AT} SELECT log_id, span_id AS at_span FROM placed", "fx_spans", "fx_logs",
)
LINKS = f"links AS (SELECT trace_id, span_id, parent_id FROM ({KNOWN}))"
PATHS = "paths AS (SELECT trace_id, span_id, parent_id AS ancestor_id, 1 AS distance FROM links WHERE parent_id IS NOT NULL UNION ALL SELECT p.trace_id, p.span_id, l.parent_id, p.distance + 1 FROM paths p JOIN links l ON l.trace_id = p.trace_id AND l.span_id = p.ancestor_id WHERE l.parent_id IS NOT NULL)"
add(
    "A6_ancestors", lambda s, d: A.ancestors(A.parents(spans(s, d)).select("trace_id", "span_id", "parent_id")),
    f"WITH RECURSIVE {LINKS}, {PATHS} SELECT trace_id, span_id, ancestor_id, distance FROM paths", "fx_spans",
)
ORDERED = "deep AS (SELECT l.trace_id, l.span_id, lpad(CAST(start_ns AS STRING), 20, '0') || l.span_id AS path, 0 AS depth FROM links l JOIN fx_spans USING (trace_id, span_id) WHERE parent_id IS NULL UNION ALL SELECT l.trace_id, l.span_id, d.path || lpad(CAST(f.start_ns AS STRING), 20, '0') || l.span_id, d.depth + 1 FROM deep d JOIN links l ON l.trace_id = d.trace_id AND l.parent_id = d.span_id JOIN fx_spans f ON f.trace_id = l.trace_id AND f.span_id = l.span_id)"
NUMBERED = "numbered AS (SELECT trace_id, span_id, depth, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY path) - 1 AS INTEGER) AS first FROM deep), below AS (SELECT trace_id, ancestor_id AS span_id, count(*) AS n, count(*) FILTER (distance = 1) AS kids FROM paths GROUP BY 1, 2)"
add(
    "A6_nested_intervals", lambda s, d: TT.nested_intervals(spans(s, d)),
    f"""WITH RECURSIVE {LINKS}, {PATHS}, {ORDERED}, {NUMBERED} SELECT trace_id, span_id, parent_id, depth, first, CAST(first + coalesce(n, 0) AS INTEGER) AS last, false AS cut
        FROM numbered JOIN links USING (trace_id, span_id) LEFT JOIN below USING (trace_id, span_id)""", "fx_spans",
)
BAD_LOG = f"(SELECT DISTINCT l.trace_id, coalesce(s.span_id, r.root_id) AS span_id FROM fx_logs l JOIN {ROOTS} r USING (trace_id) LEFT JOIN fx_spans s ON s.trace_id = l.trace_id AND s.span_id = l.span_id WHERE l.severity_number >= 17)"
FLAGGED = f"flagged AS (SELECT f.*, (f.status = 'error' OR b.span_id IS NOT NULL) AS is_error FROM fx_spans f LEFT JOIN {BAD_LOG} b ON b.trace_id = f.trace_id AND b.span_id = f.span_id)"
add(
    "A7_error_flags", lambda s, d: A.error_flags(spans(s, d), logs(s, d)).select("trace_id", "span_id", "is_error"),
    f"""WITH {LOGS_AT}, bad AS MATERIALIZED (SELECT DISTINCT trace_id, span_id FROM placed WHERE severity_number >= 17)
        SELECT f.trace_id, f.span_id, f.status = 'error' OR b.span_id IS NOT NULL AS is_error FROM fx_spans f LEFT JOIN bad b ON b.trace_id = f.trace_id AND b.span_id = f.span_id""", "fx_spans", "fx_logs",
)
LEAVES = f"{LINKS}, {PATHS}, {FLAGGED}, leaves AS (SELECT * FROM flagged f WHERE is_error AND NOT EXISTS (SELECT 1 FROM paths p JOIN flagged g ON g.trace_id = p.trace_id AND g.span_id = p.span_id AND g.is_error WHERE p.trace_id = f.trace_id AND p.ancestor_id = f.span_id))"
add(
    "A8_root_cause", lambda s, d: A.root_causes(A.error_flags(spans(s, d), logs(s, d))).select("trace_id", "cause_id"),
    f"WITH RECURSIVE {LEAVES} SELECT trace_id, arg_min(span_id, (start_ns + duration_ns, start_ns, span_id)) AS cause_id FROM leaves GROUP BY 1", "fx_spans", "fx_logs",
)
add(
    "A9_also_failed", lambda s, d: A.root_causes(A.error_flags(spans(s, d), logs(s, d))).select("trace_id", F.array_join("also_failed", ",").alias("also_failed")),
    f"WITH RECURSIVE {LEAVES} SELECT trace_id, array_to_string(list(span_id ORDER BY start_ns + duration_ns, start_ns, span_id)[2:], ',') AS also_failed FROM leaves GROUP BY 1", "fx_spans", "fx_logs",
)
FIRST_LOG = f"(SELECT trace_id, at_span AS span_id, arg_min(body, (ts_ns, log_id)) AS body FROM (SELECT l.*, coalesce(s.span_id, r.root_id) AS at_span FROM fx_logs l JOIN {ROOTS} r USING (trace_id) LEFT JOIN fx_spans s ON s.trace_id = l.trace_id AND s.span_id = l.span_id WHERE l.severity_number >= 17) GROUP BY 1, 2)"
MESSAGES = f"told AS (SELECT f.*, coalesce(nullif(f.status_message, ''), b.body, 'error') AS message FROM fx_spans f LEFT JOIN {FIRST_LOG} b ON b.trace_id = f.trace_id AND b.span_id = f.span_id)"
add(
    "A10_error_message", lambda s, d: A.error_messages(spans(s, d), logs(s, d)).select("trace_id", "span_id", "message", "exception_type"),
    f"""WITH {LOGS_AT}, said AS MATERIALIZED (SELECT trace_id, span_id, arg_min(body, (ts_ns, log_id)) AS body FROM placed WHERE severity_number >= 17 GROUP BY 1, 2)
        SELECT f.trace_id, f.span_id, CASE WHEN f.status_message <> '' THEN f.status_message ELSE coalesce(b.body, 'error') END AS message, '' AS exception_type
        FROM fx_spans f LEFT JOIN said b ON b.trace_id = f.trace_id AND b.span_id = f.span_id""", "fx_spans", "fx_logs",
)
add(
    "A11_peer_of", lambda s, d: spans(s, d).select("span_id", T.peer_of(F.col("attrs")).alias("peer"), T.operation_of(F.col("name"), F.col("attrs")).alias("operation")),
    "SELECT span_id, CASE WHEN peer = '' THEN 'an unknown peer' ELSE peer END AS peer, name AS operation FROM fx_spans", "fx_spans",
)
add(
    "A11_url_host", lambda s, d: view(s, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host")),
    "SELECT page_id, nullif(regexp_extract(url, '^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') AS host FROM pages",
)
EXPLAINED = f"{MESSAGES}, kids AS (SELECT trace_id, parent_span_id AS span_id, count(*) AS n FROM fx_spans WHERE parent_span_id <> '' GROUP BY 1, 2), said AS (SELECT t.*, CASE WHEN kind = 'client' AND k.n IS NULL THEN service || ' could not reach ' || peer || ' (' || name || '): ' || message ELSE service || ' ' || name || ' failed: ' || message END AS summary FROM told t LEFT JOIN kids k ON k.trace_id = t.trace_id AND k.span_id = t.span_id)"
add(
    "A12_explain", lambda s, d: A.explain(A.with_children(A.error_messages(spans(s, d), logs(s, d)))).select("trace_id", "span_id", "summary"),
    f"WITH {EXPLAINED} SELECT trace_id, span_id, summary FROM said", "fx_spans", "fx_logs",
)
add("A13_critical_path", lambda s, d: C.critical_path(spans(s, d)))
add("A14_self_time", lambda s, d: C.top_contributors(C.critical_path(spans(s, d))))
add(
    "A15_trace_summary", lambda s, d: kinds(A.trace_summaries(flagged(s, d))).drop("op_durations"),
    f"""SELECT s.trace_id, r.start_ns AS ts_ns, r.service AS endpoint_service, r.name || CASE WHEN r.url_path = '' THEN '' ELSE ' /orders/<*>' END AS endpoint_name, r.duration_ns, s.is_error, s.span_count
        FROM (SELECT trace_id, bool_or(status = 'error') AS is_error, count(*) AS span_count FROM fx_spans GROUP BY 1) s JOIN {ROOTS} k USING (trace_id) JOIN fx_spans r ON r.trace_id = s.trace_id AND r.span_id = k.root_id""", "fx_spans",
)
add(
    "A15_op_durations", lambda s, d: A.trace_summaries(flagged(s, d)).select("trace_id", F.explode("op_durations").alias("op", "ns")),
    "SELECT trace_id, service || ':' || name AS op, max(duration_ns) AS ns FROM fx_spans GROUP BY 1, 2", "fx_spans",
)
add("A16_service_edges", lambda s, d: A.service_edges(flagged(s, d)), "SELECT * FROM fx_edges", "fx_edges")


def kept(s: SparkSession, d: str, summaries: DataFrame | None = None) -> DataFrame:
    summaries = summaries or cut(A.trace_summaries(flagged(s, d)))  # read three times
    slow = summaries.where("duration_ns >= 4500000000").select("trace_id")
    caps = s.createDataFrame([("frontend", "order p /orders/<*>", 300_000_000)], "endpoint_service string, endpoint_name string, cap long")
    return B.kept_summaries(summaries, slow, caps, WHOLE.start * S, WHOLE.end * S)


SUMS = f"sums AS (SELECT s.trace_id, r.start_ns AS ts_ns, 'frontend' AS endpoint_service, r.name || ' /orders/<*>' AS endpoint_name, r.duration_ns, s.is_error FROM (SELECT trace_id, bool_or(status = 'error') AS is_error FROM fx_spans GROUP BY 1) s JOIN fx_spans r ON r.trace_id = s.trace_id AND r.parent_span_id = '')"
KEPT = f"""{SUMS}, own AS (SELECT *, duration_ns >= 4500000000 AS slow FROM sums WHERE NOT is_error AND ts_ns >= {WHOLE.start * S} AND ts_ns < {WHOLE.end * S}),
  boot AS (SELECT endpoint_name, CAST(ceil(10 * quantile_cont(duration_ns, 0.5)) AS BIGINT) AS boot FROM own WHERE NOT slow GROUP BY 1),
  kept AS (SELECT o.*, NOT slow AND duration_ns <= coalesce(CASE WHEN o.endpoint_name = 'order p /orders/<*>' THEN 300000000 END, boot, 0) AS kept FROM own o LEFT JOIN boot b USING (endpoint_name))"""
STATS = "SELECT endpoint_service, endpoint_name, count(*) AS seen, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS excluded, quantile_cont(duration_ns, 0.5) FILTER (kept) AS p50, quantile_cont(duration_ns, 0.95) FILTER (kept) AS p95, quantile_cont(duration_ns, 0.99) FILTER (kept) AS p99 FROM kept GROUP BY 1, 2"
ROUNDED = "round(p50, 3) AS p50, round(p95, 3) AS p95, round(p99, 3) AS p99"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c in columns})


add("A17_endpoint_stats", lambda s, d: rounded(B.endpoint_stats(kept(s, d)), "p50", "p95", "p99"), f"WITH {KEPT} SELECT endpoint_service, endpoint_name, seen, kept, excluded, {ROUNDED} FROM ({STATS})", "fx_spans")
add(
    "A18_bootstrap_cap", lambda s, d: kept(s, d).groupBy("endpoint_service", "endpoint_name").agg(F.max("cap").alias("cap")),
    f"WITH {KEPT} SELECT endpoint_service, endpoint_name, max(coalesce(CASE WHEN k.endpoint_name = 'order p /orders/<*>' THEN 300000000 END, boot)) AS cap FROM kept k JOIN boot USING (endpoint_name) GROUP BY 1, 2", "fx_spans",
)
OPS = "ops AS (SELECT trace_id, service || ':' || name AS op, max(duration_ns) AS ns FROM fx_spans GROUP BY 1, 2)"
add(
    "A19_op_stats", lambda s, d: rounded(B.op_stats(kept(s, d)), "p95"),
    f"WITH {KEPT}, {OPS} SELECT endpoint_service, endpoint_name, op, count(*) AS present, round(quantile_cont(ns, 0.95), 3) AS p95 FROM kept JOIN ops USING (trace_id) WHERE kept GROUP BY 1, 2, 3", "fx_spans",
)
HOUR = "ts_ns - ts_ns % 3600000000000"
add(
    "A17_endpoint_sketches",
    lambda s, d: B.merged_endpoint_stats(B.endpoint_sketches(kept(s, d)), 0, WHOLE.end * S).select("endpoint_service", "endpoint_name", "seen", "kept", "excluded"),
    f"WITH {KEPT} SELECT endpoint_service, endpoint_name, count(*) AS seen, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS excluded FROM kept GROUP BY 1, 2", "fx_spans",
)
add("A17_sketched_quantiles", lambda s, d: B.merged_endpoint_stats(B.endpoint_sketches(kept(s, d)), 0, WHOLE.end * S))
add("A19_sketched_quantiles", lambda s, d: B.merged_op_stats(B.op_sketches(kept(s, d)), 0, WHOLE.end * S))
STAT = f"stat AS ({STATS})"
PREVIOUS = [("frontend", "order o /orders/<*>", 80, 2e8, 3e8, 4e8), ("frontend", "order p /orders/<*>", 10, 2e8, 3e8, 4e8), ("frontend", "order f /orders/<*>", 60, 2e8, 3e8, float("nan"))]


def previous(s: SparkSession) -> DataFrame:
    return s.createDataFrame(PREVIOUS, "endpoint_service string, endpoint_name string, traces long, p50 double, p95 double, p99 double")


add(
    "A20_caps_from", lambda s, d: B.caps_from(B.endpoint_stats(kept(s, d)).withColumnRenamed("kept", "traces")),
    f"WITH {KEPT}, {STAT} SELECT endpoint_service, endpoint_name, CAST(ceil(greatest(p99 * 1.5, p99 + 100000000)) AS BIGINT) AS cap FROM stat WHERE kept >= 50 AND p99 > 0", "fx_spans",
)


def refreshed(s: SparkSession, d: str) -> DataFrame:
    no_ops = s.createDataFrame([], "endpoint_service string, endpoint_name string, op string, presence double, p95 double")
    carried = s.createDataFrame([], "endpoint_service string, endpoint_name string, since long")
    k = cut(kept(s, d))
    few = B.endpoint_stats(k).withColumn("kept", F.when(F.col("endpoint_name").startswith("order o"), F.lit(3).cast("long")).otherwise(F.col("kept")))
    return B.refresh_baselines(few, B.op_stats(k), previous(s), no_ops, carried, SPAN_END, 1440)[0]


OLD = "old AS (SELECT * FROM (VALUES ('order o /orders/<*>', 80, 2e8, 3e8, 4e8), ('order p /orders/<*>', 10, 2e8, 3e8, 4e8), ('order f /orders/<*>', 60, 2e8, 3e8, 'nan'::DOUBLE)) AS v(endpoint_name, old_traces, old_p50, old_p95, old_p99))"
add(
    "A21_refresh_baselines", lambda s, d: rounded(refreshed(s, d), "p50", "p95", "p99"),
    f"""WITH {KEPT}, {STAT}, {OLD}, few AS (SELECT * REPLACE (CASE WHEN endpoint_name LIKE 'order o%' THEN 3 ELSE kept END AS kept) FROM stat),
      j AS (SELECT *, kept < 50 AND coalesce(old_traces, 0) >= 50 AS carry FROM few LEFT JOIN old USING (endpoint_name))
      SELECT endpoint_service, endpoint_name, CASE WHEN carry THEN old_traces ELSE kept END AS traces, round(CASE WHEN carry THEN old_p50 ELSE p50 END, 3) AS p50, round(CASE WHEN carry THEN old_p95 ELSE p95 END, 3) AS p95,
        round(CASE WHEN carry THEN old_p99 ELSE p99 END, 3) AS p99, CASE WHEN carry THEN {SPAN_END} END AS carried_since FROM j WHERE carry OR (kept > 0 AND p50 IS NOT NULL)""", "fx_spans",
)
add(
    "A22_offline_baselines", lambda s, d: B.baselines_from_summaries(A.trace_summaries(flagged(s, d))),
    f"WITH {SUMS} SELECT endpoint_service, endpoint_name, count(*) AS traces, quantile_disc(duration_ns, 0.5) AS p50, quantile_disc(duration_ns, 0.95) AS p95, quantile_disc(duration_ns, 0.99) AS p99 FROM sums WHERE NOT is_error GROUP BY 1, 2", "fx_spans",
)
add(
    "A22_offline_op_stats", lambda s, d: B.offline_op_stats(A.trace_summaries(flagged(s, d))),
    f"""WITH {SUMS}, {OPS}, n AS (SELECT endpoint_service, endpoint_name, count(*) AS traces FROM sums WHERE NOT is_error GROUP BY 1, 2)
        SELECT endpoint_service, endpoint_name, op, any_value(count_all) / any_value(traces) AS presence, CAST(any_value(p95) AS BIGINT) AS p95 FROM (
          SELECT endpoint_service, endpoint_name, op, count(*) AS count_all, quantile_disc(ns, 0.95) AS p95 FROM sums JOIN ops USING (trace_id) WHERE NOT is_error GROUP BY 1, 2, 3) JOIN n USING (endpoint_service, endpoint_name) GROUP BY 1, 2, 3""", "fx_spans",
)
OFFLINE = "base AS (SELECT endpoint_name, count(*) AS traces, quantile_disc(duration_ns, 0.5) AS p99 FROM sums WHERE NOT is_error GROUP BY 1)"
def slow(s: SparkSession, d: str) -> DataFrame:
    summaries = cut(A.trace_summaries(flagged(s, d)))
    return B.slow_traces(summaries, B.baselines_from_summaries(summaries).withColumn("p99", F.col("p50"))).select("trace_id", "duration_ns")


add(
    "A23_slow_traces", slow,
    f"WITH {SUMS}, {OFFLINE} SELECT trace_id, duration_ns FROM sums JOIN base USING (endpoint_name) WHERE NOT is_error AND traces >= 50 AND duration_ns > greatest(p99 * 1.5, p99 + 100000000)", "fx_spans",
)


def differences(s: SparkSession, d: str) -> DataFrame:
    summaries = cut(A.trace_summaries(flagged(s, d)))
    k = cut(kept(s, d, summaries))
    baselines, ops = B.endpoint_stats(k).withColumnRenamed("kept", "traces"), B.op_stats(k)
    shares = ops.join(baselines.select("endpoint_service", "endpoint_name", "traces"), ["endpoint_service", "endpoint_name"]).withColumn("presence", F.col("present") / F.col("traces"))
    found = B.baseline_diff(summaries.where("is_error"), baselines, shares)
    return found.select("trace_id", *(F.array_join(c, ",").alias(c) for c in ("new_ops", "missing_ops", "slower_ops")))


add(
    "A24_baseline_diff", differences,
    f"""WITH {KEPT}, {OPS}, {STAT}, os AS (SELECT endpoint_name, op, count(*) AS present, quantile_cont(ns, 0.95) AS p95 FROM kept JOIN ops USING (trace_id) WHERE kept GROUP BY 1, 2),
      b AS (SELECT endpoint_name, op, present / kept AS presence, os.p95 FROM os JOIN stat USING (endpoint_name) WHERE kept >= 50), t AS (SELECT trace_id, endpoint_name FROM sums JOIN stat USING (endpoint_name) WHERE is_error AND kept >= 50),
      x AS (SELECT coalesce(h.trace_id, e.trace_id) AS trace_id, coalesce(h.op, e.op) AS op, h.ns, e.presence, e.p95 FROM (SELECT t.*, ops.op, ops.ns FROM t JOIN ops USING (trace_id)) h
        FULL JOIN (SELECT t.trace_id, b.* FROM t JOIN b USING (endpoint_name)) e ON h.trace_id = e.trace_id AND h.op = e.op)
      SELECT trace_id, coalesce(array_to_string(list(op ORDER BY op) FILTER (ns IS NOT NULL AND coalesce(presence, 0) < 0.01), ','), '') AS new_ops,
        coalesce(array_to_string(list(op ORDER BY op) FILTER (ns IS NULL AND presence > 0.95), ','), '') AS missing_ops,
        coalesce(array_to_string(list(op ORDER BY op) FILTER (coalesce(presence, 0) >= 0.01 AND ns > greatest(p95 * 2, p95 + 50000000)), ','), '') AS slower_ops FROM x GROUP BY 1""", "fx_spans",
)


def story_baselines(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    summaries = cut(A.trace_summaries(flagged(s, d)))
    return B.baselines_from_summaries(summaries).withColumn("p99", F.col("p50")), B.offline_op_stats(summaries)


add(
    "A25_error_stories",
    lambda s, d: ST.error_stories(spans(s, d), logs(s, d)).select("story_id", "kind", "cause_id", "message", "summary", "fingerprint", F.array_join("path_services", ">").alias("path"), F.array_join("path_spans.span_id", ">").alias("path_spans"), F.size("logs").alias("n_logs"), F.array_join("flags", ",").alias("flags")),
    f"""WITH RECURSIVE {LEAVES}, {EXPLAINED}, cause AS (SELECT trace_id, arg_min(span_id, (start_ns + duration_ns, start_ns, span_id)) AS span_id FROM leaves GROUP BY 1),
      steps AS (SELECT p.trace_id, p.ancestor_id AS span_id, distance FROM paths p JOIN cause USING (trace_id, span_id) UNION ALL SELECT trace_id, span_id, 0 FROM cause),
      path AS (SELECT trace_id, array_to_string(list(span_id ORDER BY distance DESC), '>') AS path_spans, array_to_string(list(service ORDER BY distance DESC) FILTER (new), '>') AS path
        FROM (SELECT t.*, s.service, coalesce(s.service <> lag(s.service) OVER (PARTITION BY t.trace_id ORDER BY distance DESC), true) AS new FROM steps t JOIN fx_spans s USING (trace_id, span_id)) GROUP BY 1),
      whole AS (SELECT trace_id, bool_or(parent_id IS NULL AND parent_span_id <> '') OR count(*) FILTER (parent_id IS NULL) <> 1 AS incomplete FROM ({KNOWN}) GROUP BY 1),
      n AS (SELECT trace_id, count(*) AS n FROM fx_logs GROUP BY 1)
      SELECT c.trace_id AS story_id, 'error' AS kind, c.span_id AS cause_id, s.message, s.summary, path, path_spans, CAST(least(50, coalesce(n, 0)) AS INTEGER) AS n_logs, CASE WHEN incomplete THEN 'incomplete' ELSE '' END AS flags,
        substring(md5('error' || chr(0) || 'frontend' || chr(0) || r.name || ' /orders/<*>' || chr(0) || s.service || chr(0) || s.name || chr(0) || {MASK.format('s.message')} || chr(0)), 1, 16) AS fingerprint
      FROM cause c JOIN said s USING (trace_id, span_id) JOIN path USING (trace_id) JOIN whole USING (trace_id) JOIN fx_spans r ON r.trace_id = c.trace_id AND r.parent_span_id = '' LEFT JOIN n ON n.trace_id = c.trace_id""",
    "fx_spans", "fx_logs",
)
add("A25_slow_stories", lambda s, d: ST.slow_stories(spans(s, d), logs(s, d), *story_baselines(s, d)).select("story_id", "cause_id", "summary", "fingerprint"))
add("A25_stories", lambda s, d: kinds(ST.stories(spans(s, d), logs(s, d), *story_baselines(s, d)), "array", "struct"))
add("A26_mask", lambda s, d: logs(s, d).select("log_id", T.mask(F.col("body")).alias("masked")), f"SELECT log_id, {MASK.format('body')} AS masked FROM fx_logs", "fx_logs")
add(
    "A27_story_fingerprint", lambda s, d: spans(s, d).where("status = 'error'").select("span_id", T.short_hash(F.lit("error"), F.col("service"), F.col("name"), T.mask(F.col("status_message"))).alias("fingerprint")),
    f"SELECT span_id, substring(md5('error' || chr(0) || service || chr(0) || name || chr(0) || {MASK.format('status_message')} || chr(0)), 1, 16) AS fingerprint FROM fx_spans WHERE status = 'error'", "fx_spans",
)
SELF = f"""ins AS (SELECT c.trace_id, c.parent_id, greatest(c.start_ns, p.start_ns) AS s, least(c.start_ns + c.duration_ns, p.start_ns + p.duration_ns) AS e FROM ({KNOWN}) c JOIN fx_spans p ON p.trace_id = c.trace_id AND p.span_id = c.parent_id),
  seen AS (SELECT *, max(e) OVER (PARTITION BY trace_id, parent_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ins WHERE e > s),
  cov AS (SELECT trace_id, parent_id AS span_id, CAST(sum(greatest(0, e - greatest(s, coalesce(m, s)))) AS BIGINT) AS c FROM seen GROUP BY 1, 2)"""
add(
    "A28_span_self_ns", lambda s, d: A.span_self_ns(spans(s, d)).select("trace_id", "span_id", "self_ns"),
    f"WITH {SELF} SELECT f.trace_id, f.span_id, f.duration_ns - coalesce(c, 0) AS self_ns FROM fx_spans f LEFT JOIN cov USING (trace_id, span_id)", "fx_spans",
)
add("A29_critical_spans", lambda s, d: C.critical_spans(spans(s, d)))

# log templates

TOKENS = f"list_transform(list_filter(string_split_regex(body, '[ \\t\\n\\f\\r]+'), lambda t: t <> ''), lambda t: CASE WHEN contains({MASK.format('t')}, '<*>') THEN '<*>' ELSE t END)"
add(
    "L1_log_tokens", lambda s, d: logs(s, d).select("log_id", F.array_join(T.log_tokens(F.col("body"), False), " ").alias("tokens")),
    f"SELECT log_id, array_to_string({TOKENS}, ' ') AS tokens FROM fx_logs", "fx_logs",
)
add(
    "L2_http_status", lambda s, d: logs(s, d).select("log_id", F.array_join(T.log_tokens(F.col("body")), " ").alias("tokens")),
    f"SELECT log_id, CASE WHEN body LIKE 'GET %' THEN 'GET <*> <*> ' || string_split(body, ' ')[4] || ' ok' ELSE array_to_string({TOKENS}, ' ') END AS tokens FROM fx_logs", "fx_logs",
)
SEQUENCES = f"seq AS (SELECT *, CASE WHEN body LIKE 'GET %' THEN 'GET <*> <*> ' || string_split(body, ' ')[4] || ' ok' ELSE array_to_string({TOKENS}, ' ') END AS tokens FROM fx_logs)"
add(
    "L3_distinct_sequences", lambda s, d: L.distinct_sequences(logs(s, d)).withColumn("tokens", F.array_join("tokens", " ")),
    f"WITH {SEQUENCES} SELECT service, tokens, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) AS lines, max(severity_number) AS max_severity, arg_min(body, ts_ns) AS sample FROM seq GROUP BY 1, 2", "fx_logs",
)
add("L4_drain_templates", lambda s, d: L.drain_templates(logs(s, d)).select("service", "template_id", "template").distinct())
add("L5_template_id", lambda s, d: L.drain_templates(logs(s, d)).select("service", "initial", "template_id").distinct())
add("L6_overflow", lambda s, d: L.template_hits(logs(s, d), L.drain_templates(logs(s, d), L.Config(max_clusters=3)), L.Config(max_clusters=3)).groupBy("service", "template_id").agg(F.count("*").alias("n")))
add(
    "L7_template_stats", lambda s, d: L.template_stats(view(s, d, "fx_hits"), logs(s, d)),
    "SELECT h.template_id, h.service, count(*) AS lines, min(h.ts_ns) AS first_seen, max(h.ts_ns) AS last_seen, max(h.severity_number) AS max_severity, arg_min(l.body, h.ts_ns) AS sample FROM fx_hits h JOIN fx_logs l USING (log_id) GROUP BY 1, 2", "fx_hits",
)
add("L8_template_hits", lambda s, d: L.template_hits(logs(s, d), L.drain_templates(logs(s, d))).groupBy("template_id").agg(F.count("*").alias("n")))


def in_two_runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows that two runs leave, the second from those of the first, and the logs of the second."""
    old, new = (logs(s, d).where(c) for c in (F.col("ts_ns") < (LOG_END - 5000) * S, F.col("ts_ns") >= (LOG_END - 5000) * S))
    first = L.mine(old)
    return first.unionByName(L.mine(new, state=first)), new


add("L9_restore_templates", lambda s, d: L.restored_templates(in_two_runs(s, d)[0]))
add("L9_hits_after_restore", lambda s, d: L.template_hits(in_two_runs(s, d)[1], L.assignments(in_two_runs(s, d)[0])).select("log_id", "template_id"))


def split_off(s: SparkSession, d: str) -> DataFrame:
    sequences = L.distinct_sequences(logs(s, d)).select("service", "tokens")
    old = sequences.select("service", F.transform("tokens", lambda t: F.when(t.rlike("^[1-5][0-9]{2}$"), "<*>").otherwise(t)).alias("tokens")).where("tokens[0] <> 'signup'")
    fresh = sequences.withColumn("template_id", T.short_hash(F.col("service"), F.array_join("tokens", " ")))
    return L.suppress_pre_epoch(fresh, old).select("service", F.array_join("tokens", " ").alias("template"))


add(
    "L11_suppress_pre_epoch", split_off,
    f"WITH {SEQUENCES} SELECT DISTINCT service, tokens AS template FROM seq WHERE tokens NOT LIKE 'GET %'", "fx_logs",
)
add(
    "L12_masking_epoch",
    lambda s, d: D.masking_epoch(view(s, d, "nation").select((F.col("n_nationkey") % 3).alias("masking_version"), (F.col("n_nationkey") * 100).alias("epoch_start"), (F.col("n_nationkey") % 2 == 0).alias("has_templates"), "n_nationkey"), 2, F.lit(LOG_END)).select("n_nationkey", F.col("epoch_ns").cast("long").alias("epoch")),
    f"SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey * 100 WHEN n_nationkey % 2 = 0 THEN {LOG_END} ELSE 0 END AS BIGINT) AS epoch FROM nation",
)
add(
    "L13_remine",
    lambda s, d: L.remine(logs(s, d).unionByName(logs(s, d).where("severity_number = 5")), L.drain_templates(logs(s, d).where(F.col("ts_ns") < (LOG_END - 5000) * S)), s.createDataFrame([("gone",)], "template_id string"), 0, LOG_END * S)[0],
)
