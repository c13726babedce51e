"""Telemetry views derived from the star-schema tables, as SQL that Spark and DuckDB both read.

Spans come from orders and their lines, logs and metrics from events, offsets from nations and delivery attempts from
customers. Values are integers or text, so results compare exactly.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The end of the windows that queries use: seconds for logs, seconds for spans.
LOG_END, SPAN_END = 1704067200 + 10000, 1704067200 + 15000

VIEWS = {
    "fx_spans": """
WITH li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM lineitem)
SELECT lpad(CAST(o_orderkey AS STRING), 32, '0') AS trace_id,
  lpad(CAST(o_orderkey * 100 AS STRING), 16, '0') AS span_id, '' AS parent_span_id,
  'frontend' AS service, 'order ' || lower(o_orderstatus) AS name, 'server' AS kind,
  1704067200000000000 + o_orderkey * 1000000000 AS start_ns,
  (CAST(round(o_totalprice) AS BIGINT) % 400 + 100) * 1000000
    * (CASE WHEN o_orderkey % 97 = 0 THEN 10 ELSE 1 END) AS duration_ns,
  'unset' AS status, '' AS status_message,
  '/orders/' || CAST(o_orderkey AS STRING) || '?v=1' AS url_path, '' AS peer
FROM orders
UNION ALL
SELECT lpad(CAST(l_orderkey AS STRING), 32, '0'),
  lpad(CAST(l_orderkey * 100 + rn AS STRING), 16, '0'),
  lpad(CAST(l_orderkey * 100 + (CASE WHEN l_linenumber = 7 AND rn > 1 THEN 99
    ELSE CAST(floor(rn / 2) AS BIGINT) END) AS STRING), 16, '0'),
  'svc' || CAST(l_suppkey % 8 AS STRING), 'op' || CAST(l_partkey % 6 AS STRING),
  CASE rn % 3 WHEN 0 THEN 'client' WHEN 1 THEN 'server' ELSE 'internal' END,
  1704067200000000000 + l_orderkey * 1000000000 + rn * 15000000,
  CAST(l_quantity AS BIGINT) * 2000000,
  CASE WHEN l_returnflag = 'R' AND CAST(round(l_discount * 100) AS BIGINT) >= 8 THEN 'error' ELSE 'ok' END,
  CASE WHEN l_returnflag = 'R' AND CAST(round(l_discount * 100) AS BIGINT) >= 8
    THEN 'part ' || CAST(l_partkey AS STRING) || ' refused by supplier ' || CAST(l_suppkey AS STRING) ELSE '' END,
  '', 'svc' || CAST((l_suppkey + 1) % 8 AS STRING)
FROM li
""",
    "fx_logs": """
SELECT substring(md5('log' || CAST(event_id AS STRING)), 1, 16) AS log_id,
  1704067200000000000 + event_id * 1000000000 AS ts_ns,
  'svc' || CAST(user_id % 8 AS STRING) AS service,
  CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'view' THEN 5 ELSE 9 END AS severity_number,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE lpad(CAST(event_id % 10000 + 1 AS STRING), 32, '0') END AS trace_id,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE lpad(CAST((event_id % 10000 + 1) * 100 + event_id % 4 AS STRING), 16, '0') END AS span_id,
  CASE event_type
    WHEN 'error' THEN 'user ' || CAST(user_id AS STRING) || ' failed with code ' || CAST(event_id % 7 AS STRING)
    WHEN 'click' THEN 'GET /item/' || CAST(user_id AS STRING) || ' HTTP/1.1 ' || CAST(200 + (event_id % 3) * 100 AS STRING) || ' ok'
    WHEN 'view' THEN 'rendered page in ' || CAST(event_id % 900 AS STRING) || ' ms for ' || lower(substring(md5(CAST(event_id AS STRING)), 1, 12))
    WHEN 'purchase' THEN 'order placed'
    ELSE 'signup ' || event_type || ' user=' || CAST(user_id AS STRING) END AS body
FROM events
""",
    "fx_hits": """
SELECT log_id, substring(md5(service || '|' || substring(body, 1, 5)), 1, 16) AS template_id, service, ts_ns,
  severity_number, trace_id, span_id
FROM fx_logs
""",
    "fx_metrics": """
SELECT 1704067200000 + event_id * 15000 AS ts_ms, 'job' || CAST(user_id % 2 AS STRING) AS job,
  event_type AS metric, 'i' || CAST(user_id % 3 AS STRING) AS instance,
  CAST((sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id % 2, event_type, user_id % 3
     ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) % 100000 AS BIGINT) AS value
FROM events
""",
    "fx_offsets": """
SELECT 'g' || CAST(n_regionkey % 3 AS STRING) AS grp, 'topic' || CAST(n_regionkey % 2 AS STRING) AS topic, n_nationkey AS part,
  CASE WHEN n_nationkey % 5 = 0 THEN -1 ELSE n_nationkey * 100 END AS committed,
  n_nationkey * 100 + n_regionkey * 10 - 5 AS high FROM nation
""",
    "fx_attempts": """
SELECT substring(md5('a' || CAST(c_custkey % 200 AS STRING)), 1, 16) AS alert_id, 't' || CAST(c_custkey % 3 AS STRING) AS target,
  CAST(row_number() OVER (PARTITION BY c_custkey % 200, c_custkey % 3 ORDER BY c_custkey) AS BIGINT) AS attempt,
  1704067200000000000 + c_custkey * 1000000000 AS at_ns,
  CASE c_custkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 500 WHEN 2 THEN 429 WHEN 3 THEN 404 WHEN 4 THEN NULL ELSE 204 END AS http_status,
  CASE WHEN c_custkey % 6 = 2 THEN CAST(c_custkey % 40 AS STRING) END AS retry_after FROM customer
""",
    "fx_edges": """
SELECT CAST((r.start_ns - r.start_ns % 60000000000) / 1000000000 AS BIGINT) AS minute, p.service AS parent_service, c.service AS child_service,
  CAST(count(*) AS BIGINT) AS calls, CAST(sum(CASE WHEN c.status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(c.duration_ns) AS BIGINT) AS duration_ns_sum
FROM fx_spans c JOIN fx_spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id JOIN fx_spans r ON r.trace_id = c.trace_id AND r.parent_span_id = ''
WHERE c.service <> p.service GROUP BY 1, 2, 3
""",
    "fx_summaries": """
SELECT v.trace_id, v.ts_ns, v.endpoint_service, v.endpoint_name, v.duration_ns, v.is_error, v.span_count
FROM (
  SELECT r.trace_id, r.start_ns AS ts_ns, r.service AS endpoint_service, r.name || ' /orders/<*>' AS endpoint_name, r.duration_ns, a.is_error, a.span_count
  FROM fx_spans r JOIN (
    SELECT trace_id, max(CASE WHEN status = 'error' THEN 1 ELSE 0 END) = 1 AS is_error, CAST(count(*) AS BIGINT) AS span_count FROM fx_spans GROUP BY trace_id
  ) a ON r.trace_id = a.trace_id WHERE r.parent_span_id = ''
  UNION ALL
  SELECT trace_id, start_ns + 1, service, name || ' /orders/<*>', duration_ns - 1000000, false, CAST(0 AS BIGINT) FROM fx_spans
  WHERE parent_span_id = '' AND CAST(substring(trace_id, 24, 9) AS BIGINT) % 2 = 0
) v
""",
    "fx_stories": """
SELECT s.trace_id AS story_id, s.trace_id, substring(md5(s.kind || '|' || s.endpoint_name || '|' || s.cause_service), 1, 16) AS fingerprint, s.kind, s.ts_ns, s.duration_ns,
  s.endpoint_service, s.endpoint_name, s.cause_service, s.kind || ' in ' || s.cause_service || ': ' || s.endpoint_name AS summary, s.span_count
FROM (
  SELECT b.trace_id, b.ts_ns, b.duration_ns, b.endpoint_service, b.endpoint_name, b.span_count, CASE WHEN b.is_error THEN 'error' ELSE 'slow' END AS kind,
    coalesce(e.cause_service, 'frontend') AS cause_service
  FROM fx_summaries b LEFT JOIN (SELECT trace_id, min(service) AS cause_service FROM fx_spans WHERE status = 'error' GROUP BY trace_id) e ON b.trace_id = e.trace_id
  WHERE b.is_error OR b.duration_ns >= 4500000000
) s
""",
    "fx_templates": """
SELECT template_id, service, min(ts_ns) AS first_seen, max(ts_ns) AS last_seen, CAST(count(*) AS BIGINT) AS lines, max(severity_number) AS max_severity, 'template ' || template_id AS template
FROM fx_hits GROUP BY template_id, service
""",
    "fx_alerts": """
SELECT substring(md5(k.kind || template_id), 1, 16) AS alert_id, k.kind, template_id, service, template, CAST((first_seen - first_seen % 1000000000) / 1000000000 AS BIGINT) + k.late AS started_at,
  CAST((first_seen - first_seen % 1000000000) / 1000000000 AS BIGINT) + k.late + k.long AS last_at, lines % 50 + 10 AS count, k.version
FROM fx_templates t JOIN (
  SELECT 'spike' AS kind, 1200 AS late, 900 AS long, CAST(1 AS BIGINT) AS version UNION ALL SELECT 'spike', 1200, 1500, CAST(2 AS BIGINT) UNION ALL SELECT 'new', 0, 0, CAST(1 AS BIGINT) UNION ALL SELECT 'silence', 6000, 3000, CAST(1 AS BIGINT)
) k ON (k.kind <> 'new' OR lines % 2 = 0)
""",
}
USES = {"fx_spans": ["orders", "lineitem"], "fx_logs": ["events"], "fx_hits": ["fx_logs"], "fx_metrics": ["events"], "fx_offsets": ["nation"], "fx_attempts": ["customer"],
        "fx_edges": ["fx_spans"], "fx_summaries": ["fx_spans"], "fx_stories": ["fx_summaries", "fx_spans"], "fx_templates": ["fx_hits"], "fx_alerts": ["fx_templates"]}


def store_views(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the views of the tables in sf_dir as tables of their own, which view() then reads in their place."""
    for name in VIEWS:
        view(spark, sf_dir, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@cache
def _is_stored(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view (a stored one where the folder has it), or a table by its name."""
    if name not in VIEWS or _is_stored(spark, f"{sf_dir}/{name}.parquet"):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for used in USES[name]:
        text = text.replace(f"FROM {used}", f"FROM {{{used}}}").replace(f"JOIN {used}", f"JOIN {{{used}}}")
    return spark.sql(text, **{used: view(spark, sf_dir, used) for used in USES[name]})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_spans with end_ns, an attribute map and events, as the trace operators read them."""
    attributes = F.map_filter(F.create_map(F.lit("url.path"), F.col("url_path"), F.lit("peer.service"), F.col("peer")), lambda k, v: v != "")
    no_events = F.array().cast("array<struct<ts_ns: bigint, name: string, attrs: map<string, string>>>")
    return (
        view(spark, sf_dir, "fx_spans")
        .withColumn("end_ns", F.col("start_ns") + F.col("duration_ns"))
        .withColumn("attrs", attributes)
        .withColumn("events", no_events)
        .drop("url_path", "peer")
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_logs")


def with_views(query: str, *names: str) -> str:
    """DuckDB SQL with the named views, and those they use, before it as common tables."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in needed:
            for used in USES[name]:
                need(used)
            needed.append(name)

    for name in names:
        need(name)
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    rest = query.strip()
    recursive = rest.upper().startswith("WITH RECURSIVE")
    if recursive or rest.upper().startswith("WITH"):
        rest = ", " + rest[len("WITH RECURSIVE") if recursive else len("WITH") :].strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest if rest.startswith(',') else chr(10) + rest}"
