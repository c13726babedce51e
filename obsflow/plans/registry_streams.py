"""Registered queries of the sources and of the streaming operators on stored data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obsflow.operators import tables as M
from obsflow.plans.registry import FLAGGED, LEAVES, MESSAGES, S, add
from obsflow.sources import otlp
from obsflow.sources.checkpoint import scratch
from obsflow.sources.fixtures import LOG_END, logs, spans, view
from obsflow.streaming import assembly, mining


def arrivals(s: SparkSession, d: str) -> DataFrame:
    return spans(s, d).withColumn("arrival_ms", F.expr("(start_ns - start_ns % 1000000) div 1000000") + F.when(F.col("span_id").endswith("3"), 70).otherwise(0)).withColumn("seq", F.col("span_id"))


SESSIONS = """WITH a AS (SELECT trace_id, span_id, start_ns // 1000000 + CASE WHEN span_id LIKE '%3' THEN 70 ELSE 0 END AS ms FROM fx_spans),
      m AS (SELECT *, coalesce(ms - lag(ms) OVER w >= 60, false) OR ms - min(ms) OVER (PARTITION BY trace_id) >= 100 OR row_number() OVER w > 6 AS broke, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY trace_id ORDER BY ms, span_id)),
      f AS (SELECT *, bool_or(broke) OVER (PARTITION BY trace_id ORDER BY ms, span_id ROWS UNBOUNDED PRECEDING) AS late FROM m)
      SELECT trace_id, span_id, late, bool_or(NOT late AND n > 5) OVER (PARTITION BY trace_id) AS truncated FROM f"""
add(
    "T5_sessionize_batch", lambda s, d: assembly.sessionize_batch(arrivals(s, d), 60, 100, 5).select("trace_id", "span_id", "late", "truncated"),
    SESSIONS, "fx_spans",
)
add(
    "T4_late_items", lambda s, d: assembly.late_items(assembly.sessionize_batch(arrivals(s, d), 60, 100, 5).withColumn("closing", F.when(F.col("late"), "late").otherwise("closed"))),
    f"SELECT trace_id, count(*) AS n_late FROM ({SESSIONS}) WHERE late GROUP BY 1", "fx_spans",
)
add(
    "T6_event_time_sessions", lambda s, d: assembly.event_time_sessions(spans(s, d)),
    """WITH u AS (SELECT trace_id, start_ns // 1000 AS us FROM fx_spans), g AS (SELECT *, coalesce(us - lag(us) OVER w >= 10000000, true) AS new FROM u WINDOW w AS (PARTITION BY trace_id ORDER BY us)),
      n AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY us) AS k FROM g)
      SELECT trace_id, min(us) AS start_us, max(us) + 10000000 AS end_us, count(*) AS n_spans FROM n GROUP BY trace_id, k""", "fx_spans",
)
add("M1_otlp_spans", lambda s, d: otlp.spans_of(otlp.as_requests(spans(s, d))).groupBy("service").agg(F.count("*").alias("n"), F.sum("duration_ns").alias("ns")), "SELECT service, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS ns FROM fx_spans GROUP BY 1", "fx_spans")
add("M3_attribute_values", lambda s, d: otlp.spans_of(otlp.as_requests(spans(s, d))).select("span_id", F.coalesce(F.col("attrs")["peer.service"], F.lit("")).alias("peer")), "SELECT span_id, peer FROM fx_spans", "fx_spans")
add("M4_service_name", lambda s, d: otlp.spans_of(otlp.as_requests(spans(s, d).withColumn("service", F.when(F.col("service") == "svc1", "").otherwise(F.col("service"))))).select("service").distinct(), "SELECT DISTINCT CASE WHEN service = 'svc1' THEN 'unknown_service' ELSE service END AS service FROM fx_spans", "fx_spans")
add(
    "M2_otlp_logs", lambda s, d: otlp.logs_of(otlp.as_log_requests(logs(s, d))).select("log_id", "ts_ns", "service", "severity_number", "severity_text", "body", "trace_id", "span_id"),
    """SELECT substring(md5(trace_id || chr(0) || span_id || chr(0) || ts_ns || chr(0) || body || chr(0)), 1, 16) AS log_id, ts_ns, service, severity_number, '' AS severity_text, body, trace_id, span_id FROM fx_logs""", "fx_logs",
)


def nested_values(s: SparkSession, d: str) -> DataFrame:
    """Lists and maps in one another, with keys that come twice, as the attributes of spans."""
    parts = view(s, d, "part")
    value = F.concat(
        F.lit('{"arrayValue":{"values":[{"arrayValue":{"values":[{"intValue":"'), F.col("p_partkey"), F.lit('"}]}},{"boolValue":true},{"kvlistValue":{"values":[{"key":"b","value":{"stringValue":"'),
        F.col("p_brand"), F.lit('"}},{"key":"a","value":{"arrayValue":{}}},{"key":"b","value":{"doubleValue":1.5}}]}}]}}'),
    )
    span = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"'), F.col("p_partkey"), F.lit('","attributes":[{"key":"x","value":'), value, F.lit("}]}]}]}]}"))
    return otlp.spans_of(parts.select(span.alias("value"))).select("span_id", F.col("attrs")["x"].alias("text"))


add(
    "M3_nested_values", nested_values,
    """SELECT CAST(p_partkey AS VARCHAR) AS span_id, '["[\\"' || p_partkey || '\\"]","true","{\\"a\\":\\"[]\\",\\"b\\":\\"1.5\\"}"]' AS text FROM part""",
)


def corpus(s: SparkSession, d: str) -> DataFrame:
    """The log corpus as files of JSON lines, read back."""
    path = scratch(s, "corpus")
    logs(s, d).select("service", "ts_ns", F.when(F.col("severity_number") == 5, 99).otherwise(F.col("severity_number")).alias("sev"), F.when(F.col("body") != "order placed", F.col("body")).alias("body")).write.option("compression", "gzip").json(path)
    return otlp.read_log_corpus(s, path)


add("M18_log_corpus", lambda s, d: corpus(s, d).select("service", "ts_ns", "sev", "body"), "SELECT service, ts_ns, CASE severity_number WHEN 5 THEN 99 ELSE severity_number END AS sev, CASE WHEN body <> 'order placed' THEN body END AS body FROM fx_logs", "fx_logs")
add("M18_corpus_faults", lambda s, d: otlp.corpus_faults(corpus(s, d)), "SELECT count(*) FILTER (body = 'order placed') AS incomplete, count(*) FILTER (severity_number = 5) AS bad_severity FROM fx_logs", "fx_logs")


def bad_lines(s: SparkSession, d: str) -> DataFrame:
    """Requests of which some are cut short, are no object, or have a list where an object should be."""
    key = F.col("p_partkey")
    whole = F.concat(F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"'), key, F.lit('","name":"'), F.col("p_brand"), F.lit('"}]}]}]}'))
    broken = F.when(key % 10 == 0, F.expr("substring(value, 1, length(value) - 4)")).when(key % 10 == 1, F.concat(F.lit("not JSON "), key)).otherwise(F.col("value"))
    lines = view(s, d, "part").select(whole.alias("value"), "p_partkey").select(broken.alias("value"))
    return otlp.split_undecodable(lines, otlp.TRACES)[1].select(F.md5("value").alias("line"))


add(
    "M8_undecodable", bad_lines,
    """WITH w AS (SELECT p_partkey, '{"resourceSpans":[{"scopeSpans":[{"spans":[{"spanId":"' || p_partkey || '","name":"' || p_brand || '"}]}]}]}' AS value FROM part)
       SELECT md5(CASE WHEN p_partkey % 10 = 0 THEN substring(value, 1, length(value) - 4) ELSE 'not JSON ' || p_partkey END) AS line FROM w WHERE p_partkey % 10 < 2""",
)


def stored_by_day(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "raw")
    otlp.write_raw(logs(s, d), "ts_ns", path)
    return s.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


add("M9_write_raw", stored_by_day, f"SELECT strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d') AS date, count(*) AS n FROM fx_logs WHERE ts_ns >= {S} GROUP BY 1", "fx_logs")


def kept_days(s: SparkSession, d: str) -> DataFrame:
    """Logs of ten days, of which three and a part are kept: whole days go by their folders."""
    path = scratch(s, "days")
    otlp.write_raw(logs(s, d).withColumn("ts_ns", F.col("ts_ns") + F.expr("(ts_ns div 1000000000) % 10") * 86400 * S), "ts_ns", path)
    M.drop_expired(s, path, "ts_ns", 3, LOG_END - 5000 + 9 * 86400)
    return s.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


add(
    "M15_drop_expired", kept_days,
    f"""SELECT strftime(make_timestamp(ts // 1000), '%Y-%m-%d') AS date, count(*) AS n FROM (SELECT ts_ns + ((ts_ns // {S}) % 10) * 86400 * {S} AS ts FROM fx_logs) WHERE ts >= {(LOG_END - 5000 + 6 * 86400) * S} GROUP BY 1""", "fx_logs",
)


def as_stream(s: SparkSession, rows: DataFrame, at: str, files: int = 1000) -> DataFrame:
    """Rows written as files and read as a stream, some files in each batch."""
    rows.write.parquet(f"{at}/in")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", assembly.STATE_STORE)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in")


def until(query: StreamingQuery, done: Callable[[], bool]) -> None:
    """Timers keep a stream going, so it is stopped when its work is done and the batch that was running then has ended."""
    while query.isActive and not done():
        query.awaitTermination(2)
    batch = query.lastProgress["batchId"] if query.lastProgress else -1
    while query.isActive and query.lastProgress["batchId"] <= batch:
        query.awaitTermination(1)
    if query.isActive:
        query.stop()
    elif query.exception():
        raise query.exception()


def copied(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "copy")
    assembly.stream_raw(as_stream(s, logs(s, d), at), f"{at}/out", f"{at}/state", availableNow=True).awaitTermination()
    return s.read.parquet(f"{at}/out").drop("batch_id")


add("M10_stream_raw", copied, "SELECT log_id, ts_ns, service, severity_number, trace_id, span_id, body FROM fx_logs", "fx_logs")
def mined(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "mine")
    mining.mine_stream(as_stream(s, logs(s, d).repartition(3), at, 1), f"{at}/out", f"{at}/state", availableNow=True).awaitTermination()
    return s.read.parquet(f"{at}/out/hits").select("log_id", "service", "template_id")


add("L10_mine_stream", mined)


def replayed(s: SparkSession, d: str) -> DataFrame:
    """Records of spans, some of them twice, and of the logs of traces that have spans."""
    known = spans(s, d).select("trace_id").distinct()
    records = assembly.records_of(spans(s, d), logs(s, d).join(known, "trace_id", "left_semi"))
    return records.withColumn("again", F.explode(F.when(F.col("id").like("%1"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("again")


GAP = 4000


def assembled(s: SparkSession, d: str) -> DataFrame:
    """Every trace closes when nothing has come for it for GAP; replays leave no mark."""
    at = scratch(s, "assemble")
    rows = replayed(s, d)
    out = assembly.assemble_traces(as_stream(s, rows, at), gap_ms=GAP)
    wanted = s.read.schema(rows.schema).parquet(f"{at}/in").select("trace_id", "kind", "id").distinct().count()
    query = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").start()
    found = lambda: s.read.schema(out.schema).parquet(f"{at}/out")
    until(query, lambda: bool(query.lastProgress) and found().count() >= wanted)
    return found().groupBy("trace_id").agg(F.count_if(F.col("kind") == "span").alias("n_spans"), F.count_if(F.col("kind") == "log").alias("n_logs"), F.min("closing").alias("closing"))


add(
    "T3_assemble_traces", assembled,
    """SELECT trace_id, any_value(s.n) AS n_spans, count(DISTINCT (ts_ns, span_id, body)) FILTER (ts_ns IS NOT NULL) AS n_logs, 'closed' AS closing
       FROM (SELECT trace_id, count(*) AS n FROM fx_spans GROUP BY 1) s LEFT JOIN fx_logs l USING (trace_id) GROUP BY 1""", "fx_spans", "fx_logs",
)


def analysed(s: SparkSession, d: str, table: str) -> DataFrame:
    """One of the tables that the analysis of assembled traces writes."""
    at = scratch(s, "analyse")
    rows = replayed(s, d)
    out = assembly.assemble_traces(as_stream(s, rows, at), gap_ms=GAP)
    wanted = s.read.schema(rows.schema).parquet(f"{at}/in").where("kind = 'span'").select("trace_id").distinct().count()
    query = assembly.analyze_stream(out, f"{at}/out", f"{at}/state", spans(s, d).schema, logs(s, d).schema)
    found = lambda name: s.read.parquet(f"{at}/out/{name}").drop("batch_id")
    until(query, lambda: _there(lambda: found("edges").limit(1).count() > 0 and found("summaries").count() >= wanted))
    return found(table)


def _there(look: Callable[[], bool]) -> bool:
    try:
        return look()
    except AnalysisException:  # the table is not there yet
        return False


EDGES_WITH_LOGS = f"""WITH {FLAGGED} SELECT CAST((r.start_ns - r.start_ns % 60000000000) / 1000000000 AS BIGINT) AS minute, p.service AS parent_service, c.service AS child_service, count(*) AS calls,
  count(*) FILTER (c.is_error) AS errors, CAST(sum(c.duration_ns) AS BIGINT) AS duration_ns_sum
  FROM flagged c JOIN fx_spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id JOIN fx_spans r ON r.trace_id = c.trace_id AND r.parent_span_id = '' WHERE c.service <> p.service GROUP BY 1, 2, 3"""
add("T8_analyze_stream", lambda s, d: M.sum_edges(analysed(s, d, "edges")), EDGES_WITH_LOGS, "fx_spans", "fx_logs")
add(
    "T8_stream_stories", lambda s, d: analysed(s, d, "stories").groupBy("cause_service", "message").agg(F.count("*").alias("n")),
    f"""WITH RECURSIVE {LEAVES}, {MESSAGES}, cause AS (SELECT trace_id, arg_min(span_id, (start_ns + duration_ns, start_ns, span_id)) AS span_id FROM leaves GROUP BY 1)
        SELECT service AS cause_service, message, count(*) AS n FROM cause JOIN told USING (trace_id, span_id) GROUP BY 1, 2""", "fx_spans", "fx_logs",
)
