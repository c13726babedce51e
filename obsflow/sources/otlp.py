"""OTLP JSON export requests as rows of spans and logs, and raw tables by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.functions.text import filled, log_id

# what is nested stays JSON text and is read level by level
_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, bytesValue: string, arrayValue: string, kvlistValue: string>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
_RESOURCE = f"resource: struct<attributes: {_ATTRIBUTES}>"
_SPAN = (
    "struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: int, startTimeUnixNano: string, endTimeUnixNano: string, "
    f"attributes: {_ATTRIBUTES}, events: array<struct<timeUnixNano: string, name: string, attributes: {_ATTRIBUTES}>>, status: struct<code: int, message: string>>"
)
_LOG = f"struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, body: {_VALUE}, traceId: string, spanId: string, attributes: {_ATTRIBUTES}>"
TRACES = f"resourceSpans array<struct<{_RESOURCE}, scopeSpans: array<struct<spans: array<{_SPAN}>>>>>, receivedAt bigint"
LOGS = f"resourceLogs array<struct<{_RESOURCE}, scopeLogs: array<struct<logRecords: array<{_LOG}>>>>>, receivedAt bigint"
#: Levels of lists and maps in one another; deeper values stop the job rather than lose something.
MOST_DEPTH = 4
# fixed values: names of the numbers on the wire
KINDS = ["unspecified", "internal", "server", "client", "producer", "consumer"]
STATUSES = ["unset", "ok", "error"]


def _number(value: Column) -> Column:
    """A double without exponent, and without a fraction where there is none."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", value), "0+$", ""), r"\.$", "")
    whole = (value == F.floor(value)) & (F.abs(value) < 9e15)
    short = F.when(F.abs(value).between(1e-3, 1e7), value.cast("string")).otherwise(plain)
    return F.when(value.isNotNull(), F.when(whole, F.floor(value).cast("string")).otherwise(short))


def _leaf(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], _number(v["doubleValue"]), v["boolValue"].cast("string"), F.lower(F.hex(F.unbase64(v["bytesValue"]))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that stands in the expression once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_value(v: Column, depth: int = MOST_DEPTH) -> Column:
    """Scalars as they are, bytes as hex, lists and maps as JSON of their members' text; empty if there is nothing.

    The text of a member that is a list or a map is its JSON in turn. Maps are in the order of their keys, and of equal
    keys the last counts.
    """
    listed = F.from_json(v["arrayValue"], "values array<string>")["values"]
    paired = F.from_json(v["kvlistValue"], "values array<struct<key: string, value: string>>")["values"]
    too_deep = F.raise_error(F.lit(f"a value nests more than {MOST_DEPTH} lists and maps")).cast("string")
    text = lambda c: _let(F.from_json(c, _VALUE), lambda x: any_value(x, depth - 1)) if depth else too_deep
    pairs = "array<struct<key: string, value: string>>"
    items = F.coalesce(F.transform(listed, lambda x: F.struct(F.lit(None).cast("string"), x)).cast(pairs), paired.cast(pairs), F.array().cast(pairs))
    told = F.transform(items, lambda x: F.named_struct(F.lit("key"), x["key"], F.lit("text"), F.coalesce(text(x["value"]), F.lit(""))))

    def written(t: Column) -> Column:
        last = F.filter(t, lambda x, i: ~F.exists(F.slice(t, i + 2, F.size(t)), lambda y: y["key"] == x["key"]))
        as_map = F.when(F.size(t) == 0, "{}").otherwise(F.to_json(F.map_from_entries(F.array_sort(last))))
        return F.when(v["arrayValue"].isNotNull(), F.to_json(F.transform(t, lambda x: x["text"]))).otherwise(as_map)

    nested = F.when(v["arrayValue"].isNotNull() | v["kvlistValue"].isNotNull(), _let(told, written))
    return F.coalesce(_leaf(v), nested, F.lit(""))


def attribute_map(attributes: Column) -> Column:
    """Keys to text; of equal keys the first wins."""
    entries = F.coalesce(attributes, F.array())
    firsts = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["key"], any_value(e["value"]))))


def service_name(resource: Column) -> Column:
    named = F.filter(F.coalesce(resource["attributes"], F.array()), lambda e: e["key"] == "service.name")
    value = F.get(named, F.lit(0))["value"]
    other = _let(_let(value, lambda v: any_value(v)), lambda text: filled(text))  # seldom: names are strings
    return F.coalesce(filled(value["stringValue"]), F.when(value["stringValue"].isNull(), other), F.lit("unknown_service"))


def _named(number: Column, names: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in names)), F.coalesce(number, F.lit(0))), F.lit(names[0]))


def split_undecodable(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(decoded requests, lines that are no JSON object of the schema), from a column `value`; also for streams.

    The exploded array of one keeps Spark from writing the parse into the filter and each column anew.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.withColumn("_r", F.explode(F.array(F.from_json("value", f"{schema}, _bad string", options))))
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    return parsed.where(~bad).select("_r.*").drop("_bad"), parsed.where(bad).select("value")


def spans_of(lines: DataFrame) -> DataFrame:
    """One row per span of export requests in a column `value`."""
    requests, _ = split_undecodable(lines, TRACES)
    resources = requests.select("receivedAt", F.explode("resourceSpans").alias("r"))
    rows = resources.select("receivedAt", service_name(F.col("r.resource")).alias("service"), F.explode("r.scopeSpans").alias("x")).select("receivedAt", "service", F.explode("x.spans").alias("s"))
    start, end = F.coalesce(F.col("s.startTimeUnixNano").cast("long"), F.lit(0)), F.coalesce(F.col("s.endTimeUnixNano").cast("long"), F.lit(0))
    events = F.transform(F.coalesce("s.events", F.array()), lambda e: F.struct(e["timeUnixNano"].cast("long").alias("ts_ns"), e["name"].alias("name"), attribute_map(e["attributes"]).alias("attrs")))
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        F.lower(text("s.traceId")).alias("trace_id"), F.lower(text("s.spanId")).alias("span_id"), F.lower(text("s.parentSpanId")).alias("parent_span_id"), "service", text("s.name").alias("name"),
        _named(F.col("s.kind"), KINDS).alias("kind"), start.alias("start_ns"), F.greatest(end, start).alias("end_ns"), F.greatest(end - start, F.lit(0)).alias("duration_ns"),
        _named(F.col("s.status.code"), STATUSES).alias("status"), text("s.status.message").alias("status_message"), attribute_map(F.col("s.attributes")).alias("attrs"), events.alias("events"),
        F.col("receivedAt").alias("received_ms"),
    )


def logs_of(lines: DataFrame) -> DataFrame:
    """One row per log record; a time of zero is replaced by the time it was observed."""
    requests, _ = split_undecodable(lines, LOGS)
    resources = requests.select(F.explode("resourceLogs").alias("r"))
    rows = resources.select(service_name(F.col("r.resource")).alias("service"), F.explode("r.scopeLogs").alias("x")).select("service", F.explode("x.logRecords").alias("l"))
    time, seen = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("l.timeUnixNano", "l.observedTimeUnixNano"))
    text = lambda c: F.coalesce(c, F.lit(""))
    out = rows.select(
        F.when(time == 0, seen).otherwise(time).alias("ts_ns"), "service", F.coalesce("l.severityNumber", F.lit(0)).alias("severity_number"), text("l.severityText").alias("severity_text"),
        any_value(F.col("l.body")).alias("body"), F.lower(text("l.traceId")).alias("trace_id"), F.lower(text("l.spanId")).alias("span_id"), attribute_map(F.col("l.attributes")).alias("attrs"),
    )
    return out.withColumn("log_id", log_id(F.col("trace_id"), F.col("span_id"), F.col("ts_ns"), F.col("body")))


def read_otlp_traces(spark: SparkSession, path: str) -> DataFrame:
    return spans_of(spark.read.text(path))


def read_otlp_logs(spark: SparkSession, path: str) -> DataFrame:
    return logs_of(spark.read.text(path))


def read_log_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (service, ts_ns, sev, body) or tab-separated (service, body), gzip or plain."""
    if ".tsv" in path:
        return spark.read.csv(path, sep="\t", schema="service string, body string", quote="")
    return spark.read.json(path, schema="service string, ts_ns bigint, sev int, body string")


def corpus_faults(corpus: DataFrame) -> DataFrame:
    """One row: lines without a field, and with a severity out of range."""
    return corpus.agg(F.count_if(F.col("service").isNull() | F.col("body").isNull() | F.col("ts_ns").isNull()).alias("incomplete"), F.count_if(~F.col("sev").between(0, 24)).alias("bad_severity"))


def by_day(df: DataFrame, ts_ns: str) -> DataFrame:
    return df.withColumn("date", F.to_date(F.timestamp_seconds(F.floor(F.col(ts_ns) / 1_000_000_000))))


def write_raw(df: DataFrame, ts_ns: str, path: str, mode: str = "append") -> None:
    """Raw rows partitioned by day; within files by service, minute and trace."""
    minute = F.floor(F.col(ts_ns) / 60_000_000_000)
    by_day(df, ts_ns).withColumn("_minute", minute).sortWithinPartitions("date", "service", "_minute", "trace_id").drop("_minute").write.mode(mode).partitionBy("date").parquet(path)


def as_requests(spans: DataFrame) -> DataFrame:
    """Spans as OTLP JSON export requests, one for each trace with its services as resources, in a column `value`."""
    attributes = F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name",
        (F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")) - 1).alias("kind"), F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        attributes.alias("attributes"), F.struct((F.array_position(F.array(*(F.lit(k) for k in STATUSES)), F.col("status")) - 1).alias("code"), F.col("status_message").alias("message")).alias("status"),
    )
    # one shuffle, by trace, serves both groupings
    scopes = spans.repartition("trace_id").select("trace_id", "service", span.alias("span")).groupBy("trace_id", "service").agg(F.collect_list("span").alias("spans"))
    return _requests(scopes, "resourceSpans", "scopeSpans", "spans")


def as_log_requests(logs: DataFrame) -> DataFrame:
    """Logs as OTLP JSON export requests, one for each service and second, in a column `value`."""
    text = F.col("severity_text") if "severity_text" in logs.columns else F.lit(None).cast("string")
    record = F.struct(
        F.col("ts_ns").cast("string").alias("timeUnixNano"), F.col("severity_number").alias("severityNumber"), text.alias("severityText"),
        F.struct(F.col("body").alias("stringValue")).alias("body"), F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"),
    )
    second = F.floor(F.col("ts_ns") / 1_000_000_000).alias("second")
    return _requests(logs.select("service", second, record.alias("log")).groupBy("second", "service").agg(F.collect_list("log").alias("logRecords")), "resourceLogs", "scopeLogs", "logRecords")


def _requests(scopes: DataFrame, resources: str, scope: str, records: str) -> DataFrame:
    """A request for each value of the first column, a resource for each service in it."""
    named = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))).alias("attributes"))
    one = F.struct(named.alias("resource"), F.array(F.struct(F.col(records))).alias(scope))
    return scopes.groupBy(scopes.columns[0]).agg(F.collect_list(one).alias(resources)).select(F.to_json(F.struct(resources)).alias("value"))
