"""Text expositions of metrics as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SAMPLE = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{(?:[^"}]|"(?:[^"\\]|\\.)*")*\})?[ \t]+(\S+)(?:[ \t]+\S+)?[ \t]*$'
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def parse_openmetrics(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, labels, value) from a column `value` of text lines, and a one-row count of lines that are malformed.

    Comments and blank lines are skipped, exemplars cut; NaN and infinities are values.
    """
    kept = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(F.regexp_replace("value", r"[ \t]+#[ \t]+\{.*$", "").alias("line"))
    part = lambda k: F.regexp_extract("line", _SAMPLE, k)
    keys, raw = F.regexp_extract_all(part(2), F.lit(_LABEL), 1), F.regexp_extract_all(part(2), F.lit(_LABEL), 2)
    plain = F.transform(raw, lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\0")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\")))
    number = F.regexp_replace(F.regexp_replace(part(3), r"(?i)^([+-]?)inf$", "$1Infinity"), r"(?i)^nan$", "NaN")
    parsed = kept.select("line", part(1).alias("name"), F.map_from_arrays(keys, plain).alias("labels"), F.regexp_replace(number, r"^\+", "").try_cast("double").alias("value"))
    good = (F.col("name") != "") & F.col("value").isNotNull()
    return parsed.where(good).select("name", "labels", "value"), parsed.where(~good).agg(F.count("*").alias("malformed"))


def metric_rows(parsed: DataFrame, job: str, instance: str, ts_ms: int, ok: bool = True) -> DataFrame:
    """Samples of one scrape with job, instance and time, and an up row."""
    rows = parsed.select(F.lit(ts_ms).cast("long").alias("ts_ms"), F.lit(job).alias("job"), F.lit(instance).alias("instance"), F.col("name").alias("metric"), "labels", "value")
    up = parsed.sparkSession.range(1).select(
        F.lit(ts_ms).cast("long").alias("ts_ms"), F.lit(job).alias("job"), F.lit(instance).alias("instance"), F.lit("up").alias("metric"),
        F.create_map().cast("map<string, string>").alias("labels"), F.lit(1.0 if ok else 0.0).alias("value"),
    )
    return rows.unionByName(up)


def exposition(samples: DataFrame) -> DataFrame:
    """Samples (job, metric, instance, value) as text lines in a column `value`."""
    label = lambda k: F.concat(F.lit(f'{k}="'), F.col(k), F.lit('"'))
    return samples.select(F.concat("metric", F.lit("{"), label("job"), F.lit(","), label("instance"), F.lit("} "), F.col("value").cast("string")).alias("value"))
