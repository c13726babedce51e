"""Quality rules whose thresholds follow the corpus (native: DataFrame functions only).

Every document is measured, each measure is sketched per language and source, and a document is rejected where a
measure lies far above the upper quartile of its own group. The sketch is a log-linear histogram: counts per bucket,
with five significant bits in a bucket's bound. It merges by adding counts, in any order, so partial aggregation, hot
groups and the fall-back from (language, source) to the language and to the whole corpus all use the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import only, stored, words

#: Measures in thousandths, and the least spread that a threshold allows for.
MEASURES = {"symbol": 15, "dup_line": 130, "repeat": 75, "upper": 30}
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """least_words and most_repeats make base_failed; reach: spreads above the upper quartile that are still kept;
    least_group: documents that a group must have before it has thresholds of its own."""

    least_words: int = 20
    most_repeats: int = 30
    window: int = 8
    reach: int = 4
    least_group: int = 50


def bucket(value: Column) -> Column:
    """The lower bound of a value's bucket: exact below 32, five significant bits from there."""
    out = value
    for bits in range(5, 21):
        step = 1 << (bits - 4)
        out = F.when(value >= (1 << bits), value - value % step).otherwise(out)
    return out


def repeated_words(tokens: Column, window: int) -> Column:
    """Words that lie in a window which occurs at least twice; windows are compared by 64-bit hash within one text.

    The window is a power of two, so that its hash comes from those of its halves.
    """

    def covered(sorted_windows: Column) -> Column:
        near = lambda k: F.when((k >= 1) & (k <= F.size(sorted_windows)), F.element_at(sorted_windows, k)["h"])
        twice = F.filter(
            sorted_windows, lambda x, k: F.coalesce(near(k) == x["h"], F.lit(False)) | F.coalesce(near(k + 2) == x["h"], F.lit(False))
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-window).cast("int").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n")), lambda acc: acc["n"]
        )

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = F.element_at(F.transform(F.array(pairs), covered), 1)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        # the array of one element binds the value, so that it is made once
        return F.element_at(F.transform(F.array(value), use), 1)

    def joined(hashes: Column, width: int) -> Column:
        """Hashes of windows of twice the width from those of the width."""
        return F.zip_with(hashes, F.slice(hashes, width + 1, F.size(hashes)), lambda x, y: F.xxhash64(x, y))

    def windows(hashes: Column, width: int) -> Column:
        if width < window:
            return bound(joined(hashes, width), lambda twice: windows(twice, 2 * width))
        return bound(F.slice(hashes, 1, F.size(hashes) - window + 1), count)

    some = bound(F.transform(tokens, lambda w: F.xxhash64(w)), lambda hashes: windows(hashes, 1))
    return F.when(F.size(tokens) > window, some).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (null text: 0)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"[\x20\x09-\x0D]+", "") != "")
    return (
        docs.withColumn("_words", words(F.col("text").cast("string")))
        .withColumn("_lines", lines)
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": gone(f"{SYMBOLS}+").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words"), rules.window),
            "n_upper": gone("[A-Z]+").cast("long"),
        })
        .drop("_words", "_lines")
    )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("long")


SHARES = {"symbol": ("n_symbols", "word_chars"), "dup_line": ("n_dup_lines", "n_lines"), "repeat": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars")}


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("lang", "source")]


def sketch(counts: DataFrame) -> DataFrame:
    """Rows (_lang, _source, measure, bucket, n): the histogram of each measure in each group."""
    shares = F.array(*(F.struct(F.lit(m).alias("measure"), bucket(_share(*SHARES[m])).alias("bucket")) for m in MEASURES))
    return counts.select(*_group(), F.explode(shares).alias("s")).groupBy("_lang", "_source", "s.measure", "s.bucket").agg(F.count("*").alias("n"))


def quartiles(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, measure, n, q1, q3) from merged sketches; the rows read are buckets, not documents.

    Of a merged sketch, a quartile is the first bucket at which the running count reaches its share.
    """
    merged = histogram.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    rows = merged.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))

    def at(share: int) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("at"))
        step = lambda acc, x: F.struct(
            (acc["sum"] + x["n"]).alias("sum"),
            F.when(acc["at"].isNull() & ((acc["sum"] + x["n"]) * 100 >= F.col("total") * share), x["bucket"]).otherwise(acc["at"]).alias("at"),
        )
        return F.aggregate("b", first, step, lambda acc: acc["at"])

    return rows.select(*keys, "measure", F.col("total").alias("n"), at(25).alias("q1"), at(75).alias("q3"))


def thresholds(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each (_lang, _source): the highest share kept of each measure, from the smallest group that is large enough."""
    histogram = sketch(counts)
    own = quartiles(histogram, ["_lang", "_source"])
    language = quartiles(histogram, ["_lang"]).select("_lang", "measure", *(F.col(c).alias(f"l_{c}") for c in ("n", "q1", "q3")))
    every = quartiles(histogram, []).select("measure", *(F.col(c).alias(f"e_{c}") for c in ("q1", "q3")))
    joined = own.join(language, ["_lang", "measure"]).join(every, "measure")
    choose = lambda c: F.when(F.col("n") >= rules.least_group, F.col(c)).when(F.col("l_n") >= rules.least_group, F.col(f"l_{c}")).otherwise(F.col(f"e_{c}"))
    least = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))[F.col("measure")]
    limit = choose("q3") + rules.reach * F.greatest(choose("q3") - choose("q1"), least)
    return joined.groupBy("_lang", "_source").agg(*(F.max(F.when(F.col("measure") == m, limit)).alias(f"most_{m}") for m in MEASURES))


def judged(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """counts with base_failed and kept. Ties with a threshold are kept; repeated rows get equal verdicts."""
    limits = thresholds(counts, rules)
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeats * F.col("n_words"))
    within = F.lit(True)
    for m in MEASURES:
        within = within & (_share(*SHARES[m]) <= F.coalesce(F.col(f"most_{m}"), F.lit(1000)))
    return (
        counts.withColumns({"_lang": _group()[0], "_source": _group()[1]})
        .join(limits, ["_lang", "_source"], "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & within)
        .drop("_lang", "_source", *(f"most_{m}" for m in MEASURES))
    )


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts and the verdict for each row of docs.

    A null or empty text has no words and fails; a null language or source is a group of its own, shared with the
    empty string; an empty table gives no rows; columns besides doc_id, text, lang and source are not read.
    """
    plain = only(docs, doc_id="long", text="string", lang="string", source="string")
    return judged(stored(measured(plain, rules).drop("text"), "quality"), rules)


def quality_filter(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(F.col(c) for c in ("text", "lang", "source")))
    counts = stored(measured(plain, rules).drop("text"), "quality")
    return judged(counts, rules).where("kept").select("_row.*")
