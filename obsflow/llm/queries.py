"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm import chunks, decontaminate, dialogue, extract, lbl, lexical, licenses, oracles, packing, quality, rans, repeats, sanitise, simhash
from obsflow.llm.common import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1).drop("ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2, 1024)


def op3_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.scored(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_strings(table(spark, sf_dir, "documents"))
    return found.select("_row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.sanitised(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repaired(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_rans_ids, op2_packing, op3_benchmark, op4_lbl_scores, op5_repeated_passages, op6_quality, op7_near_duplicates, op8_repeated_strings,
        op9_licenses, op10_main_text, op11_personal_data, op12_conversations, op13_search,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others are out of SQL's reach on whole tables; tests/llm holds them against brute force."""
    return {"op6_quality": oracles.quality(), "op13_search": oracles.SEARCH}
