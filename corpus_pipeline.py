"""A training corpus from raw documents: each stage is written as Parquet and read again by the next.

quality          documents that the adaptive quality rules reject go (operator 6)
near_duplicates  one document of each component of near copies stays: five-word shingles, Jaccard similarity 0.8 or more
repeats          byte strings that an earlier document has are cut out; texts left without a word go (operator 8)
benchmark        documents that hold a benchmark item go (operator 3)
packing          the rest is packed into sequences of 1024 tokens (operator 2)

Every stage reads documents with the columns it needs and hands all columns on, whatever their names. Null and empty
texts have no words and go with the quality rules. Rows without a doc_id link no copies and count as later than all
others in repeats. Repeated rows are copies of each other. Very long texts are handled whole. An empty table gives no
rows in any stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm import decontaminate, near_copies, packing, quality, repeats
from obsflow.llm.common import discard, scratch, shared_dir, table
from obsflow.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs, size=5, least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = repeats.repeated_strings(docs, keep=docs.columns)
    whole = F.col("n_removed") == 0
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    columns = [F.when(whole, F.col(f"_row.`{c}`")).otherwise(changed[c]).alias(c) if c in changed else F.col(f"_row.`{c}`") for c in docs.columns]
    return found.where(whole | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select(*columns)


def keep_clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 2, 1024)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("repeats", cut_repeats),
    ("benchmark", keep_clear_of_benchmark),
    ("packing", packed),
]
#: Fingerprints, byte-string matches and packing are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if before is not None:
            discard(before)
        before = docs = spark.read.parquet(f"{at}/{name}")
    return docs
