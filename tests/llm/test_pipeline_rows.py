"""Each stage of the pipeline on rows of all kinds: nulls, repeats, empty tables, very long texts and clashing columns."""

import os
import random

import corpus_pipeline
from obsflow.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, n_removed int, _hash long, row string, d long, i long, h long"


def prose(draw, n):
    return " ".join("".join(draw.choice(["th", "er", "on", "in", "ea", "st", "ou"]) for _ in range(draw.randint(2, 4))) for _ in range(n)).capitalize() + "."


def test_stages_on_rows_of_all_kinds(spark, tmp_path):
    draw = random.Random(5)
    clean = [prose(draw, 90) for _ in range(10)]
    more = [("long", prose(draw, 30_000)), (None, prose(draw, 80)), (None, None), (21, ""), (22, None), (3, clean[3])]
    rows = [(k, t) for k, t in enumerate(clean)] + [(30 if k == "long" else k, t) for k, t in more]
    docs = spark.createDataFrame([(k, t, "en", None, len(t or ""), "x", 5, 6, "r", 7, 8, 9) for k, t in rows], SCHEMA).repartition(3)
    spark.createDataFrame([(1, clean[9][:300]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for empty in (False, True):
        at = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{name}-{empty}")
            at = spark.read.parquet(f"{tmp_path}/{name}-{empty}")
        left = sorted((r.doc_id is None, r.doc_id) for r in at.select("doc_id").distinct().collect())
        assert left == ([] if empty else [(False, k) for k in (*range(9), 30)] + [(True, None)])


def test_run_leaves_only_its_result(spark, tmp_path):
    draw = random.Random(6)
    docs = spark.createDataFrame([(k, prose(draw, 60), "en", "s", 0) for k in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in these texts at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 8
    new = set(os.listdir(at)) - before
    assert len(new) == 1 and os.listdir(f"{at}/{new.pop()}") == ["packing"]
