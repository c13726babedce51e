"""Ranked search against scores of every document, and the slices against the terms they stand for."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from obsflow.llm import lexical

SCHEMA = "doc_id long, text string, block long, terms string, score long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    of = {}
    for item, text in items:
        of.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in of.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in wanted}
        scored = []
        for doc, c in counts:
            m = 10 + 90 * c.total() * n // max(1, total)
            score = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(4)
    words = [f"w{k}" for k in range(400)] + ["Été", "ÉTÉ", "naïve", "x1", "42", "日本", "\x85"]
    out = [(k, " ".join(draw.choices(words, [1 / (j + 1) for j in range(len(words))], k=draw.choice([1, 3, 20, 60, 200])))) for k in range(400)]
    out += [(500 + k, out[7][1]) for k in range(40)] + [out[9]] * 3 + [(None, out[7][1]), (None, None), (600, None), (601, ""), (602, " ...\n"), (603, "W1,w2;W1_w3\x00w4")]
    return out + [(700, " ".join(draw.choices(words, k=30000))), (701, "w5 " * 5000)]


@pytest.fixture(scope="module")
def items(docs):
    draw = random.Random(6)
    out = [(k, " ".join(draw.choices((docs[draw.randrange(400)][1] + " zz W1").split(), k=12))) for k in range(30)]
    return [*out, (50, "unheard of"), (51, None), (52, ""), (3, "w7 w8"), (None, "Été w3"), (60, docs[7][1]), (60, docs[7][1])]


def test_equals_scores_of_all(spark, docs, items):
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA).repartition(3)
    found = lexical.ranked(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_small_blocks_and_several_passes(spark, docs, items, monkeypatch):
    made = lexical.Queries.of(items)
    made.weigh(*_counts(docs, made))
    best = lexical.Best(len(made.ids), 10)
    ids = np.asarray([lexical.NO_ID if i is None else i for i, _ in docs])
    texts = pa.array([t for _, t in docs], pa.large_string())
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 13)
    monkeypatch.setattr(lexical, "QUERY_GROUP", 7)
    for row in lexical._blocks(ids, texts):
        slices = np.frombuffer(row["slices"], np.uint8).reshape(row["width"], -1)
        number = lambda c, row=row: np.asarray(row[c], np.int64)
        own = np.asarray([lexical.NO_ID if i is None else i for i in row["doc_ids"]])
        block = lexical.Block(own, number("lengths"), row["terms"].cast(pa.string()), number("ends"), number("codes"), number("counts"), slices)
        m = 10 + (90 * block.lengths * made.documents) // made.total
        most = np.maximum.reduceat(block.counts, np.concatenate([[0], block.ends[:-1]]))
        i, d = (x.ravel() for x in np.meshgrid(np.arange(len(made.ids)), np.arange(len(own)), indexing="ij"))
        assert (block.bounds(made, 0, len(made.ids), m, most)[i, d] >= block.scores(made, i, d, m)).all()
        lexical._search_block(block, made, best)
    found = [(made.ids[i], None if d == lexical.NO_ID else d, s) for i, d, s in zip(best.item.tolist(), best.doc.tolist(), best.score.tolist(), strict=True)]
    assert sorted(found, key=repr) == sorted(((i, d, s) for i, _, d, s in brute(docs, items)), key=repr)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(lexical, "QUERY_BYTES", 300)
    assert sorted((tuple(r) for r in lexical.ranked(frame, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr) == brute(docs, items)


def _counts(docs, made):
    counts = [Counter(terms(t)) for _, t in docs]
    return sum(1 for c in counts if c), sum(c.total() for c in counts), np.asarray([sum(t in c for c in counts) for t in made.terms.to_pylist()])


def test_empty_tables(spark, docs, items):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked(none, asked).isEmpty()
    assert lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string"), asked.limit(0)).isEmpty()
    assert lexical.ranked(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), asked).isEmpty()
