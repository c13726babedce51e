"""The log-bilinear model: normalised scores, what is learnt, held-out gains, and what another partitioning changes."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from obsflow.llm import lbl


def small_vocabulary(n=200, classes=16):
    words = [f"w{k * 37 % 211}".encode() for k in range(n)]
    tokens = np.concatenate([np.arange(n, 0, -1), [40], np.full(classes, 5)])
    return lbl.Vocabulary(words, lbl.class_borders(words, classes), tokens, np.full(classes, 3), int(tokens.sum()), n + 1 + 3 * classes)


def test_each_unit_has_one_place():
    v = small_vocabulary()
    inside = v.slot_of >= 0
    assert sorted(v.slot_of[inside]) == list(range(len(v.slot_unit))) and inside.sum() == len(v.unit_tokens) - min(lbl.TOP, 200) - 1
    assert (v.slot_class[v.slot_of[inside]] == v.top_of[inside] - lbl.TOP - 1).all()
    assert np.allclose(np.bincount(v.slot_class, v.slot_share()), 1) and np.isclose(v.top_share().sum(), 1)


def test_normalised_and_better_than_chance():
    v, draw = small_vocabulary(), np.random.default_rng(0)
    units = (np.cumsum(draw.integers(1, 3, 6000)) % 150).astype(np.int32)  # the next unit is one of two
    line, place = lbl.padded(units, np.asarray([2500, 0, 3500]), v.end)
    trainer = lbl.Trainer(lbl.Parameters.start(v), v, 1)
    before = lbl.log_probabilities(trainer.p, v, line, place).mean()
    for _ in range(60):
        trainer.step(line, place)
    assert lbl.log_probabilities(trainer.p, v, line, place).mean() > before + 0.2
    for at in (place[0], place[7]):  # all units after one context
        each = np.arange(len(v.unit_tokens), dtype=np.int32)
        lines = np.concatenate([np.append(line[at - lbl.CONTEXT : at], k) for k in each])
        share = 10 ** lbl.log_probabilities(trainer.p, v, lines, (lbl.CONTEXT + 1) * (each + 1) - 1)
        assert abs(share.sum() - 1) < 1e-4


def test_classes_follow_endings():
    words = pa.array(["ration", "nation", "x", "", "anthing", "thing"])
    found = lbl.endings(words)
    assert found[0] != found[1] and found[3] == 0 and abs(int(found[0]) - int(found[1])) < 1 << 24
    assert abs(int(found[4]) - int(found[5])) < 1 << 32


def test_units_grow_with_the_corpus():
    sizes = [lbl.Sizes.of(n).words for n in (0, 10**6, 10**9, 10**12)]
    assert sizes == sorted(set(sizes)) and sizes[2] > 9 * sizes[1]


def test_held_out_texts_gain_and_counts_ignore_the_partitioning(spark):
    draw = np.random.default_rng(3)
    follow = draw.integers(0, 400, (400, 2))
    rows = []
    for k in range(4000):
        word, out = int(draw.integers(400)), []
        for _ in range(60):
            out.append(f"word{word}")
            word = int(follow[word, draw.integers(2)]) if draw.random() < 0.9 else int(draw.integers(400))
        rows.append((k, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = ({r.doc_id: r for r in lbl.scored(docs.repartition(n)).collect()} for n in (2, 5))
    held = [r for r in one.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)
    for k, r in one.items():
        s = other[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (s.n_tokens, s.n_known, s.train_tokens) and np.isclose(r.base_score, s.base_score)
        assert abs(r.score - s.score) < 0.25 * abs(r.score)  # training averages over partitions


def test_bytes_that_are_no_text_stay_apart(spark, tmp_path):
    texts = [b"\xff \xff \xff \xfe a", b"\xef\xbf\xbd a", b"\xef\xbf\xbd \xff\xef\xbf\xbd \xc2\xa0b\xe3\x80\x80 \xc3\x85 x\x00y", b"\xfe A\x0b\xff\x1ca"] * 3
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.binary()).view(pa.string())}), f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in lbl.scored(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    words = [[*t.lower().split(), None] for t in texts]
    counts = Counter(w for k, t in enumerate(words) if zlib.crc32(str(k).encode()) % 10 for w in t)
    n = counts.total()
    for k, t in enumerate(words):
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in t)
        assert (found[k].n_tokens, found[k].n_known, found[k].train_tokens) == (len(t), sum(w in counts for w in t), n) and np.isclose(found[k].base_score, base)
