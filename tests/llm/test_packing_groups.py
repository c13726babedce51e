"""Packing patterns on histograms whose pieces mostly do not fill sequences."""

import time
from collections import Counter

import numpy as np
import pytest

from obsflow.llm import packing


def histogram(kind):
    draw = np.random.default_rng(4)
    counts = np.zeros(1025, np.int64)
    if kind == "one length":
        counts[700] = 10_000_000
    elif kind == "halves":
        counts[400] = 10_000_001
    elif kind == "hot":
        counts[:] = draw.integers(0, 2000, 1025)
        counts[700] += 3_000_000
    elif kind == "long":
        counts[513:1019] = draw.integers(0, 20_000, 506)
        counts[1:513] = draw.integers(0, 40, 512)
    elif kind == "mixed":
        counts[[400, 300]] = 1_000_000, 2_000_000
    elif kind == "small":
        counts[[400, 300, 624, 100]] = 20, 41, 7, 3
    counts[0] = 0
    return counts


@pytest.mark.parametrize("kind", ["one length", "halves", "hot", "long", "mixed", "small"])
def test_patterns_do_not_grow_with_the_corpus(kind):
    counts = histogram(kind)
    began = time.monotonic()
    found = packing.patterns(counts, 1024)
    rows = packing.slots(found)
    assert len(rows) <= min(packing.most_slots(1024), 20_000) and time.monotonic() - began < 60
    held = Counter()
    for lengths, copies in found:
        assert sum(lengths) <= 1024 and copies > 0
        for n in lengths:
            held[n] += copies
    assert held == Counter({n: int(c) for n, c in enumerate(counts) if c})
    ends = {}
    for length, start, end, _, copies, _ in sorted(rows):
        assert start == ends.get(length, 0) and (end - start) % copies == 0
        ends[length] = end
    sequences = sum(copies for _, copies in found)
    least = {"one length": 10_000_000, "halves": 5_000_001, "mixed": 1_000_000}.get(kind, max(counts[513:].sum(), -(-int((counts * np.arange(1025)).sum()) // 1024)))
    assert sequences <= least * 1.01 + 2


def test_placed(spark):
    counts = np.bincount([200] * 70 + [90] * 11 + [1], minlength=257)
    rows = packing.slots(packing.patterns(counts, 256))
    ranked = [(0, 0, 0, n, 0, r) for n, c in enumerate(counts.tolist()) for r in range(c)]
    frame = spark.createDataFrame(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long").repartition(3)
    taken = {}
    for r in packing.placed(frame, rows).collect():
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, taken.values())) == len(ranked)
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
