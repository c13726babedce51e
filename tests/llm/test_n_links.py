"""n_links of op7 counts every fingerprint within two bits, in cells of any size."""

import random

import pytest

from obsflow.llm import simhash


@pytest.mark.parametrize("bits", [4, 6])  # 16 and 64 fingerprints in a cell, below and above CELL
def test_n_links(spark, bits):
    draw = random.Random(bits)
    base = draw.getrandbits(64)
    values = [base ^ (v << 58) for v in range(1 << bits)] + [draw.getrandbits(64) for _ in range(20)]
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    assert (1 << bits > simhash.CELL) == (bits == 6)
    linked = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"))
    got = {r.fp: r.n_links for r in simhash.degrees(linked).collect()}
    want = {s: sum(0 < (v ^ w).bit_count() <= 2 for w in values) for v, s in signed.items()}
    assert got == {s: n for s, n in want.items() if n}
