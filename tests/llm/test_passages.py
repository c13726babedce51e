"""Repeated passages against brute force over chunks, and rows that share an id or have none."""

import random
from collections import defaultdict

import numpy as np

from obsflow.llm import chunks


def cuts(text):
    raw = text.encode()
    ends = next(chunks.boundaries(np.frombuffer(raw, np.uint8), np.asarray([len(raw)]))).tolist() if raw else []
    return [(a, b, raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]


def brute(rows, least=100):
    last = 1 << 63
    order = lambda i: last if i is None else i
    have = defaultdict(set)
    for i, t in rows:
        for _, _, c in cuts(t or ""):
            have[c].add(order(i))
    out = set()
    for i, t in {(i, t or "") for i, t in rows}:
        run = []
        for a, b, c in [*cuts(t), (-1, -1, None)]:
            first = min(have[c]) if c is not None else last
            if c is not None and first < order(i) and (not run or run[-1][1] == a):
                run.append((a, b, first))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                out.add((i, run[0][0], run[-1][1], len(run), min(f for _, _, f in run)))
            run = [(a, b, first)] if c is not None and first < order(i) else []
    return out


def test_passages_equal_brute_force(spark):
    draw = random.Random(2)
    prose = lambda n: " ".join("".join(draw.choice(["th", "er", "on", "in", "ea"]) for _ in range(draw.randint(1, 4))) for _ in range(n))
    common = prose(60)
    rows = [(k % 40 if k % 7 else None, prose(draw.randint(5, 60)) + (common if k % 2 else "") + prose(30)) for k in range(90)]
    rows += [(7, rows[1][1]), (None, rows[3][1]), (None, rows[3][1]), (50, "word " * 900), (51, "word " * 800), (52, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, hi long, first string").repartition(5)
    got = [tuple(r) for r in chunks.repeated_passages(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_rows_without_ids_are_not_overlaid(spark):
    draw = random.Random(3)
    text = lambda: " ".join(str(draw.random()) for _ in range(30))
    one, two = text(), text()
    docs = spark.createDataFrame([(1, one), (2, two), (None, one), (None, "x" * 37 + two)], "doc_id long, text string")
    got = sorted((r.first_doc_id, r.start, r.end) for r in chunks.repeated_passages(docs).where("doc_id is null").collect())
    assert got[0] == (1, 0, len(one)) and got[1][0] == 2 and got[1][2] == len(two) + 37
