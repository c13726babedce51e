"""Repeated strings where a passage stands in most documents, over many tasks, with rows that share an id or have none."""

import hashlib
import random
from collections import Counter

from obsflow.llm import repeats


def brute(rows, length=50):
    """(doc_id, n_removed, spans, digest) of each row, from sets of all strings."""
    last = 1 << 63
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (last if i is None else i):
                gone[k : k + length] = b"\x01" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return Counter(out)


def test_common_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "KNOWN", 40)
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, other = prose(25), prose(20)
    rows = []
    for k in range(160):
        text = prose(draw.randint(5, 40))
        if k % 3:
            text = text[: len(text) // 2] + common[draw.randint(0, 20) :] + text[len(text) // 2 :]
        if k % 4 == 0:
            text += other + prose(2) + other
        rows.append((draw.randrange(100) if k % 5 else None, text))
    rows += [(7, rows[3][1]), (None, rows[3][1]), (None, common), (0, None), (None, None), (-5, "é" * 40), (3, "é" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r._row.doc_id, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.repeated_strings(docs).collect())
    assert got == brute(rows)
