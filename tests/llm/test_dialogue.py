"""Conversation repair against a row-by-row dynamic program and against all edit strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from obsflow.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, n_extra long, cost long, lo string"


def initials(rows, audit):
    """The lines that an audit makes, or None where it does not fit."""
    lines, at = [], 0
    for letter in audit:
        if letter == "I":
            lines.append(None)
            continue
        role, text = rows[at]
        at += 1
        if letter != "D":
            lines.append((role if letter == "K" else None, text))
    out = []
    for k, line in enumerate(lines):
        first = lines[0] is not None and lines[0][0] is not None and lines[0][0].startswith("s")
        wanted = ("user", "assistant")[(k - first) % 2]
        out.append((wanted, "") if line is None else (wanted if line[0] is None else line[0], line[1]))
    return out if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in out)) else None


def brute(rows):
    """One conversation's rows (turn, role, text) in order: the contract's columns."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "")}
    for (_, role, _), fault in zip(rows, faults, strict=True):
        after = defaultdict(list)
        # up to three rows are added before a row; states are the last initials of what was kept
        todo = list(best.items())
        for _ in range(3):
            todo += [((nxt := "a" if s == "u" else "u"), (c + 5, a + "I")) for s, (c, a) in todo[-len(best) :]]
        for state, (cost, audit) in todo:
            after[state].append((cost + 2, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            nxt = "a" if state == "u" else "u"
            after[nxt].append((cost + 1, audit + "R"))
            r = role[:1]
            if r == nxt or (r == "s" and state == ""):
                after[r].append((cost, audit + "K"))
        best = {s: min(v) for s, v in after.items()}
    ends = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
    cost, audit = min((c + ends[s][0], a + ends[s][1]) for s, (c, a) in best.items())
    lines = initials([(r, t) for _, r, t in rows], audit)
    turns = [t for t, _, _ in rows if t is not None]
    firsts = "".join(r[:1] or " " for _, r, _ in rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(firsts[k : k + 2] not in ("su", "ua", "au") for k in range(len(firsts) - 1)), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    )


def expected(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        own = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        own += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: brute(sorted(own, key=key)) for conv, own in out.items()}


def conversations():
    draw = random.Random(3)
    texts = ["Yes.", "No!", "Why? ", "and so", "", " \n", "Ünd?", "\x85", "It is."]
    rows = []
    for conv in range(150):
        turns = draw.sample(range(12), draw.randint(1, 9))
        rows += [(conv, t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), draw.choice(texts) + draw.choice(["", str(t) + "."])) for t in turns]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "user", "Nulls first."), (8, 2, "user", "Tie."), (8, 2, "user", "Tied."), (8, 2, "assistant", "Tie.")]
    rows += [(1000, k, ("user", "assistant")[k % 2], "word " * 9000 + f"{k}.") for k in range(2)]
    rows += [(2000, k % 700, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(texts) + str(draw.randint(0, 500)) + draw.choice([".", ""])) for k in range(1500)]
    return [(*r, 1, 2, "x") for r in rows + rows[40:60]]


def columns(found):
    rows = found.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("most_rows", [4096, 5])
def test_equals_the_dynamic_program(spark, monkeypatch, most_rows):
    """Also where conversations are cut into stretches of five rows."""
    rows = conversations()
    made = dialogue._stretches
    if most_rows == 5:

        def cut(batches, schema):
            dialogue.MOST_ROWS = 5
            yield from made(batches, schema)

        monkeypatch.setattr(dialogue, "_stretches", cut)
    found = columns(dialogue.repaired(dialogue.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))))
    want = expected(rows)
    assert found.keys() == want.keys()
    assert [(k, found[k], want[k]) for k in want if found[k] != want[k]] == []


def test_equals_all_edit_strings():
    draw = random.Random(5)
    for _ in range(60):
        rows = [(draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["sound", "sound", "truncated", "blank", "duplicate"])) for _ in range(draw.randint(0, 4))]
        best = []
        for n in range(len(rows), 2 * len(rows) + 3):
            for audit in itertools.product("DIKR", repeat=n):
                if sum(a != "I" for a in audit) != len(rows):
                    continue
                done = [a for a in audit if a != "I"]
                if any(a != "D" and f in ("blank", "duplicate") for a, (_, f) in zip(done, rows, strict=True)):
                    continue
                if initials([(r, "") for r, _ in rows], audit) is not None:
                    cost = sum(dialogue.COSTS[a] for a in audit) + sum(5 for a, (_, f) in zip(done, rows, strict=True) if a != "D" and f == "truncated")
                    best.append((cost, "".join(audit)))
        assert dialogue.repair([(r[:1], f) for r, f in rows]) == min(best)


def test_nothing_left_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (2, 0, "user", "Hi.", 1)], "conv_id long, turn long, role string, text string, n int")
    found = columns(dialogue.repaired(rows))
    assert found[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[2][5:7] == (2, "D")
    assert columns(dialogue.repaired(rows.limit(0))) == {}
