"""Repair of damaged conversations as a lightest derivation.

The rows of a conversation are read by an automaton of role initials, `(s?(ua)+)?`. An item (place, state) says that the
rows before place are dealt with and that what was kept of them leads to state. Edits are deductions between items, each
with a weight (cost, audit): costs add and audits are joined, which is monotone in every tail, so the agenda of Knuth's
generalisation of Dijkstra's algorithm pops every item at its least weight, and the first accepting item is the repair.

Conversations are dealt to tasks by ranges of (conversation, turn, role, digest), so one that holds a third of all rows
is spread. A task solves the conversations that lie inside it whole. A stretch of a conversation that goes on elsewhere
(or is longer than MOST_ROWS or MOST_BYTES) becomes a small table of items (state before, state after); those tables are
joined by binary deductions with the same agenda, a few numbers per stretch, and the choice goes back to the stretches.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsflow.llm.common import stored

DELETE, INSERT, KEEP, REROLE, LEFT = "D", "I", "K", "R", 5
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
FINAL = (START, ASSISTANT)
#: The state that a kept role of this initial leads to.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: What the automaton wants next, for rows that get another role and for rows that are added.
WANTED = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
MOST_ROWS, MOST_BYTES, MOST_KNOWN = 4096, 4 << 20, 100_000
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", "sound"

Item = Hashable
Weight = tuple


def lightest(axioms: Iterable[tuple[Weight, Item]], deduce: Callable[[Item, dict], Iterable[tuple[Weight, Item]]], goal: Callable[[Item], bool] = lambda _: False) -> dict[Item, Weight]:
    """The least weight of every item up to the first goal; deduce gives conclusions from an item and those before it."""
    agenda, final = list(axioms), {}
    heapq.heapify(agenda)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = weight
        if goal(item):
            break
        for conclusion in deduce(item, final):
            if conclusion[1] not in final:
                heapq.heappush(agenda, conclusion)
    return final


def _edits(rows: list[tuple[str, str]], at_end: bool, item: tuple[int, int], final: dict) -> Iterator[tuple[Weight, Item]]:
    """rows: (initial, fault). Rows are added before a row; after the last one only at the conversation's end."""
    place, state = item
    cost, audit = final[item]
    if place < len(rows) or at_end:
        yield (cost + COSTS[INSERT], audit + INSERT), (place, AFTER[state, WANTED[state][0]])
    if place == len(rows):
        return
    initial, fault = rows[place]
    yield (cost + COSTS[DELETE], audit + DELETE), (place + 1, state)
    if fault in (BLANK, DUPLICATE):
        return
    cost += LEFT * (fault == TRUNCATED)
    if (state, initial) in AFTER:
        yield (cost + COSTS[KEEP], audit + KEEP), (place + 1, AFTER[state, initial])
    yield (cost + COSTS[REROLE], audit + REROLE), (place + 1, AFTER[state, WANTED[state][0]])


def repair(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of whole rows (initial, fault); the ASCII-least audit of equally cheap ones."""
    found = lightest([((0, ""), (0, START))], partial(_edits, rows, True), lambda item: item[0] == len(rows) and item[1] in FINAL)
    return next(reversed(found.values()))


def stretch(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """(before, after, cost, audit) of the cheapest edits of a stretch of rows, for every pair of states they link."""
    out = []
    for before in STATES:
        found = lightest([((0, ""), (0, before))], partial(_edits, rows, False))
        out += [(before, after, *found[len(rows), after]) for after in STATES if (len(rows), after) in found]
    return out


def edited(rows: list[tuple[str, str]], audit: str, before: int = START) -> str:
    """The lines role:text that an audit makes of rows (role, text), joined by line feeds."""
    lines, rest, state = [], iter(rows), before
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(rest)
        if edit == DELETE:
            continue
        role = role if edit == KEEP else WANTED[state]
        state = AFTER[state, role[:1]]
        lines.append(f"{role}:{text}")
    return "\n".join(lines)


@dataclass
class _Run:
    """Rows of one conversation that follow each other in a task."""

    key: object
    opened: bool  # rows before it may lie elsewhere
    rows: list[tuple[str, str]] = field(default_factory=list)
    faults: list[str] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)
    size: int = 0


def _fault(text: str, again: bool) -> str:
    bare = text.rstrip(" \t\n\x0b\x0c\r")
    return BLANK if not bare else DUPLICATE if again else SOUND if bare[-1] in ".!?" else TRUNCATED


def _solved(run: _Run, lo: int, closed: bool, known: dict[tuple, tuple[int, str]]) -> dict:
    signs = [(role[:1], fault) for (role, _), fault in zip(run.rows, run.faults, strict=True)]
    there = [t for t in run.turns if t is not None]
    initials = "".join(role[:1] or " " for role, _ in run.rows)
    out = {
        "conv_id": run.key, "lo": lo, "whole": closed and not run.opened, "n": len(run.rows), "first_initial": initials[:1], "last_initial": initials[-1:],
        "least_turn": min(there, default=None), "most_turn": max(there, default=None), "n_turns": len(set(there)), "links": [], "roles": [], "texts": [],
        "illegal": sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1)), **{f: run.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)},
    }
    if not out["whole"]:
        links = [{"before": p, "after": q, "cost": c, "audit": a} for p, q, c, a in stretch(signs)]
        return out | {"links": links, "roles": [r for r, _ in run.rows], "texts": [t for _, t in run.rows], "cost": None, "audit": None, "repaired_sha256": None}
    if (found := known.get(tuple(signs))) is None:
        if len(known) >= MOST_KNOWN:
            known.clear()
        found = known[tuple(signs)] = repair(signs)
    cost, audit = found
    return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(edited(run.rows, audit).encode()).hexdigest()}


def _stretches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From rows by conversation, turn, role, digest and kind: whole answers, and stretches of what goes on elsewhere."""
    known: dict[tuple, tuple[int, str]] = {}
    lo, run, first, out, held = TaskContext.get().partitionId() << 33, None, None, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "kind", "text", "n")]
        for key, turn, role, digest, kind, text, n in zip(*columns, strict=True):
            if run is None or key != run.key:
                if run is not None:
                    out.append(_solved(run, lo, True, known))
                    lo += 1
                run = _Run(key, run is None)
            if kind == 0:  # says only that the conversation exists
                continue
            if kind == 1:  # the row that follows is the first with its role and text
                first = (turn, role, digest)
                continue
            for _ in range(n):
                if len(run.rows) == MOST_ROWS or run.rows and run.size + len(text) > MOST_BYTES:
                    out.append(_solved(run, lo, False, known))
                    held += run.size
                    lo, run = lo + 1, _Run(key, True)
                run.rows.append((role, text))
                run.faults.append(_fault(text, first != (turn, role, digest)))
                run.turns.append(turn)
                run.size += len(text)
                first = None
            if len(out) >= 2000 or held > 2 * MOST_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
    if run is not None:
        out.append(_solved(run, lo, False, known))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _joined(left: dict[tuple[int, int], Weight], right: dict[tuple[int, int], Weight]) -> tuple[dict[tuple[int, int], Weight], dict[tuple[int, int], int]]:
    """Two neighbouring tables {(before, after): (cost, rank)} as one, and the state between them of each entry.

    Audits of a stretch end with the letter of its last row and have one such letter for each row, so none is the
    beginning of another, and comparing ranks, left first, compares the joined audits.
    """

    def deduce(item: tuple, final: dict) -> Iterator[tuple[Weight, Item]]:
        side, before, after = item
        if side == "left":
            pairs = ((item, other) for other in final if other[0] == "right" and other[1] == after)
        elif side == "right":
            pairs = ((other, item) for other in final if other[0] == "left" and other[2] == before)
        else:
            return
        for a, b in pairs:
            (x, i), (y, j) = left[a[1:]], right[b[1:]]
            yield (x + y, (i, j), a[2]), ("both", a[1], b[2])

    axioms = [((w[0], (), 0), (side, *states)) for side, table in (("left", left), ("right", right)) for states, w in table.items()]
    found = {item[1:]: w for item, w in lightest(axioms, deduce).items() if item[0] == "both"}
    ranks = {r: k for k, r in enumerate(sorted({w[1] for w in found.values()}))}
    return {s: (w[0], ranks[w[1]]) for s, w in found.items()}, {s: w[2] for s, w in found.items()}


def _chosen(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Which states each stretch of one conversation begins and ends with in the cheapest repair of the whole."""
    rows = sorted(table.to_pylist(), key=lambda x: x["lo"])
    tables = []
    for row in rows:
        ranks = {a: k for k, a in enumerate(sorted({x["audit"] for x in row["links"]}))}
        tables.append({(x["before"], x["after"]): (x["cost"], ranks[x["audit"]]) for x in row["links"]})
    # the last table adds rows at the conversation's end, and leads from every state to -1
    ends = {s: _end(s) for s in STATES}
    ranks = {a: k for k, a in enumerate(sorted({a for _, a in ends.values()}))}
    level = [*tables, {(s, -1): (c, ranks[a]) for s, (c, a) in ends.items()}]
    below = []
    while len(level) > 1:
        pairs = [_joined(level[k], level[k + 1]) if k + 1 < len(level) else (level[k], None) for k in range(0, len(level), 2)]
        below.append([between for _, between in pairs])
        level = [table for table, _ in pairs]
    states = [(START, -1)]
    for betweens in reversed(below):
        states = [x for (p, q), m in zip(states, betweens, strict=True) for x in ([(p, q)] if m is None else [(p, m[p, q]), (m[p, q], q)])]
    cost, tail = ends[states.pop()[0]]
    total = cost + sum(t[s][0] for t, s in zip(tables, states, strict=True))
    out = [{"conv_id": row["conv_id"], "lo": row["lo"], "before": p, "after": q, "total": total, "tail": ""} for row, (p, q) in zip(rows, states, strict=True)]
    out[-1]["tail"] = tail
    return pa.Table.from_pylist(out, schema)


def _end(state: int) -> tuple[int, str]:
    """Cost and audit of the rows added after the last one."""
    found = lightest([((0, ""), (0, state))], partial(_edits, [], True), lambda item: item[1] in FINAL)
    return next(reversed(found.values()))


def _parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The audit and the repaired text of each stretch."""
    for batch in batches:
        for one in range(batch.num_rows):
            row = batch.slice(one, 1).to_pylist()[0]
            audit = next((x["audit"] for x in row["links"] if (x["before"], x["after"]) == (row["before"], row["after"])), "") + row["tail"]
            part = {"conv_id": row["conv_id"], "lo": row["lo"], "audit": audit, "part": edited(list(zip(row["roles"], row["texts"], strict=True)), audit, row["before"])}
            yield pa.RecordBatch.from_pylist([part | {"any": bool(set(audit) - {DELETE})}], schema)


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of each conversation, which come in order: a part is in memory, never the whole."""
    key, digest, audit, begun, any_row = None, None, [], False, False
    done = lambda: pa.RecordBatch.from_pylist([{"conv_id": key, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)
    for batch in batches:
        for row in batch.to_pylist():
            if not any_row or row["conv_id"] != key:
                if any_row:
                    yield done()
                key, digest, audit, begun, any_row = row["conv_id"], hashlib.sha256(), [], False, True
            audit.append(row["audit"])
            if row["any"]:
                digest.update(("\n" * begun + row["part"]).encode())
                begun = True
    if any_row:
        yield done()


def _schema(kind: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(rest).fields])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema, prefers_large_types=False)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text): counts of faults, cost and audit of the repair, its SHA-256.

    Nulls: a null role or text is one space (so such a text is blank), rows of null turn come first, rows of null
    conv_id form one conversation. Ties in turn go by role, then by SHA-256 of the text. Repeated rows are duplicates of
    the first. An optional column n says how often a row stands there; 0 keeps only its conv_id in the result, with
    zeros, an empty audit and the hash of the empty string where no row is left. Very long texts are read whole and
    one at a time; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    kind = rows.schema["conv_id"].dataType
    n = F.col("n").cast("int") if "n" in rows.columns else F.lit(1)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), n.alias("n"))
    own = own.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("int").alias("n")).withColumn("digest", F.sha2("text", 256))
    there = own.where("n > 0")
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    first = there.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("p")).select("conv_id", F.expr("if(p.a, p.b, null)").alias("turn"), "role", "digest", F.lit(1).alias("kind"))
    exists = own.select("conv_id").distinct().withColumn("kind", F.lit(0))
    marked = there.withColumn("kind", F.lit(2)).unionByName(first, allowMissingColumns=True).unionByName(exists, allowMissingColumns=True)
    marked = marked.select("conv_id", "turn", "role", "digest", "kind", "text", "n")
    order = ["conv_id", "turn", "role", "digest"]
    dealt = marked.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*order, "kind")
    link = "array<struct<before:int,after:int,cost:long,audit:string>>"
    schema = _schema(
        kind, "lo long, whole boolean, n long, first_initial string, last_initial string, least_turn long, most_turn long, n_turns long, illegal long, blank long, duplicate long, truncated long, "
        f"cost long, audit string, repaired_sha256 string, links {link}, roles array<string>, texts array<string>"
    )
    found = stored(dealt.mapInArrow(partial(_stretches, schema=_arrow(schema)), schema), "conversations")
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    columns = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return found.where("whole").select(*columns).unionByName(_of_stretches(found.where("not whole"), kind).select(*columns))


def _of_stretches(open_: DataFrame, kind: T.DataType) -> DataFrame:
    """The same columns for conversations that were cut, from their stretches."""
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    schema = _schema(kind, "lo long, before int, after int, total long, tail string")
    chosen = stored(open_.select("conv_id", "lo", "links").groupBy("conv_id").applyInArrow(lambda rows: _chosen(rows, _arrow(schema)), schema), "stretches")
    both = open_.alias("o").join(chosen.drop("conv_id").alias("c"), "lo").select("o.conv_id", "lo", "links", "roles", "texts", "before", "after", "tail")
    schema = _schema(kind, "lo long, audit string, part string, any boolean")
    parts = both.mapInArrow(partial(_parts, schema=_arrow(schema)), schema)
    schema = _schema(kind, "audit string, repaired_sha256 string")
    texts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "lo").mapInArrow(partial(_hashed, schema=_arrow(schema)), schema)
    step = F.sort_array(F.collect_list(F.struct("lo", "first_initial", "last_initial", "least_turn", "most_turn")))
    full = F.filter("s", lambda x: x["first_initial"] != "")
    legal = [F.lit(p) for p in ("su", "ua", "au")]
    # each pair of neighbouring stretches: their initials, and whether one turn lies on both sides
    seam = lambda get: F.aggregate(
        F.sequence(F.lit(1), F.size("s") - 1), F.lit(0).cast("long"), lambda a, k: a + get(F.element_at("s", k), F.element_at("s", k + 1)).cast("long")
    )
    illegal = seam(lambda x, y: ~F.concat(x["last_initial"], y["first_initial"]).isin(*legal))
    shared = seam(lambda x, y: F.coalesce(x["most_turn"] == y["least_turn"], F.lit(False)))
    sums = open_.groupBy("conv_id").agg(step.alias("s"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")), F.min("least_turn").alias("least_turn"), F.max("most_turn").alias("most_turn"))
    sums = sums.withColumn("s", full)
    more = F.size("s") > 1
    sums = sums.withColumns({"illegal": F.col("illegal") + F.when(more, illegal).otherwise(0), "n_turns": F.col("n_turns") - F.when(more, shared).otherwise(0)})
    costs = chosen.groupBy("conv_id").agg(F.max("total").alias("cost"))
    out = sums.alias("a").join(costs.alias("b"), same("a", "b")).join(texts.alias("t"), same("a", "t"))
    return out.select("a.*", "b.cost", "t.audit", "t.repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text; nulls: one space) as crc32(conv_id:turn) % 20 damages them, with n, how often each is there."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    changed: Column = F.when(what == 1, "").when(what == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return rows.select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(text("role")).alias("role"), changed.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("n")
    )
