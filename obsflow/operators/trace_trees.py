"""Whole traces as rows: one shuffle by trace brings a trace's spans and logs together, and the rest stays inside the row.

A trace has at most as many spans as the assembler lets in (10,000), so a row is bounded. Small Arrow functions number
the spans of each row: parents without cycles, nested intervals (the pre-order number of a span and the last one of its
subtree, so that "is below" is a comparison), and the critical path. Everything else is expressions over the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKEW_NS = 5_000_000


class Tree(NamedTuple):
    """Indices into a trace's spans; up is -1 for tops. Intervals nest: j is below i if first[i] < first[j] <= last[i]."""

    root: int
    incomplete: bool
    up: list[int]
    cut: list[bool]
    first: list[int]
    last: list[int]
    depth: list[int]
    n_kids: list[int]


def tree_of(ids: Sequence[str], parents: Sequence[str], starts: Sequence[int]) -> Tree:
    """The tree of a trace. A cycle is cut at the span that its earliest span (or one hanging on it) meets twice, climbing."""
    n = len(ids)
    by_start = sorted(range(n), key=lambda i: (starts[i], ids[i]))
    index: dict[str, int] = {}
    for i in by_start:
        if ids[i]:
            index.setdefault(ids[i], i)
    up = [index.get(p, -1) if p else -1 for p in parents]
    up = [-1 if u == i else u for i, u in enumerate(up)]
    incomplete = any(u < 0 and p for u, p in zip(up, parents, strict=True))
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in by_start:
        if up[i] >= 0:
            kids[up[i]].append(i)
    tops = [i for i in by_start if up[i] < 0]
    incomplete |= len(tops) != 1
    seen, cut = [False] * n, [False] * n
    _mark(tops, kids, seen)
    genuine = bool(tops)
    for i in by_start:
        if not seen[i]:
            met, at = set(), i
            while at not in met:
                met.add(at)
                at = up[at]
            kids[up[at]].remove(at)
            up[at], cut[at] = -1, True
            tops.append(at)
            _mark([at], kids, seen)
    root = tops[0] if genuine else min(tops, key=lambda i: (starts[i], ids[i]), default=-1)
    if any(cut):
        tops.sort(key=lambda i: (starts[i], ids[i]))
    first, last, depth, place, todo = [0] * n, [0] * n, [0] * n, 0, tops[::-1]
    while todo:
        i = todo.pop()
        if i < 0:
            last[~i] = place - 1
            continue
        first[i], depth[i] = place, depth[up[i]] + 1 if up[i] >= 0 else 0
        place += 1
        todo.append(~i)
        todo.extend(reversed(kids[i]))
    return Tree(root, incomplete, up, cut, first, last, depth, [len(k) for k in kids])


def _mark(tops: list[int], kids: list[list[int]], seen: list[bool]) -> None:
    todo = list(tops)
    while todo:
        i = todo.pop()
        seen[i] = True
        todo.extend(kids[i])


def error_leaves_of(tree: Tree, ids: Sequence[str], starts: Sequence[int], ends: Sequence[int], bad: Sequence[bool]) -> list[int]:
    """Error spans with none below them, in the order they ended."""
    marks = [0] * len(bad)
    for i, b in enumerate(bad):
        marks[tree.first[i]] = int(b)
    upto = [0, *accumulate(marks)]
    leaves = [i for i, b in enumerate(bad) if b and upto[tree.last[i] + 1] == upto[tree.first[i] + 1]]
    return sorted(leaves, key=lambda i: (ends[i], starts[i], ids[i]))


def path_of(tree: Tree, i: int) -> list[int]:
    """From the top to a span."""
    path = [i]
    while tree.up[path[-1]] >= 0:
        path.append(tree.up[path[-1]])
    return path[::-1]


def critical_path_of(tree: Tree, ids: Sequence[str], starts: Sequence[int], ends: Sequence[int], skew_ns: int = SKEW_NS) -> list[tuple[int, int, int]]:
    """(span, start, end) segments that tile the root's window, in order of time.

    A span's window is walked from its end: each child that ends at or before the cursor (up to skew_ns later counts as
    clocks that differ) takes the time back to its start, the span itself what no child takes.
    """
    kids: list[list[int]] = [[] for _ in ids]
    for i, u in enumerate(tree.up):
        if u >= 0:
            kids[u].append(i)
    segments, windows = [], [(tree.root, starts[tree.root], ends[tree.root])]
    while windows:
        i, low, high = windows.pop()
        cursor = high
        inside = [(min(ends[k], high), ids[k], max(starts[k], low), k) for k in kids[i] if low < ends[k] <= high + skew_ns and starts[k] < high]
        for end, _, start, k in sorted(inside, reverse=True):
            if end > cursor:
                if start >= cursor or end - cursor > skew_ns:
                    continue
                end = cursor
            if cursor > end:
                segments.append((i, end, cursor))
            windows.append((k, start, end))
            cursor = start
        if cursor > low:
            segments.append((i, low, cursor))
    return sorted(segments, key=lambda s: s[1])


def critical_places_of(ids: Sequence[str], parents: Sequence[str], starts: Sequence[int], ends: Sequence[int]) -> list[int]:
    """The spans on the path from the longest parentless one: of each span the child that ends last before the cursor, then
    those that end before that one started. The cursor begins at the span's end, or its parent's if that is earlier."""
    index: dict[str, int] = {}
    for i in sorted(range(len(ids)), key=starts.__getitem__):
        index.setdefault(ids[i], i)
    up = [index.get(p, -1) if p != own else -1 for p, own in zip(parents, ids, strict=True)]
    ends = [max(a, b) for a, b in zip(starts, ends, strict=True)]
    kids: dict[int, list[int]] = {}
    for i, u in enumerate(up):
        kids.setdefault(u, []).append(i)
    root = min(kids.get(-1, ()), key=lambda i: (starts[i] - ends[i], starts[i], ids[i]), default=-1)
    found = [root] if root >= 0 else []
    for i in found:  # grows on the way
        cursor = min(ends[i], ends[up[i]]) if up[i] >= 0 else ends[i]
        for k in sorted(kids.get(i, ()), key=lambda k: (-ends[k], starts[k], ids[k])):
            if min(ends[k], ends[i]) <= cursor:
                found.append(k)
                cursor = starts[k]
    return found


TREE = "struct<root:int,incomplete:boolean,up:array<int>,cut:array<boolean>,first:array<int>,last:array<int>,depth:array<int>,n_kids:array<int>>"
ERRORS = "struct<bad:array<boolean>,leaves:array<int>,path:array<int>>"
CRITICAL = "struct<segments:array<struct<span:int,start_ns:bigint,end_ns:bigint>>,self_times:array<struct<span:int,ns:bigint>>>"
_TREE = pa.struct([("root", pa.int32()), ("incomplete", pa.bool_()), ("up", pa.list_(pa.int32())), ("cut", pa.list_(pa.bool_())), *((c, pa.list_(pa.int32())) for c in ("first", "last", "depth", "n_kids"))])
_ERRORS = pa.struct([("bad", pa.list_(pa.bool_())), ("leaves", pa.list_(pa.int32())), ("path", pa.list_(pa.int32()))])
_SEGMENT, _SELF = pa.struct([("span", pa.int32()), ("start_ns", pa.int64()), ("end_ns", pa.int64())]), pa.struct([("span", pa.int32()), ("ns", pa.int64())])
_CRITICAL = pa.struct([("segments", pa.list_(_SEGMENT)), ("self_times", pa.list_(_SELF))])


def _values(column: pa.Array) -> list:
    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type) or pa.types.is_string(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _lists(column: pa.Array) -> Iterator[list]:
    """The rows of a column; lists are cut from all their values at once."""
    if not pa.types.is_list(column.type) or column.null_count:
        yield from _values(column)
        return
    values, start = _values(column.flatten()), 0
    for n in column.value_lengths().to_pylist():
        yield values[start : start + n]
        start += n


def _rows(*columns: pa.Array):  # noqa: ANN202
    return zip(*map(_lists, columns), strict=True)


def root_of(ids: Sequence[str], parents: Sequence[str], starts: Sequence[int]) -> int:
    """The root of tree_of, without the tree where some span has no parent in the trace and no two have one id."""
    known = set(ids)
    if len(known) < len(ids):
        return tree_of(ids, parents, starts).root
    tops = [i for i, p in enumerate(parents) if not p or p == ids[i] or p not in known]
    return min(tops, key=lambda i: (starts[i], ids[i])) if tops else tree_of(ids, parents, starts).root


def _root(ids: pa.Array, parents: pa.Array, starts: pa.Array) -> pa.Array:
    return pa.array([root_of(*row) for row in _rows(ids, parents, starts)], pa.int32())


def _tree(ids: pa.Array, parents: pa.Array, starts: pa.Array) -> pa.Array:
    return pa.array([tree_of(*row)._asdict() for row in _rows(ids, parents, starts)], _TREE)


def _errors(ids: pa.Array, parents: pa.Array, starts: pa.Array, ends: pa.Array, own: pa.Array, logged: pa.Array) -> pa.Array:
    out = []
    for names, above, begins, stops, bad, at in _rows(ids, parents, starts, ends, own, logged):
        tree, place = tree_of(names, above, begins), {}
        for i in sorted(range(len(names)), key=begins.__getitem__, reverse=True):
            place[names[i]] = i
        for span_id in at:
            bad[place.get(span_id, tree.root)] = True
        leaves = error_leaves_of(tree, names, begins, stops, bad)
        out.append({"bad": bad, "leaves": leaves, "path": path_of(tree, leaves[0]) if leaves else []})
    return pa.array(out, _ERRORS)


def _critical(ids: pa.Array, parents: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for names, above, begins, stops in _rows(ids, parents, starts, ends):
        found, total = critical_path_of(tree_of(names, above, begins), names, begins, stops), {}
        for i, a, b in found:
            total[i] = total.get(i, 0) + b - a
        own = sorted(total.items(), key=lambda x: (-x[1], names[x[0]]))
        out.append({"segments": [{"span": i, "start_ns": a, "end_ns": b} for i, a, b in found], "self_times": [{"span": i, "ns": ns} for i, ns in own]})
    return pa.array(out, _CRITICAL)


def _critical_places(ids: pa.Array, parents: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    return pa.array([critical_places_of(*row) for row in _rows(ids, parents, starts, ends)], pa.list_(pa.int32()))


def _path(up: pa.Array, to: pa.Array) -> pa.Array:
    out = []
    for above, i in _rows(up, to):
        path = [i]
        while above[path[-1]] >= 0:
            path.append(above[path[-1]])
        out.append(path[::-1])
    return pa.array(out, pa.list_(pa.int32()))


def _shown(ids: pa.Array, first: pa.Array, last: pa.Array, matches: pa.Array) -> pa.Array:
    out = []
    for names, begin, end, wanted in _rows(ids, first, last, matches):
        wanted, marks = set(wanted), [0] * len(names)
        for i, name in enumerate(names):
            marks[begin[i]] = int(name in wanted)
        upto = [0, *accumulate(marks)]
        out.append([{"span": i, "is_context": not marks[begin[i]]} for i in range(len(names)) if upto[end[i] + 1] > upto[begin[i]]])
    return pa.array(out, pa.list_(pa.struct([("span", pa.int32()), ("is_context", pa.bool_())])))


def _longest(ops: pa.Array, ns: pa.Array) -> pa.Array:
    rows = pa.array(np.repeat(np.arange(len(ops)), ops.value_lengths().to_numpy()))
    found = pa.table({"row": rows, "op": ops.flatten(), "ns": ns.flatten()}).group_by(["row", "op"]).aggregate([("ns", "max")]).sort_by([("row", "ascending"), ("op", "ascending")]).combine_chunks()
    ends = np.searchsorted(found["row"].to_numpy(), np.arange(len(ops) + 1)).astype(np.int32)
    column = lambda name, kind: pa.concat_arrays([pa.array([], kind), *found[name].cast(kind).chunks])
    items = pa.StructArray.from_arrays([column("op", pa.string()), column("ns_max", pa.int64())], ["op", "ns"])
    return pa.ListArray.from_arrays(pa.array(ends), items)


def at(spans: Column, places: Column) -> Column:
    """The elements of an array at some places, in their order."""
    return F.transform(places, lambda i: F.get(spans, i))


def field(name: str) -> Column:
    return F.col(f"spans.{name}")


def bundles(spans: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """(trace_id, spans, logs): all spans and logs of each trace that has spans, brought together by one shuffle.

    spans and logs are arrays of structs of the other columns, in no set order; without logs there is no such column.
    Replayed spans must be gone; of two with one id the later is a span without children.
    """
    own = F.struct(*(c for c in spans.columns if c != "trace_id"))
    if logs is None:
        return spans.groupBy("trace_id").agg(F.collect_list(own).alias("spans"))
    said = F.struct(*(c for c in logs.columns if c != "trace_id"))
    one = spans.select("trace_id", own.alias("span"))
    both = one.unionByName(logs.where("trace_id <> ''").select("trace_id", said.alias("log")), allowMissingColumns=True)
    return both.groupBy("trace_id").agg(F.collect_list("span").alias("spans"), F.collect_list("log").alias("logs")).where(F.size("spans") > 0)


def with_tree(traces: DataFrame) -> DataFrame:
    """traces with tree (see TREE)."""
    return traces.withColumn("tree", F.arrow_udf(_tree, TREE)(field("span_id"), field("parent_span_id"), field("start_ns")))


def with_root(traces: DataFrame) -> DataFrame:
    """traces with root, the place of the tree's root."""
    return traces.withColumn("root", F.arrow_udf(_root, "int")(field("span_id"), field("parent_span_id"), field("start_ns")))


def with_errors(traces: DataFrame, severe: int) -> DataFrame:
    """traces (spans with thrown) with errors (see ERRORS): by status, an exception or a severe log at the span; leaves and the path to the first."""
    own = F.transform("spans", lambda s: (s["status"] == "error") | s["thrown"])
    severe_at = F.transform(F.filter("logs", lambda x: x["severity_number"] >= severe), lambda x: x["span_id"]) if "logs" in traces.columns else F.array().cast("array<string>")
    return traces.withColumn("errors", F.arrow_udf(_errors, ERRORS)(field("span_id"), field("parent_span_id"), field("start_ns"), field("end_ns"), own, severe_at))


def with_critical_path(traces: DataFrame) -> DataFrame:
    """traces with critical (see CRITICAL): the path's segments, and each span's time on it, the longest first, ties by span id."""
    return traces.withColumn("critical", F.arrow_udf(_critical, CRITICAL)(field("span_id"), field("parent_span_id"), field("start_ns"), field("end_ns")))


def critical_places() -> Column:
    """Of a row of bundles: see critical_places_of."""
    return F.arrow_udf(_critical_places, "array<int>")(field("span_id"), field("parent_span_id"), field("start_ns"), field("end_ns"))


def error_leaves(bad: Column) -> Column:
    """Of a row of bundles: the places of error spans without errors below them, in the order they ended."""
    return F.arrow_udf(_errors, ERRORS)(field("span_id"), field("parent_span_id"), field("start_ns"), field("end_ns"), bad, F.array().cast("array<string>"))["leaves"]


def with_path(traces: DataFrame, to: Column) -> DataFrame:
    """traces (with tree) with path, the indices from the top to a span."""
    return traces.withColumn("path", F.arrow_udf(_path, "array<int>")(F.col("tree.up"), to))


def op_durations() -> Column:
    """Of a row of bundles: the longest duration of each service:name, by name."""
    return F.arrow_udf(_longest, "array<struct<op:string,ns:bigint>>")(F.transform("spans", lambda s: F.concat_ws(":", s["service"], s["name"])), F.transform("spans", lambda s: s["end_ns"] - s["start_ns"]))


def with_context(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """(trace_id, span_id, is_context): the matches (trace_id, span_id) that spans has, and what is above them as context."""
    rows = with_tree(bundles(spans.select("trace_id", "span_id", "parent_span_id", "start_ns"), matches.select("trace_id", "span_id")).where(F.size("logs") > 0))
    shown = F.arrow_udf(_shown, "array<struct<span:int,is_context:boolean>>")(field("span_id"), F.col("tree.first"), F.col("tree.last"), F.col("logs.span_id"))
    named = F.transform(shown, lambda x: F.struct(F.get("spans", x["span"])["span_id"].alias("span_id"), x["is_context"].alias("is_context")))
    return rows.select("trace_id", F.explode(named).alias("x")).select("trace_id", "x.*")


def nested_intervals(spans: DataFrame) -> DataFrame:
    """One row (trace_id, span_id, parent_id, depth, first, last, cut) for each span, however deep its trace.

    Spans are numbered in depth-first order, children by (start_ns, span_id); what lies below a span has first in
    (first, last] of it. Cycles are cut and their cut spans stand as tops.
    """
    rows = with_tree(bundles(spans.select("trace_id", "span_id", "parent_span_id", "start_ns")))

    def one(s: Column, i: Column) -> Column:
        above = F.get("tree.up", i)
        own = [F.get(f"tree.{c}", i).alias(c) for c in ("depth", "first", "last", "cut")]
        return F.struct(s["span_id"].alias("span_id"), F.when(above >= 0, F.get("spans", above)["span_id"]).alias("parent_id"), *own)

    return rows.select("trace_id", F.explode(F.transform("spans", one)).alias("x")).select("trace_id", "x.*")
