"""Assembly by buckets of traces: calls to state follow buckets, and what comes out is what each trace alone gives."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
from test_assembly_calls import Clock, Handle

from obsflow.streaming import assembly


class Map(dict):
    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def getValue(self, key):  # noqa: N802
        self.calls["get"] += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls["update"] += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls["remove"] += 1
        del self[key]


class BucketHandle(Handle):
    def getMapState(self, *_):  # noqa: N802
        self.maps = [*getattr(self, "maps", ()), Map(self.calls)]
        return self.maps[-1]


class Expired:
    def __init__(self, at):
        self.getExpiryTimeInMs = lambda: at


def bucket(*limits):
    handle, made = BucketHandle(), assembly._Buckets(*limits)
    made.init(handle)
    return handle, made


def packed(records):
    """(trace, kind, id, row) as the rows of a call, a few records in each."""
    for k in range(0, len(records), 7):
        found = defaultdict(lambda: ([], [], []))
        for trace, *fields in records[k : k + 7]:
            for column, value in zip(found[trace], fields, strict=True):
                column.append(value)
        yield {"records": assembly._pack_rows([(t, *columns) for t, columns in found.items()], assembly.BUNDLES)}


def sent(rows):
    return [(t, kind, row, closing) for r in rows for t, kinds, texts, closing in assembly._unpack_rows(r.records) for kind, row in zip(kinds, texts, strict=True)]


def fire(handle, made, now, key=("b",)):
    """What Spark does with timers: each that is due once, then it is deleted."""
    out = []
    for at in sorted(t for t in handle.timers if t <= now):
        out += made.handleExpiredTimer(key, Clock(now), Expired(at))
        handle.timers.discard(at)
    return out


def test_calls_follow_buckets_not_traces():
    handle, made = bucket(100, 1000, 60, 5000)
    records = [(f"t{k}", "span", f"s{j}", f"{k}.{j}") for k in range(500) for j in range(3)]
    assert list(made.handleInputRows(("b",), packed(records + records[:300]), Clock(0))) == []
    assert list(made.handleInputRows(("b",), packed(records[:30] + [("t0", "log", "s0", "l")]), Clock(40))) == []
    out = sent(fire(handle, made, 100)) + sent(fire(handle, made, 140))
    assert Counter(out) == Counter((t, kind, row, "closed") for t, kind, _, row in [*records, ("t0", "log", "s0", "l")])
    assert sent(made.handleInputRows(("b",), packed([records[0], records[-1]]), Clock(150))) == [("t0", "span", "0.0", "late"), ("t499", "span", "499.2", "late")]
    assert handle.calls.total() <= 40  # 500 traces alone take thousands
    parts, gone = handle.maps
    assert not parts and gone
    assert fire(handle, made, 10_000) == [] and not gone and not handle.timers and made._index.value is None


def test_a_bucket_gives_what_its_traces_give_alone(monkeypatch):
    monkeypatch.setattr(assembly, "PART_CHARS", 20)
    kinds = Counter()
    for seed in range(30):
        dice, limits = random.Random(seed), (60, 200, 6, 320)
        handle, made = bucket(*limits)
        alone = {}
        now = 0
        for _ in range(60):
            now += dice.choice([7, 20, 45, 90, 400])
            records = [(dice.choice(["a", "b", "c", "d", None]), dice.choice(["span", "span", "log"]), dice.choice(["", None, "1", "2", "3", "4", "5", "6"]), f"r{dice.random()}") for _ in range(dice.choice([0, 1, 3, 9]))]
            got = sent(made.handleInputRows(("b",), packed(records), Clock(now))) if records else []
            got += sent(fire(handle, made, now))
            want = []
            for trace in dict.fromkeys(r[0] for r in records):
                if trace not in alone:
                    alone[trace] = Handle(), assembly._Assembler(*limits)
                    alone[trace][1].init(alone[trace][0])
                single, rows = alone[trace][1], [{"kind": kind, "id": name, "row": row} for t, kind, name, row in records if t == trace]
                closed = single._window.value
                if closed and closed[2] and closed[3] <= now:  # forgotten before this batch
                    single._window.clear()
                    alone[trace][0].timers.discard(closed[3])
                want += single.handleInputRows((trace,), iter(rows), Clock(now))
            for trace, (own, single) in alone.items():
                want += fire(own, single, now, (trace,))
            assert Counter(got) == Counter(map(tuple, want)), (seed, now)
            kinds.update(r[3] for r in got)
            assert len(handle.timers) <= 1
    assert min(kinds[c] for c in ("closed", "truncated", "late")) > 50


def test_packing_keeps_every_record(spark, monkeypatch):
    monkeypatch.setattr(assembly, "PACK_BYTES", 1 << 10)
    rows = [(f"t{k % 41}" if k % 11 else None, "log" if k % 5 == 0 else "span", f"i{k}" if k % 3 else None, f"r{k}") for k in range(3000)]
    found = assembly.packed(assembly.bundled(spark.createDataFrame(rows, "trace_id string, kind string, id string, row string")), 8).collect()
    assert len({r.bucket for r in found}) <= 8
    of = defaultdict(set)
    out = []
    for r in found:
        for trace, *columns in assembly._unpack_rows(r.records):
            of[trace].add(r.bucket)
            out += [(trace, *fields) for fields in zip(*columns, strict=True)]
    assert sorted(out, key=repr) == sorted(rows, key=repr) and all(len(b) == 1 for b in of.values())
    assert isinstance(assembly._unpack(found[0].records), pa.RecordBatch)


