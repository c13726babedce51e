"""How often the assembler of traces leaves its task for state: by traces, not by records."""

from collections import Counter

from obsflow.streaming import assembly


class State:
    def __init__(self, calls, empty):
        self.calls, self.value, self.empty = calls, empty, empty

    def get(self):
        self.calls["get"] += 1
        return self.value

    def exists(self):
        self.calls["exists"] += 1
        return bool(self.value)

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    def appendList(self, values):  # noqa: N802
        self.calls["append"] += 1
        self.value = [*self.value, *values]

    def clear(self):
        self.calls["clear"] += 1
        self.value = self.empty


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getListState(self, *_):  # noqa: N802
        return State(self.calls, [])

    def getValueState(self, *_):  # noqa: N802
        return State(self.calls, None)

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.remove(at)


class Clock:
    def __init__(self, now):
        self.getCurrentProcessingTimeInMs = lambda: now


def test_calls_follow_traces_not_records():
    handle, made = Handle(), assembly._Assembler(100, 1000, 60, 5000)
    made.init(handle)
    rows = [{"kind": "span", "id": f"s{k}", "row": str(k)} for k in range(50)]
    assert list(made.handleInputRows(("t",), iter(rows + rows), Clock(0))) == []
    assert handle.calls.total() <= 4 and handle.timers == {100}
    assert list(made.handleInputRows(("t",), iter(rows[:9] + [{"kind": "log", "id": "s1", "row": "l"}]), Clock(40))) == []  # replays, and a log
    assert handle.calls.total() <= 11 and handle.timers == {140}
    out = list(made.handleExpiredTimer(("t",), Clock(140), None))
    assert [r.row for r in out] == [*map(str, range(50)), "l"] and {r.closing for r in out} == {"closed"}
    assert handle.calls.total() <= 17 and handle.timers == {5140}
    assert [r.closing for r in made.handleInputRows(("t",), iter(rows[:2]), Clock(200))] == ["late", "late"]


def test_a_trace_that_is_too_long_closes_at_once():
    handle, made = Handle(), assembly._Assembler(100, 1000, 3, 5000)
    made.init(handle)
    out = list(made.handleInputRows(("t",), iter([{"kind": "span", "id": f"s{k}", "row": str(k)} for k in range(6)]), Clock(0)))
    assert [(r.row, r.closing) for r in out] == [(str(k), "truncated" if k < 4 else "late") for k in range(6)] and handle.timers == {5000}
