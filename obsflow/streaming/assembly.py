"""Traces from span streams: session windows per trace, late spans, raw copies, analysis of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from obsflow.operators.stories import stories_of, told_traces
from obsflow.operators.traces import edges_of, severe_places, summaries_of, with_error_flags
from obsflow.sources.checkpoint import cut

GAP_MS, MAX_AGE_MS, MAX_SPANS = 10_000, 60_000, 10_000  # fixed defaults
BUCKETS = 1024  # of traces; part of what a checkpoint holds
PACK_BYTES, PART_CHARS = 64 << 20, 8 << 20  # what a task gathers before it packs bundles by bucket; what one packed value holds
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessionize_batch(records: DataFrame, gap_ms: int = GAP_MS, max_age_ms: int = MAX_AGE_MS, max_spans: int = MAX_SPANS) -> DataFrame:
    """Stored spans (trace_id, arrival_ms, seq) with late and truncated: the first window of each trace stays, what comes after its close is late."""
    w = Window.partitionBy("trace_id").orderBy("arrival_ms", "seq")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    opened = F.min("arrival_ms").over(Window.partitionBy("trace_id"))
    marked = records.withColumns({"_gap": F.coalesce(F.col("arrival_ms") - F.lag("arrival_ms").over(w) >= gap_ms, F.lit(False)), "_n": F.row_number().over(w), "_opened": opened})
    broke = F.col("_gap") | (F.col("arrival_ms") - F.col("_opened") >= max_age_ms) | (F.col("_n") > max_spans + 1)
    flagged = marked.withColumn("late", F.max(broke).over(running))
    truncated = F.max(~F.col("late") & (F.col("_n") > max_spans)).over(Window.partitionBy("trace_id"))
    return flagged.withColumn("truncated", truncated).drop("_gap", "_n", "_opened")


def event_time_sessions(spans: DataFrame, gap: str = "10 seconds", watermark: str = "1 minute") -> DataFrame:
    """Sessions per trace by event time, for replays; batch or stream."""
    stamped = spans.withColumn("ts", F.timestamp_micros(F.expr("start_ns div 1000")))
    if stamped.isStreaming:
        stamped = stamped.withWatermark("ts", watermark)
    return stamped.groupBy("trace_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_spans")).select(
        "trace_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n_spans"
    )


def records_of(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Spans and logs as one stream of records (trace_id, kind, id, row): id tells replays, row is JSON."""
    span = spans.select("trace_id", F.lit("span").alias("kind"), F.col("span_id").alias("id"), F.to_json(F.struct(*spans.columns)).alias("row"))
    log_id = F.concat_ws("\0", F.col("ts_ns").cast("string"), "span_id", "body")
    log = logs.where("trace_id <> ''").select("trace_id", F.lit("log").alias("kind"), log_id.alias("id"), F.to_json(F.struct(*logs.columns)).alias("row"))
    return span.unionByName(log)


class Out(NamedTuple):
    trace_id: str
    kind: str
    row: str
    closing: str


class Sent(NamedTuple):
    """Records of a trace that are sent on with one closing."""

    trace_id: str
    kinds: list[str]
    rows: list[str]
    closing: str


class _Assembler(StatefulProcessor):
    """Per trace: its records until it closes, then a marker for a while, so that late records are known as such.

    Every use of state is a call out of the task, and every value in it is pickled, so there are as few as possible: what
    comes in one call is one value of a list (kinds, ids and rows), the ids are read again only for a trace that was open
    before, and the window knows its timer.
    """

    def __init__(self, gap_ms: int, max_age_ms: int, max_spans: int, remember_ms: int):
        self._limits = gap_ms, max_age_ms, max_spans, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._records = handle.getListState("records", "kinds array<string>, ids array<string>, rows array<string>")
        self._window = handle.getValueState("window", "opened long, n_spans long, closed boolean, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Out]:  # noqa: ANN001, N802, N803
        gap, age, most, _ = self._limits
        now = timerValues.getCurrentProcessingTimeInMs()
        window = self._window.get()
        opened, n_spans, closed, due = window or (now, 0, False, None)
        if closed:
            yield from (self._out(key[0], r["kind"], r["row"], "late") for r in rows)
            return
        seen = {(kind, name) for kind, name, _ in self._stored()} if window else set()
        new = []
        for r in rows:
            kind, name, row = r["kind"], r["id"], r["row"]
            if closed:
                yield self._out(key[0], kind, row, "late")
                continue
            if name and (kind, name) in seen:  # a replay: neither kept nor counted
                continue
            seen.add((kind, name))
            new.append((kind, name, row))
            n_spans += kind == "span"
            if n_spans > most:
                yield from self._close(key[0], now, opened, due, bool(window), new, "truncated")
                closed = True
        if closed:
            return
        if new:
            self._records.appendList([tuple(map(list, zip(*new, strict=True)))])
        after = min(now + gap, opened + age)
        if after != due:
            if due is not None:
                self._handle.deleteTimer(due)
            self._handle.registerTimer(after)
        self._window.update((opened, n_spans, False, after))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Out]:  # noqa: ANN001, N802, N803
        opened, _, closed, due = self._window.get()
        if closed:  # the trace is forgotten
            self._window.clear()
        else:
            yield from self._close(key[0], timerValues.getCurrentProcessingTimeInMs(), opened, due, True, [], "closed")

    def _close(self, trace_id: str, now: int, opened: int, due: int | None, stored: bool, more: list[tuple[str, str, str]], closing: str) -> Iterator[Out]:
        if stored:
            yield from [self._out(trace_id, kind, row, closing) for kind, _, row in self._stored()]
            self._records.clear()
        yield from (self._out(trace_id, kind, row, closing) for kind, _, row in more)
        if due is not None:
            self._handle.deleteTimer(due)
        forget = now + self._limits[3]
        self._window.update((opened, 0, True, forget))
        self._handle.registerTimer(forget)

    def _stored(self) -> Iterator[tuple[str, str, str]]:
        for columns in self._records.get():
            yield from zip(*columns, strict=True)

    @staticmethod
    def _out(trace_id: str, kind: str, row: str, closing: str) -> Out:
        return Out(trace_id, kind, row, closing)

    def close(self) -> None:
        pass


class _Bundled(_Assembler):
    """_Assembler, where a row holds the kinds, ids and rows of many records: a row costs far more to exchange than what is in it."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Sent]:  # noqa: ANN001, N802, N803
        single = ({"kind": kind, "id": name, "row": row} for r in rows for kind, name, row in zip(r["kinds"], r["ids"], r["rows"], strict=True))
        return self._together(super().handleInputRows(key, single, timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Sent]:  # noqa: ANN001, N802, N803
        return self._together(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))

    @staticmethod
    def _together(out: Iterable[Out]) -> Iterator[Sent]:
        for (trace_id, closing), rows in groupby(out, key=lambda r: (r.trace_id, r.closing)):
            found = list(rows)
            yield Sent(trace_id, [r.kind for r in found], [r.row for r in found], closing)


def bundled(records: DataFrame) -> DataFrame:
    """(trace_id, kinds, ids, rows): the records of a trace that lie near each other in a task, in their order, as one row."""
    columns = ["kind", "id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by("trace_id", use_threads=False).aggregate([(c, "list") for c in columns])
            yield from found.select(["trace_id", *(f"{c}_list" for c in columns)]).rename_columns(["trace_id", *(f"{c}s" for c in columns)]).to_batches()

    return records.select("trace_id", *columns).mapInArrow(run, "trace_id string, kinds array<string>, ids array<string>, rows array<string>")


BUNDLES = pa.schema([("trace_id", pa.string()), *((c, pa.list_(pa.string())) for c in ("kinds", "ids", "rows"))])
_SENT = pa.schema([BUNDLES.field("trace_id"), BUNDLES.field("kinds"), BUNDLES.field("rows"), ("closing", pa.string())])
_WINDOWS = pa.schema([("trace_id", pa.string()), *((c, pa.int64()) for c in ("opened", "n_spans", "due", "since"))])
_CLOSED = pa.schema([("trace_id", pa.string()), ("forget", pa.int64())])


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack_rows(rows: Iterable[tuple], schema: pa.Schema) -> bytes:
    columns = zip(*rows, strict=True)
    return _pack(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def _unpack(packed: bytes | pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed).read_next_batch()


def _unpack_rows(packed: bytes | None) -> Iterator[tuple]:
    return zip(*map(_values, _unpack(packed).columns), strict=True) if packed else iter(())


def _values(column: pa.Array) -> list:
    """As to_pylist, which takes several times as long: texts, numbers without nulls, or lists of them."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    values, ends = _values(column.flatten()), np.cumsum(column.value_lengths().to_numpy()).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def _parts(bundles: Iterable[tuple], rows_at: int) -> Iterator[list[tuple]]:
    """Bundles in lists of about PART_CHARS."""
    part, size = [], 0
    for bundle in bundles:
        part.append(bundle)
        size += sum(len(row) for row in bundle[rows_at] if row)
        if size >= PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def packed(bundles: DataFrame, buckets: int) -> DataFrame:
    """(bucket, records): the bundles that a task has at a time, packed by the bucket of their trace."""
    columns = ["bucket", *BUNDLES.names]

    def of_buckets(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table["bucket"])).combine_chunks()
        found, starts = np.unique(table["bucket"].to_numpy(), return_index=True)
        ends = [*starts[1:], table.num_rows]
        values = [_pack(table.slice(a, b - a).select(BUNDLES.names).to_batches()[0]) for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(values, pa.binary())], ["bucket", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield of_buckets(held)
                held, size = [], 0
        if held:
            yield of_buckets(held)

    return bundles.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).cast("int")).select(*columns).mapInArrow(run, "bucket int, records binary")


class _Here:
    """A bucket's traces while they are looked at. To _Bundled it is the state of one of them: that of the trace `at`."""

    def __init__(self, windows: dict, load: Callable[[], dict]):
        self.windows, self.new, self.at = windows, {}, None
        self._load, self._old = load, None

    @property
    def old(self) -> dict[str, list[tuple]]:
        """What is stored of the open traces, read when it is first asked for."""
        if self._old is None:
            self._old = self._load()
        return self._old

    @property
    def is_read(self) -> bool:
        return self._old is not None

    def getListState(self, *_) -> _StoredHere:  # noqa: ANN002, N802
        return _StoredHere(self)

    def getValueState(self, *_) -> _WindowHere:  # noqa: ANN002, N802
        return _WindowHere(self)

    def registerTimer(self, _: int) -> None:  # noqa: N802
        pass  # the bucket has one timer, for the earliest of its windows

    deleteTimer = registerTimer  # noqa: N815


class _StoredHere:
    def __init__(self, here: _Here):
        self._here = here

    def get(self) -> list[tuple]:
        return [*self._here.old.get(self._here.at, ()), *self._here.new.get(self._here.at, ())]

    def appendList(self, values: list[tuple]) -> None:  # noqa: N802
        self._here.new.setdefault(self._here.at, []).extend(values)

    def clear(self) -> None:
        self._here.old.pop(self._here.at, None)
        self._here.new.pop(self._here.at, None)


class _WindowHere:
    def __init__(self, here: _Here):
        self._here = here

    def get(self) -> tuple | None:
        return self._here.windows.get(self._here.at)

    def update(self, window: tuple) -> None:
        self._here.windows[self._here.at] = window

    def clear(self) -> None:
        self._here.windows.pop(self._here.at, None)


class _Buckets(StatefulProcessor):
    """_Bundled for all traces of a bucket, so that calls to state follow buckets, not traces.

    index: the open windows, the numbers of the parts, the times of what is gone, and the timer. parts: what came in one
    call, packed; when half of what they hold has been sent on, the rest is written anew. gone: the closed traces, by the time
    until which some of them are remembered, in steps of a sixteenth of remember_ms.
    """

    def __init__(self, gap_ms: int, max_age_ms: int, max_spans: int, remember_ms: int):
        self._limits = gap_ms, max_age_ms, max_spans, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._index = handle.getValueState("index", "windows binary, parts array<long>, gone array<long>, due long")
        self._parts = handle.getMapState("parts", "part long", "records binary")
        self._gone = handle.getMapState("gone", "until long", "traces binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        came: dict[str, list[dict]] = {}
        for r in rows:
            for trace_id, *columns in _unpack_rows(r["records"]):
                came.setdefault(trace_id, []).append(dict(zip(BUNDLES.names[1:], columns, strict=True)))
        here, assembler = self._begin()
        known = self._closed(now) if self._gone_at and not here.windows.keys() >= came.keys() else {}
        here.windows = {t: (0, 0, True, forget) for t, forget in known.items() if t in came} | here.windows

        def sent() -> Iterator[Sent]:
            for here.at, bundles in came.items():
                yield from assembler.handleInputRows((here.at,), iter(bundles), timerValues)

        yield from self._send(sent())
        self._end(here, now, known.keys())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        here, assembler = self._begin()

        def sent() -> Iterator[Sent]:
            for here.at in [t for t, (_, _, _, due) in here.windows.items() if due <= now]:
                yield from assembler.handleExpiredTimer((here.at,), timerValues, expiredTimerInfo)

        yield from self._send(sent())
        for until in [u for u in self._gone_at if u <= now]:
            self._gone.removeKey((until,))
            self._gone_at.remove(until)
        self._end(here, now, (), expiredTimerInfo.getExpiryTimeInMs())

    def _begin(self) -> tuple[_Here, _Bundled]:
        windows, parts, gone, self._due = self._index.get() or (None, (), (), None)
        self._numbers, self._gone_at = list(parts), list(gone)
        found = {t: (w, since) for t, *w, since in _unpack_rows(windows)}
        self._since, self._held = {t: since for t, (_, since) in found.items()}, 0
        here = _Here({t: (opened, n_spans, False, due) for t, ((opened, n_spans, due), _) in found.items()}, self._read)
        assembler = _Bundled(*self._limits)
        assembler.init(here)
        return here, assembler

    def _read(self) -> dict[str, list[tuple]]:
        """The stored records of open traces; a trace that was closed and forgotten since has nothing in earlier parts."""
        found: dict[str, list[tuple]] = {}
        for number in self._numbers:
            for trace_id, *columns in _unpack_rows(self._parts.getValue((number,))[0]):
                self._held += 1
                if self._since.get(trace_id, number + 1) <= number:
                    found.setdefault(trace_id, []).append(tuple(columns))
        return found

    def _closed(self, now: int) -> dict[str, int]:
        """The closed traces that are still remembered."""
        return {t: forget for until in self._gone_at for t, forget in _unpack_rows(self._gone.getValue((until,))[0]) if forget > now}

    @staticmethod
    def _send(out: Iterable[Sent]) -> Iterator[Row]:
        for part in _parts(out, 2):
            yield Row(records=_pack_rows(part, _SENT))

    def _end(self, here: _Here, now: int, known: Iterable[str], expired: int | None = None) -> None:
        shut = {t: due for t, (_, _, closed, due) in here.windows.items() if closed and t not in known}
        opened = {t: w for t, w in here.windows.items() if not w[2]}
        if shut:
            step = max(1, self._limits[3] // 16)
            until = -(-(now + self._limits[3]) // step) * step
            before = _unpack_rows(self._gone.getValue((until,))[0]) if until in self._gone_at else ()
            self._gone.updateValue((until,), (_pack_rows([*before, *shut.items()], _CLOSED),))
            self._gone_at = [*{*self._gone_at, until}]
        new = here.new
        number = max(self._numbers, default=-1) + 1
        if here.is_read and self._numbers and 2 * sum(map(len, here.old.values())) <= self._held:
            for n in self._numbers:
                self._parts.removeKey((n,))
            self._numbers, self._since = [], {}
            new = {t: [*here.old.get(t, ()), *here.new.get(t, ())] for t in opened}
        self._since = {t: self._since.get(t, number) for t in opened}
        for number, part in enumerate(_parts(((t, *columns) for t, found in new.items() for columns in found), 3), number):  # noqa: B020
            self._parts.updateValue((number,), (_pack_rows(part, BUNDLES),))
            self._numbers.append(number)
        due = min([*(w[3] for w in opened.values()), *self._gone_at], default=None)
        if due != self._due:
            if self._due not in (None, expired):  # one that fired is deleted by Spark
                self._handle.deleteTimer(self._due)
            if due is not None:
                self._handle.registerTimer(due)
        if due is None:
            self._index.clear()
        else:
            windows = _pack_rows([(t, begun, n, at, self._since[t]) for t, (begun, n, _, at) in opened.items()], _WINDOWS) if opened else None
            self._index.update((windows, self._numbers, sorted(self._gone_at), due))

    def close(self) -> None:
        pass


def assemble_traces(records: DataFrame, gap_ms: int = GAP_MS, max_age_ms: int = MAX_AGE_MS, max_spans: int = MAX_SPANS, remember_ms: int = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """Streamed records (see records_of) with closing, by processing time: all records of a trace come out when it closes.

    closed: no new record for gap_ms, or open for max_age_ms; truncated: more than max_spans spans, of which replays do
    not count; late: what comes within remember_ms of the close. The session must use STATE_STORE. State holds the open
    traces and the ids of their records, in RocksDB, and a marker for each trace closed within remember_ms. Traces are
    dealt by their ids to buckets, of which a task holds one in memory at a time: more open traces want more buckets, whose
    number a checkpoint keeps for good.
    """
    out = packed(bundled(records), buckets).groupBy("bucket").transformWithState(
        statefulProcessor=_Buckets(gap_ms, max_age_ms, max_spans, remember_ms), outputStructType="records binary", outputMode="Append", timeMode="ProcessingTime"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                found = _unpack(value.as_buffer())
                of = pc.list_parent_indices(found["kinds"])
                yield pa.RecordBatch.from_arrays([found["trace_id"].take(of), found["kinds"].flatten(), found["rows"].flatten(), found["closing"].take(of)], ["trace_id", "kind", "row", "closing"])

    return out.mapInArrow(run, "trace_id string, kind string, row string, closing string")


def unpacked(records: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """The spans or logs among assembled records, with closing."""
    return records.where(F.col("kind") == kind).select("closing", F.from_json("row", schema).alias("r")).select("closing", "r.*")


def late_items(assembled: DataFrame) -> DataFrame:
    return assembled.where("closing = 'late'").groupBy("trace_id").agg(F.count("*").alias("n_late"))


def stream_raw(rows: DataFrame, path: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Copies a stream to a table by batch directory, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def analyze_batch(batch: DataFrame, batch_id: int, path: str, span_schema: T.StructType, log_schema: T.StructType, baselines: DataFrame | None = None, ops: DataFrame | None = None) -> None:
    """Summaries, stories and edges of the traces (assembled records) that one batch closes, under its id.

    The batch is stored first, which alone runs its assembly, then its traces as rows, after one shuffle; each analysis
    reads those. Tables are written in the given order, the additive one (edges) last; a batch that comes again replaces
    what it wrote, so its edges count once.
    """
    whole = cut(batch.where("closing <> 'late'"))
    if whole.isEmpty():
        return
    spans, logs = (unpacked(whole, k, schema) for k, schema in (("span", span_schema), ("log", log_schema)))
    cut_off = F.when(F.exists("spans", lambda s: s["closing"] == "truncated"), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    rows = cut(told_traces(spans, logs.drop("closing"), "closing").withColumns({"window_flags": cut_off, "severe_at": severe_places()}))
    flagged = with_error_flags(rows)
    write_batch(summaries_of(flagged), f"{path}/summaries", batch_id)
    write_batch(stories_of(rows, baselines, ops), f"{path}/stories", batch_id)
    write_batch(edges_of(flagged), f"{path}/edges", batch_id)


def analyze_stream(assembled: DataFrame, path: str, checkpoint: str, span_schema: T.StructType, log_schema: T.StructType, baselines: DataFrame | None = None, ops: DataFrame | None = None) -> StreamingQuery:
    """analyze_batch on each micro-batch of assembled records."""

    def write(batch: DataFrame, batch_id: int) -> None:
        analyze_batch(batch, batch_id, path, span_schema, log_schema, baselines, ops)

    return assembled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
