"""Token ids as range asymmetric numeral system (rANS) blocks.

One static frequency table, counted over the whole corpus, serves all blocks. A block holds whole documents in order;
its ids are dealt to interleaved lanes, all of which take one numpy step together. The states of the lanes and the
place in the word stream are kept at checkpoints, and every stretch between two checkpoints has its own checksum, so a
reader can decode the stretches of a block apart from each other and in parallel.

Block format, little-endian: magic 4 bytes, then unsigned 32-bit: documents, ids, lanes, steps between checkpoints,
stretches, words; then the documents' ids (64 bit), which of them are null (8 bit) and their lengths (64 bit); for
each stretch its first word (64 bit), its checksum (32 bit) and the lanes' states (64 bit); the words (32 bit); at
last the CRC-32 of all before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.llm.common import discard, groups_of_rows, only, shared_dir, stored
from obsflow.llm.tokens import tokenizer

MAGIC = b"RAN1"
BITS, LOW = 22, 1 << 31
LANES, EVERY = 1024, 256


@dataclass
class Table:
    """Frequencies that sum to 2**BITS, their running sums, and the symbol of each slot."""

    frequency: np.ndarray
    below: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Every id that occurs gets at least one slot; the rest is dealt in proportion."""
        seen = counts > 0
        spare = (1 << BITS) - int(seen.sum())
        if spare < 0 or not seen.any():
            raise ValueError("the number of different ids does not suit the table")
        frequency = np.where(seen, 1 + counts * spare // counts.sum(), 0).astype(np.int64)
        frequency[frequency.argmax()] += (1 << BITS) - int(frequency.sum())
        below = np.cumsum(frequency) - frequency
        return cls(frequency.astype(np.uint64), below.astype(np.uint64), np.repeat(np.arange(len(counts), dtype=np.uint32), frequency))


def encode_ids(ids: np.ndarray, table: Table) -> tuple[int, list[tuple[int, np.ndarray]], np.ndarray]:
    """Lanes, the checkpoints (first word, states) in reading order, and the words."""
    lanes = max(1, min(LANES, 1 << max(0, (len(ids) // 64).bit_length() - 1)))
    steps = -(-len(ids) // lanes)
    filled = np.full(steps * lanes, int(table.frequency.argmax()), np.int64)  # the last step is filled up with the cheapest id
    filled[: len(ids)] = ids
    frequency, below = table.frequency[filled].reshape(steps, lanes), table.below[filled].reshape(steps, lanes)
    limit = frequency << np.uint64(63 - BITS)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    points: list[tuple[int, np.ndarray]] = []
    total = 0
    for step in range(steps - 1, -1, -1):
        full = state >= limit[step]
        if full.any():
            out = (state[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            words.append(out)
            total += len(out)
            state[full] >>= np.uint64(32)
        quotient, rest = np.divmod(state, frequency[step])
        state = (quotient << np.uint64(BITS)) + rest + below[step]
        if step % EVERY == 0:
            points.append((total, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return lanes, [(total - at, states) for at, states in reversed(points)], stream


def decode_stretch(states: np.ndarray, words: np.ndarray, steps: int, table: Table) -> np.ndarray:
    state, at, mask = states.copy(), 0, np.uint64((1 << BITS) - 1)
    out = np.zeros((steps, len(states)), np.uint32)
    for step in range(steps):
        slot = state & mask
        symbol = table.symbol[slot]
        out[step] = symbol
        state = table.frequency[symbol] * (state >> np.uint64(BITS)) + slot - table.below[symbol]
        low = state < LOW
        if n := int(np.count_nonzero(low)):
            state[low] = (state[low] << np.uint64(32)) | words[at : at + n]
            at += n
    return out.reshape(-1)


def to_block(doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    lanes, points, words = encode_ids(ids, table)
    ends = [at for at, _ in points[1:]] + [len(words)]
    head = np.asarray([len(doc_ids), len(ids), lanes, EVERY, len(points), len(words)], "<u4").tobytes()
    parts = [MAGIC, head, doc_ids.astype("<i8").tobytes(), missing.astype("u1").tobytes(), lengths.astype("<i8").tobytes()]
    for (at, states), end in zip(points, ends, strict=True):
        parts += [np.asarray([at], "<u8").tobytes(), np.asarray([zlib.crc32(words[at:end].astype("<u4"))], "<u4").tobytes(), states.astype("<u8").tobytes()]
    body = b"".join([*parts, words.astype("<u4").tobytes()])
    return body + np.asarray([zlib.crc32(body)], "<u4").tobytes()


def from_block(data: bytes, table: Table, stretch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which are null, lengths, and the ids of the block or of one stretch of it."""
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("a block is damaged")
    docs, n, lanes, every, stretches, n_words = np.frombuffer(data, "<u4", 6, 4).tolist()
    at = 28
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    missing = np.frombuffer(data, "u1", docs, at + 8 * docs).astype(bool)
    lengths = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    points = []
    for _ in range(stretches):
        points.append((int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 12], "little"), np.frombuffer(data, "<u8", lanes, at + 12)))
        at += 12 + 8 * lanes
    words = np.frombuffer(data, "<u4", n_words, at)
    out, steps = [], -(-n // lanes)
    for k, (first, check, states) in enumerate(points):
        end = points[k + 1][0] if k + 1 < stretches else n_words
        if stretch in (None, k):
            if zlib.crc32(words[first:end]) != check:
                raise ValueError("a stretch of a block is damaged")
            ids = decode_stretch(states.astype(np.uint64), words[first:end].astype(np.uint64), min(every, steps - k * every), table)
            out.append(ids[: n - k * every * lanes])
    return doc_ids, missing, lengths, np.concatenate(out) if out else np.zeros(0, np.uint32)


def sorted_ids(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Rows in ascending doc_id order: parts by number, rows in them by number; before: ids earlier in the part. Nulls come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row, before = tokenizer(path).encode, TaskContext.get().partitionId(), 0, 0
        for batch in groups_of_rows(batches, "text", 8 << 20):
            ids, lengths = encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(lengths), end).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(lengths + 1)]) * 4
            packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(row, row + batch.num_rows)), pa.array(before + ends[:-1] // 4), batch.column("doc_id"), pa.array(lengths + 1), packed.cast(pa.binary())],
                ["part", "row", "before", "doc_id", "n_tokens", "ids"],
            )
            row += batch.num_rows
            before += len(ids)

    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(run, "part int, row long, before long, doc_id long, n_tokens long, ids binary")


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; at most one row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            values = batch.column("ids").cast(pa.large_binary())
            ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            if len(values) and ends[-1] > ends[0]:
                counts += np.bincount(np.frombuffer(values.buffers()[2], "<u4")[ends[0] // 4 : ends[-1] // 4], minlength=size)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for i, n in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def write(docs: DataFrame, path: str, end: int, to: str) -> None:
    """The ids of all texts as a table of blocks at to/blocks, whose files and rows follow the ids, and the frequencies at to/counts.

    A null or empty text has the end id alone; equal doc_ids and repeated rows keep a row each; an empty table gives
    a table without blocks. Columns besides doc_id and text are not read.
    """
    ids = stored(sorted_ids(only(docs, doc_id="long", text="string"), path, end), "ids")
    size = max(tokenizer(path).size, end + 1)
    counts = id_counts(ids, size)
    spark = docs.sparkSession
    seen = np.flatnonzero(counts)
    spark.createDataFrame([(int(i), int(counts[i])) for i in seen], "id int, n long").coalesce(1).write.parquet(f"{to}/counts")
    shared = spark.sparkContext.broadcast(counts)  # as long as the vocabulary
    sizes = sorted((r["part"], r["n"]) for r in ids.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each partition
    starts = {part: sum(n for _, n in sizes[:k]) for k, (part, _) in enumerate(sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in groups_of_rows(batches, "ids", 4 << 20):
            table = table or Table.of(shared.value)
            part = batch.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = batch.slice(a, b - a)
                values = own.column("ids").cast(pa.large_binary())
                ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
                flat = np.frombuffer(values.buffers()[2], "<u4")[ends[0] // 4 : ends[-1] // 4].astype(np.int64)
                missing = np.asarray(own.column("doc_id").is_null())
                lengths = own.column("n_tokens").to_numpy(zero_copy_only=False)
                block = to_block(own.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), missing, lengths, flat, table)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[a])], pa.int32()), pa.array([starts[int(part[a])] + own.column("before")[0].as_py()]), pa.array([len(flat)]), pa.array([block], pa.binary())],
                    ["part", "start", "n_tokens", "block"],
                )

    blocks = ids.mapInArrow(run, "part int, start long, n_tokens long, block binary")
    in_order = blocks.repartitionById(len(sizes) and sizes[-1][0] + 1 or 1, "part").sortWithinPartitions("start").drop("part")
    in_order.write.option("compression", "none").parquet(f"{to}/blocks")
    discard(ids)


def read(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document, decoded from the blocks."""
    blocks = spark.read.parquet(f"{at}/blocks")
    rows = spark.read.parquet(f"{at}/counts").collect()  # as long as the vocabulary
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    shared = spark.sparkContext.broadcast(counts)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for k in range(batch.num_rows):
                table = table or Table.of(shared.value)
                doc_ids, missing, lengths, ids = from_block(batch.column("block")[k].as_py(), table)
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer((np.concatenate([[0], ends]) * 4).astype(np.int64)), pa.py_buffer(ids)])
                start = batch.column("start")[k].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=missing), pa.array(start), pa.array(lengths), pa.array(np.asarray(crc, np.int64)), packed.cast(pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.select("start", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """What the files hold after writing: one row for each document (see read)."""
    to = f"{shared_dir(docs.sparkSession)}/rans-{np.random.default_rng().integers(1 << 62):x}"
    write(docs, path, end, to)
    return read(docs.sparkSession, to)
