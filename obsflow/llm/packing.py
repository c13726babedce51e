"""Packing documents into sequences of a fixed length by a configuration linear program.

A configuration is a multiset of piece lengths that fits a sequence. The program covers the length histogram with as
few configurations as possible. It is solved by multiplicative weights: every length has a price that falls as the
length is covered, a knapsack dynamic program finds the configuration of the highest price, and its share of the
solution grows. Whole copies of the configurations are taken, what is left over is a smaller program of the same kind,
and what whole copies leave over goes where it fits best, equal sequences together.

The program sees the histogram alone (at most one row for each length), so it costs the same for any corpus. Pieces
are then dealt to the places of their length by rank, with ranks counted in parts so that a very common length does
not meet in one task.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsflow.llm.common import groups_of_rows, only, stored
from obsflow.llm.tokens import tokenizer

#: The program is solved so often at most, each time from so many configurations.
ROUNDS, TRIES = 12, 500
#: Ranks within a length are below 2 to this.
RANK_BITS = 44


def best_configuration(prices: np.ndarray, capacity: int, steps: np.ndarray) -> np.ndarray:
    """The lengths (with repeats) of the highest total price that fit; steps are the lengths there are, rising."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    price = prices[steps]
    first = int(steps[0]) if len(steps) else capacity + 1
    fit = np.searchsorted(steps, np.arange(capacity + 1), side="right")
    for room in range(first, capacity + 1):
        value = best[room - steps[: fit[room]]] + price[: fit[room]]
        k = int(value.argmax())
        best[room], took[room] = value[k], steps[k]
    out, room = [], capacity
    while room >= first and took[room]:
        out.append(int(took[room]))
        room -= took[room]
    return np.asarray(out, np.int64)


def cover(counts: np.ndarray, capacity: int, rounds: int = TRIES, rate: float = 0.08, step: float = 0.5) -> list[tuple[np.ndarray, float]]:
    """A fractional solution: configurations and how often each is used, to cover counts[length] pieces of each length."""
    steps = np.flatnonzero(counts)
    covered = np.zeros(len(counts))
    used: dict[bytes, float] = {}
    for _ in range(rounds):
        prices = np.arange(len(counts)) * np.exp(-rate * covered)
        found = best_configuration(prices, capacity, steps)
        lengths, times = np.unique(found, return_counts=True)
        amount = step / (times / counts[lengths]).max()
        covered[lengths] += amount * times / counts[lengths]
        key = np.sort(found)[::-1].tobytes()
        used[key] = used.get(key, 0.0) + amount
        if covered[steps].min() >= 1:
            break
    scale = 1 / max(1.0, float(np.median(covered[steps])))
    return [(np.frombuffer(key, np.int64), amount * scale) for key, amount in used.items()]


def patterns(counts: np.ndarray, capacity: int, least: int = 3000) -> list[tuple[list[int], int]]:
    """Configurations and whole numbers of copies that hold every piece of the histogram exactly once.

    Full configurations are taken first; where the program hardly finds any more, its configurations of any fill are.
    The program is solved at least once, then again for what whole copies leave over, until no more than `least` pieces
    are left, a round places few, or ROUNDS are done. What is left after each round can be packed by best fit, in groups of
    equal sequences, so that the number of patterns depends on the capacity alone; the round that needs the fewest
    sequences counts, or best fit alone where it needs fewer (as where most pieces are over half a sequence).
    """
    total = lambda found: sum(copies for _, copies in found)
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    if left[capacity]:
        out.append(([capacity], int(left[capacity])))
        left[capacity] = 0
    full, best = True, []
    for turn in range(ROUNDS):
        before = left.sum()
        if not before or (turn and before <= least):
            break
        for lengths, amount in sorted(cover(left, capacity), key=lambda x: (int(x[0].sum()) - capacity, -x[1]), reverse=True):
            if full and lengths.sum() * 200 < capacity * 199:
                continue
            kinds, times = np.unique(lengths, return_counts=True)
            copies = int(min(np.ceil(amount) if full else np.floor(amount), (left[kinds] // times).min()))
            if copies > 0:
                left[kinds] -= times * copies
                out.append((lengths.tolist(), copies))
        found = out + best_fit(left, capacity)
        if not best or total(found) < total(best):
            best = found
        if before - left.sum() < before / 50:
            if not full:
                break
            full = False
    alone = best_fit(counts, capacity)
    return alone if not best or total(alone) < total(best) else best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """The longest pieces first, each into the fullest sequence it fits; equal sequences are filled together.

    Best fit puts pieces of one length into a sequence until no more fits, then into the next. So each length fills
    whole groups of equal sequences, except for one that is split, and starts two kinds of sequence at most.
    """
    rooms: dict[int, list[tuple[list[int], int]]] = {}

    def put(room: int, sequence: list[int], copies: int) -> None:
        if copies:
            rooms.setdefault(room, []).append((sequence, copies))

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        for room in sorted(r for r in rooms if r >= length):
            fit = room // length
            while n and rooms[room]:
                sequence, copies = rooms[room].pop()
                whole = min(copies, n // fit)
                more = n - whole * fit if whole < copies else 0
                put(room - fit * length, sequence + [length] * fit, whole)
                if more:
                    put(room - more * length, sequence + [length] * more, 1)
                put(room, sequence, copies - whole - (more > 0))
                n -= whole * fit + more
            if not n:
                break
        fit = capacity // length
        put(capacity - fit * length, [length] * fit, n // fit)
        put(capacity - n % fit * length, [length] * (n % fit), int(n % fit > 0))
    return [group for groups in rooms.values() for group in groups]


def slots(found: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first sequence, copies, offset): where the pieces of a length go by their rank.

    Equal lengths of a pattern are one row: its ranks run through the copies, and through them again one length on.
    """
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, copies in found:
        offset = 0
        for length, same in itertools.groupby(sorted(lengths, reverse=True)):
            times = len(list(same))
            rank = ranks.get(length, 0)
            out.append((length, rank, rank + copies * times, sequence, copies, offset))
            ranks[length] = rank + copies * times
            offset += length * times
        sequence += copies
    return out


def most_slots(capacity: int) -> int:
    """A bound of the rows of slots() that no corpus exceeds: a pattern of d different lengths has d(d + 1) / 2 tokens at least."""
    kinds = int((np.sqrt(8 * capacity + 1) - 1) / 2)
    return 1 + (ROUNDS * TRIES + 4 * capacity) * kinds


def placed(ranked: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """ranked (with length and rank) with sequence_id and offset: each piece finds its row by a binary search."""
    rows = sorted(rows) or [(0, 0, 0, 0, 1, 0)]
    length_of, start, _, first, copies, offset = (np.asarray(x, np.int64) for x in zip(*rows, strict=True))
    key = (length_of << RANK_BITS) + start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            k = np.searchsorted(key, (length << RANK_BITS) + rank, side="right") - 1
            again, copy = np.divmod(rank - start[k], copies[k])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(c) for c in names] + [pa.array(first[k] + copy), pa.array(offset[k] + again * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pieces(docs: DataFrame, path: str, end: int, capacity: int) -> DataFrame:
    """The pieces of each text's ids and end id: whole if they fit, else cut so that only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in groups_of_rows(batches, "text", 8 << 20):
            ids, lengths = encode(batch.column("text"))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end).astype("<u4")
            rows: list[tuple[int, int, int, int, int]] = []
            at = 0
            for k, n in enumerate((lengths + 1).tolist()):
                start, size = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    rows.append((k, piece, start, size, zlib.crc32(ids[at + start : at + start + size])))
                    start, size = start + size, capacity
                at += n
            k, piece, start, size, crc = (np.asarray(x) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(k)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, end: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece.

    A null or empty text is one piece that holds the end id. Repeated rows are packed each on its own; an empty table
    gives no rows; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    cut = stored(pieces(only(docs, doc_id="long", text="string"), path, end, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most one row for each length up to the capacity
        counts[length] = n
    rows = slots(patterns(counts, capacity))
    if len(rows) > most_slots(capacity):
        raise RuntimeError(f"{len(rows)} rows of places, more than the capacity allows")
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    return placed(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), rows)
