"""Log-bilinear language model, trained with noise-contrastive estimation in numpy inside Spark tasks.

Units are the most frequent words, the end of a text, and a rest unit for the other words of each class (words are
classed by their endings, so that every class has about as many units). How many words are units of their own grows
with the training tokens (Sizes). The representations of the last units, each weighted by a vector for its distance, add up to a
prediction. Its products with the targets of the TOP words, the end and the classes, plus a bias, are the scores of the
first step; within a class its products with the targets of the class's units are the scores of the second. A word
without a unit then has its add-0.1 frequency within the rest of its class. Both steps are normalised, so a text's
score is a normalised log-probability, and the cost of a token grows with the root of the units only.

Training tells real units from noise drawn by frequency, in both steps. Every task trains on all training texts of its
partition from the same start, and the tasks' parameters are averaged, each unit's by the times a task met it. What a
task sees is part of the result: another partitioning of the same rows gives slightly other scores (base_score and the
counts do not depend on it).

Counts cover the whole training corpus. What is sent to tasks are the units and the parameters; the counts of all
other words come by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm.common import discard, groups_of_rows, only, stored

TOP, SIZE, CONTEXT, LONGEST = 63, 16, 4, 64
NOISE, CLASS_NOISE, FIRST, BATCH, BLOCK, ROUNDS = 48, 8, 256, 8192, 512, 2
END = ""


@dataclass(frozen=True)
class Sizes:
    """How many words are units of their own and how many classes there are, by the training tokens.

    Words: 64 times the cube root of the tokens (16,000 for 16 million, 110,000 for 5 billion, 1.6 million for 16
    trillion), so that what is broadcast grows far slower than the corpus. Classes: the power of two next to the root.
    """

    words: int
    classes: int

    @classmethod
    def of(cls, tokens: int) -> Sizes:
        words = max(TOP + 1, int(64 * round(max(tokens, 1) ** (1 / 3), 6)))
        return cls(words, max(16, 1 << round(np.log2(words**0.5))))


def split_words(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case."""
    return (text or "").encode().lower().split()


def endings(words: pa.Array) -> np.ndarray:
    """The last eight bytes of each word as a number, the last byte first; words with like endings are close."""
    column = words.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(len(column), np.uint64)
    data, out = np.frombuffer(column.buffers()[2], np.uint8), np.zeros(len(column), np.uint64)
    for k in range(1, 9):
        at = ends[1:] - k
        out = (out << np.uint64(8)) | np.where(at >= ends[:-1], data[np.maximum(at, 0)], 0).astype(np.uint64)
    return out


def with_held_out(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with held_out: crc32 of the doc_id as text is divisible by ten (null: as the empty text)."""
    plain = only(docs, doc_id="long", text="string")
    return plain.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)


def split_column(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many words each text has, and all words one after the other, as places in a dictionary."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    words, empty = split.flatten(), np.zeros(0, np.int64)
    filled = pc.not_equal(pc.binary_length(words), 0)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64) if len(split) else empty
    if not pc.all(filled, min_count=0).as_py():
        of = np.repeat(np.arange(len(lengths)), lengths)[filled.to_numpy(zero_copy_only=False)]
        words, lengths = words.filter(filled), np.bincount(of, minlength=len(lengths))
    return lengths, words.dictionary_encode()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text is the empty word. Each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "text", 8 << 20):
            _, found = split_column(batch.column("text"))
            n = np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary))
            words = pa.concat_arrays([found.dictionary.cast(pa.string()), pa.array([END], pa.string())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, batch.num_rows).astype(np.int64))], ["word", "n"])

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_borders(words: list[bytes], classes: int) -> np.ndarray:
    """The endings at which classes begin (but for the first), so that each has as many of the words beyond TOP."""
    found = np.sort(endings(pa.array(words[TOP:], pa.binary())))
    return found[(np.arange(1, classes) * len(found)) // classes] if len(found) else np.arange(1, classes, dtype=np.uint64)


def classes_of(words: pa.Array, borders: np.ndarray) -> np.ndarray:
    return np.searchsorted(borders, endings(words), side="right")


@dataclass
class Vocabulary:
    """The units: own words by falling count, the end, the rest of each class; tokens of each, and of classes the rest's different words."""

    words: list[bytes]
    borders: np.ndarray
    unit_tokens: np.ndarray
    rest_words: np.ndarray
    tokens: int
    distinct: int

    def __post_init__(self) -> None:
        self.end = n = len(self.words)
        self.classes = len(self.borders) + 1
        top = min(TOP, n)
        of = classes_of(pa.array(self.words[top:], pa.binary()), self.borders)
        member = np.concatenate([np.arange(top, n), n + 1 + np.arange(self.classes)])
        member_class = np.concatenate([of, np.arange(self.classes)])
        order = np.argsort(member_class, kind="stable")
        #: the unit of each slot of the second step, its class, and where each class's slots start
        self.slot_unit, self.slot_class = member[order], member_class[order].astype(np.int32)
        self.class_start = np.searchsorted(self.slot_class, np.arange(self.classes + 1))
        self.tops = top + 1 + self.classes
        self.top_of, self.slot_of = np.full(len(self.unit_tokens), top, np.int32), np.full(len(self.unit_tokens), -1, np.int32)
        self.top_of[:top] = np.arange(top)
        self.top_of[self.slot_unit] = top + 1 + self.slot_class
        self.slot_of[self.slot_unit] = np.arange(len(order))

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.1 * (self.distinct + 1)))

    def top_share(self) -> np.ndarray:
        n = np.bincount(self.top_of, self.unit_tokens, self.tops) + 0.1
        return n / n.sum()

    def slot_share(self) -> np.ndarray:
        """Of each slot, within its class."""
        n = self.unit_tokens[self.slot_unit] + 0.1
        return n / np.bincount(self.slot_class, n, self.classes)[self.slot_class]

    def rest_log(self) -> np.ndarray:
        return np.log10(self.unit_tokens[self.end + 1 :] + 0.1 * (self.rest_words + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From all word counts; the words that become units (see Sizes) and a row for each class come to the driver."""
    totals = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    sizes = Sizes.of(totals[0] or 0)
    head = counts.where((F.col("word") != END) & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("n"), "word").limit(sizes.words).select(F.col("word").cast("binary").alias("word"), "n").collect()
    words = [bytes(r.word) for r in head]  # as bytes: text that is no UTF-8 must not change on its way to the driver
    borders = class_borders(words, sizes.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, different = np.zeros(sizes.classes), np.zeros(sizes.classes)
        for batch in batches:
            of = classes_of(batch.column("word"), borders)
            n += np.bincount(of, batch.column("n").to_numpy(zero_copy_only=False), sizes.classes)
            different += np.bincount(of, minlength=sizes.classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sizes.classes)), pa.array(n.astype(np.int64)), pa.array(different.astype(np.int64))], ["class", "n", "v"])

    tokens, different = np.zeros(sizes.classes, np.int64), np.zeros(sizes.classes, np.int64)
    for r in counts.where(F.col("word") != END).mapInArrow(run, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tokens[r["class"]], different[r["class"]] = r.n, r.v
    own = np.asarray([r.n for r in head], np.int64)
    of = classes_of(pa.array(words, pa.binary()), borders)
    np.subtract.at(tokens, of, own)  # words that are units of their own are not in the rest of a class
    np.subtract.at(different, of, 1)
    return Vocabulary(words, borders, np.concatenate([own, [totals[2] or 0], tokens]), different, totals[0] or 0, totals[1])


@dataclass
class Parameters:
    source: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    weight: np.ndarray

    @classmethod
    def start(cls, v: Vocabulary, seed: int = 3) -> Parameters:
        random = np.random.default_rng(seed)
        draw = lambda n: random.normal(0, 0.1, (n, SIZE)).astype(np.float32)
        log = lambda share: np.log(share).astype(np.float32)
        slots = len(v.slot_unit)
        return cls(draw(len(v.unit_tokens)), draw(v.tops), log(v.top_share()), draw(slots), log(v.slot_share()), np.ones((CONTEXT, SIZE), np.float32) / CONTEXT)

    def parts(self) -> list[np.ndarray]:
        return [self.source, self.target, self.bias, self.inner, self.inner_bias, self.weight]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.parts()])

    def like(self, values: np.ndarray) -> Parameters:
        ends = np.cumsum([x.size for x in self.parts()])[:-1]
        return Parameters(*(part.astype(np.float32).reshape(x.shape) for part, x in zip(np.split(values, ends), self.parts(), strict=True)))


def padded(units: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The units with CONTEXT ends before each text, so that the units before a place are its context; where the units stand."""
    place = np.arange(len(units)) + CONTEXT * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    out = np.full(len(units) + CONTEXT * len(lengths), end, np.int32)
    out[place] = units
    return out, place


def _hidden(p: Parameters, source: np.ndarray) -> np.ndarray:
    """The prediction for each place beyond the first CONTEXT, from the representations of all places."""
    n = len(source) - CONTEXT
    out = source[CONTEXT - 1 : CONTEXT - 1 + n] * p.weight[0]
    for k in range(1, CONTEXT):
        out += source[CONTEXT - 1 - k : CONTEXT - 1 - k + n] * p.weight[k]
    return out


def _sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of values added up by their place: the places there are, rising, and a row for each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[begin], np.add.reduceat(values[order], begin, axis=0)


class Trainer:
    """Noise-contrastive steps with Adagrad."""

    def __init__(self, start: Parameters, v: Vocabulary, seed: int, rate: float = 0.08):
        self.p, self.v = Parameters(*(x.copy() for x in start.parts())), v
        self._square = [np.full_like(x, 0.1) for x in self.p.parts()]
        top, slot = v.top_share(), v.slot_share()
        self._random, self._top, self._top_log = np.random.default_rng(seed), np.cumsum(top), np.log(NOISE * top).astype(np.float32)
        self._slot_log = np.log(CLASS_NOISE * slot).astype(np.float32)
        # shares of slots run through 0..1 in each class, one class after the other
        self._slot = np.cumsum(slot)
        self._slot_from = np.concatenate([[0.0], self._slot])[v.class_start[:-1]]
        self._rate, self.tokens = np.float32(rate), 0
        self._false = np.empty((BATCH, NOISE), np.float32)
        self.met = np.zeros(len(v.unit_tokens), np.int64)

    def _move(self, k: int, rows: np.ndarray | slice, gradient: np.ndarray, n: int) -> None:
        gradient = gradient * np.float32(1 / np.sqrt(n))
        square = self._square[k][rows] + gradient * gradient
        self._square[k][rows] = square
        self.p.parts()[k][rows] += self._rate * gradient / np.sqrt(square)

    def step(self, line: np.ndarray, place: np.ndarray) -> None:
        """One step over the units at these places (from CONTEXT on) of a line."""
        p, v, n, goal = self.p, self.v, len(place), line[place]
        source = p.source[line]
        hidden, top = _hidden(p, source)[place - CONTEXT], v.top_of[goal]
        noise = np.minimum(np.searchsorted(self._top, self._random.random(NOISE)), v.tops - 1)
        up = 1 / (1 + np.exp(np.einsum("nd,nd->n", hidden, p.target[top]) + p.bias[top] - self._top_log[top]))
        false = np.matmul(hidden, p.target[noise].T, out=self._false[:n])
        np.subtract(self._top_log[noise] - p.bias[noise], false, out=false)
        np.exp(false, out=false)
        false += 1
        np.reciprocal(false, out=false)
        back = up[:, None] * p.target[top] - false @ p.target[noise]
        rows, gradient = _sums(np.concatenate([top, noise]), np.concatenate([np.column_stack([up[:, None] * hidden, up]), -np.column_stack([false.T @ hidden, false.sum(0)])]))
        self._inner_step(hidden, v.slot_of[goal], back)
        whole, weight, of_source = np.zeros((len(line) - CONTEXT, SIZE), np.float32), np.empty_like(p.weight), np.zeros_like(source)
        whole[place - CONTEXT] = back
        for k in range(CONTEXT):
            before = slice(CONTEXT - 1 - k, CONTEXT - 1 - k + len(whole))
            weight[k] = np.einsum("nd,nd->d", source[before], whole)
            of_source[before] += p.weight[k] * whole
        self._move(0, *_sums(line, of_source), n)
        self._move(1, rows, gradient[:, :SIZE], n)
        self._move(2, rows, gradient[:, SIZE], n)
        self._move(5, slice(None), weight, n)
        self.tokens += n
        self.met += np.bincount(goal, minlength=len(self.met))

    def _inner_step(self, hidden: np.ndarray, slot: np.ndarray, back: np.ndarray) -> None:
        """The second step; what goes back to the prediction is added to back."""
        p, v, n = self.p, self.v, len(hidden)
        inside = np.flatnonzero(slot >= 0)
        if not len(inside):
            return
        inside = inside[np.argsort(v.slot_class[slot[inside]], kind="stable")]
        h, slot = hidden[inside], slot[inside]
        of = v.slot_class[slot]
        drawn = self._slot_from[:, None] + self._random.random((v.classes, CLASS_NOISE)) * (1 - 1e-9)
        noise = np.clip(np.searchsorted(self._slot, drawn), v.class_start[:-1, None], v.class_start[1:, None] - 1)
        up = 1 / (1 + np.exp(np.einsum("nd,nd->n", h, p.inner[slot]) + p.inner_bias[slot] - self._slot_log[slot]))
        wrong, lift = p.inner[noise], self._slot_log[noise] - p.inner_bias[noise]
        false, mine, rows = np.empty((len(of), CLASS_NOISE), np.float32), np.empty_like(h), np.zeros(wrong.shape, np.float32)
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        groups = list(zip(begin.tolist(), [*begin[1:].tolist(), len(of)], of[begin].tolist(), strict=True))
        for a, b, c in groups:  # tokens of one class after the other
            np.matmul(h[a:b], wrong[c].T, out=false[a:b])
        false = 1 / (1 + np.exp(lift[of] - false))
        for a, b, c in groups:
            np.matmul(false[a:b], wrong[c], out=mine[a:b])
            np.matmul(false[a:b].T, h[a:b], out=rows[c])
        sums = np.zeros(noise.shape, np.float32)
        sums[of[begin]] = np.add.reduceat(false, begin, axis=0)
        back[inside] += up[:, None] * p.inner[slot] - mine
        values = np.concatenate([np.column_stack([up[:, None] * h, up]), -np.column_stack([rows.reshape(-1, SIZE), sums.reshape(-1)])])
        at, gradient = _sums(np.concatenate([slot, noise.reshape(-1)]), values)
        self._move(3, at, gradient[:, :SIZE], n)
        self._move(4, at, gradient[:, SIZE], n)


def _weights(met: np.ndarray, v: Vocabulary, tokens: int) -> np.ndarray:
    """How much a task's parameters count: those of a unit by the times the task met it."""
    of = met + 1e-3
    rows = lambda x: np.repeat(x, SIZE)
    top = np.bincount(v.top_of, of, v.tops)
    slot = of[v.slot_unit]
    return np.concatenate([rows(of), rows(top), top, rows(slot), slot, np.full(CONTEXT * SIZE, float(tokens))])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("sums"):
            own = np.frombuffer(value.as_buffer(), np.float32)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _units_of(batch: pa.RecordBatch, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The units of the texts of a batch, the ends included, and how many each text has."""
    column = batch.column("units").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    words = np.frombuffer(column.buffers()[2], np.int32)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.int32)
    n = np.diff(ends)
    return np.insert(words, np.cumsum(n), v.end), n + 1


def trained(training: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    """Parameters after so many passes over all training texts (units: see read_units), averaged over tasks after each pass."""
    spark, parameters = training.sparkSession, Parameters.start(v)
    words = spark.sparkContext.broadcast(v)
    # a task gives a row as large as the parameters, so there are no more tasks than keep the cluster busy
    tasks = training.select("units").coalesce(8 * spark.sparkContext.defaultParallelism)
    for pass_number in range(rounds):
        shared = spark.sparkContext.broadcast(parameters)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, seed: int = pass_number) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            trainer = Trainer(shared.value, words.value, seed * 100_003 + TaskContext.get().partitionId())
            for batch in groups_of_rows(batches, "units", 8 << 20):
                line, place = padded(*_units_of(batch, words.value), words.value.end)
                at = 0
                while at < len(place):  # steps grow with what was seen, so that few texts teach something, too
                    own = place[at : at + min(BATCH, max(FIRST, trainer.tokens // 8))]
                    first = own[0] - CONTEXT
                    trainer.step(line[first : own[-1] + 1], own - first)
                    at += len(own)
            if trainer.tokens:
                weight = _weights(trainer.met, words.value, trainer.tokens)
                values = np.concatenate([trainer.p.flat() * weight, weight]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["sums"])

        # one row for each task is added up in eight, then in one, so the driver gets one row as large as the parameters
        rows = tasks.mapInArrow(run, "sums binary").repartition(8).mapInArrow(_added, "sums binary").repartition(1).mapInArrow(_added, "sums binary").collect()
        if rows:
            sums, weight = np.split(np.frombuffer(rows[0].sums, np.float32), 2)
            parameters = parameters.like(sums / weight)
        shared.unpersist()
    return parameters


def log_probabilities(p: Parameters, v: Vocabulary, line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 of the units at these places of a line given those before, normalised in both steps, in blocks of matrix products."""
    out = np.zeros(len(place))
    room = np.empty(BLOCK * max(v.tops, int(np.diff(v.class_start).max(initial=1))), np.float32)
    target, inner = (np.ascontiguousarray(np.column_stack([x, bias]).T) for x, bias in ((p.target, p.bias), (p.inner, p.inner_bias)))
    many = 4 * BATCH
    for at in range(0, len(place), many):
        own, found = place[at : at + many], out[at : at + many]
        first = own[0] - CONTEXT
        hidden, goal = _hidden(p, p.source[line[first : own[-1] + 1]])[own - own[0]], line[own]
        hidden = np.column_stack([hidden, np.ones(len(own), np.float32)])
        found += _normalised(hidden, target, v.top_of[goal], room)
        slot = v.slot_of[goal]
        inside = np.flatnonzero(slot >= 0)
        inside = inside[np.argsort(v.slot_class[slot[inside]], kind="stable")]
        of = v.slot_class[slot[inside]]
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]).tolist()
        for a, b in zip(begin, [*begin[1:], len(of)] if begin else [], strict=True):
            mine, (low, high) = inside[a:b], v.class_start[of[a] : of[a] + 2]
            found[mine] += _normalised(hidden[mine], inner[:, low:high], slot[mine] - low, room)
    return out / np.log(10)


def _normalised(hidden: np.ndarray, target: np.ndarray, goal: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Natural logarithms of the goals' shares, in blocks of rows that stay in the cache."""
    out, ones = np.empty(len(hidden)), np.ones(target.shape[1], np.float32)
    for a in range(0, len(hidden), BLOCK):
        part = hidden[a : a + BLOCK]
        scores = np.matmul(part, target, out=room[: len(part) * target.shape[1]].reshape(len(part), -1))
        own = scores[np.arange(len(part)), goal[a : a + BLOCK]]
        most = scores.max(1)
        if not -60 < most.min() <= most.max() < 60:  # else no exponential leaves the range of 32 bits
            scores -= most[:, None]
            own = own - most
        np.exp(scores, out=scores)
        out[a : a + BLOCK] = own - np.log(scores @ ones)
    return out


def read_units(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, the units of the words (32-bit), and the words without a unit with how often they occur."""
    shared = texts.sparkSession.sparkContext.broadcast(v)
    kinds = "row long, doc_id long, held_out boolean, units binary, rare array<struct<word: string, n: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = shared.value, TaskContext.get().partitionId() << 33
        known = pa.array(v.words, pa.large_binary())
        for batch in groups_of_rows(batches, "text", 8 << 20):
            lengths, found = split_column(batch.column("text"))
            place = pc.index_in(found.dictionary.cast(pa.large_binary()), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            if len(missing := np.flatnonzero(place < 0)):
                place[missing] = v.end + 1 + classes_of(found.dictionary.take(pa.array(missing)), v.borders)
            index = found.indices.to_numpy(zero_copy_only=False)
            units = place[index]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(4 * offsets), pa.py_buffer(np.ascontiguousarray(units))])
            rare = np.flatnonzero(units > v.end)
            pairs, times = np.unique((np.repeat(np.arange(len(lengths)), lengths)[rare] << 32) | index[rare], return_counts=True)
            items = pa.StructArray.from_arrays([found.dictionary.take(pa.array(pairs & 0xFFFFFFFF)).cast(pa.string()), pa.array(times.astype(np.int64))], ["word", "n"])
            starts = np.searchsorted(pairs >> 32, np.arange(len(lengths) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), batch.column("held_out"), packed.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(starts), items)],
                ["row", "doc_id", "held_out", "units", "rare"],
            )
            row += batch.num_rows

    return texts.mapInArrow(run, kinds)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    A null or empty text is the end alone, a very long text is read whole. Repeated rows are scored each; rows without
    a doc_id count as those whose doc_id is the empty text and are held out; an empty table gives no rows, and without training texts every score is that of the smoothed empty
    model. Other columns are not read.
    """
    texts = with_held_out(docs)
    counts = stored(word_counts(texts.where(~F.col("held_out"))), "counts")
    words = vocabulary(counts)
    read = stored(read_units(texts, words), "units")
    parameters = trained(read.where(~F.col("held_out")), words)
    shared = docs.sparkSession.sparkContext.broadcast((words, parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        log_count, rest_log, end_seen = np.log10(v.unit_tokens + 0.1), v.rest_log(), v.unit_tokens[v.end] > 0
        for batch in groups_of_rows(batches, "units", 4 << 20):
            units, lengths = _units_of(batch, v)
            model = log_probabilities(p, v, *padded(units, lengths, v.end))
            rare = units > v.end
            model[rare] -= rest_log[units[rare] - v.end - 1]
            of = np.repeat(np.arange(len(lengths)), lengths)
            add = lambda x, of=of, n=len(lengths): np.bincount(of, x, n)
            known = add(~rare).astype(np.int64) - (not end_seen)
            columns = [batch.column(c) for c in ("row", "doc_id", "held_out")] + [pa.array(x) for x in (lengths, known, add(np.where(rare, 0.0, log_count[units])), add(model))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"])

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double"
    parts = read.select("row", "doc_id", "held_out", "units").mapInArrow(run, kinds)
    rare = read.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    seen = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_log"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known")
    )
    rest = F.coalesce("rare_log", F.lit(0.0))
    out = parts.join(seen, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * words.base_log).alias("base_score"), (F.col("model") + rest).alias("score"),
    )
    out = stored(out, "scores")
    discard(read, counts)
    return out
