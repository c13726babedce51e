"""Log templates by Drain, per service, over distinct masked token sequences.

A sequence that repeats matches its own template exactly, so it neither makes nor changes one: clustering the distinct
sequences in the order they were first seen gives the same templates as going through every line. Counting lines into
distinct sequences is a plain aggregation, so a service that owns most lines costs no more than its distinct ones.

Sequences of different length never meet in the tree, so a group is a service and a length. Only the limit on clusters
spans lengths: services that exceed it are mined again as one group each, and there the lines of sequences that found no
room are tried again, one by one, after their leaf has changed. What mining leaves behind is rows: clusters by leaf, and
which cluster each sequence belongs to from which line on. A later run starts from those rows and adds the changed ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsflow.functions.text import WILDCARD, log_tokens, short_hash, truncate_utf8
from obsflow.operators.tables import latest
from obsflow.sources.checkpoint import cut

OVERFLOW = "<overflow>"


@dataclass(frozen=True)
class Config:
    """Fixed defaults of the miner."""

    depth: int = 4
    similarity: float = 0.5
    max_children: int = 100
    max_clusters: int = 5000
    sample_bytes: int = 512
    keep_http_status: bool = True


def _is_status(token: str) -> bool:
    return len(token) == 3 and token.isascii() and token.isdigit() and "1" <= token[0] <= "5"


@dataclass
class Tree:
    """The clusters of one service and the prefix tree that leads to them."""

    config: Config
    templates: list[list[str]] = field(default_factory=list)
    initial: list[str] = field(default_factory=list)
    leaves: dict[tuple, list[int]] = field(default_factory=dict)
    children: dict[tuple, set[str]] = field(default_factory=dict)

    def path(self, tokens: list[str]) -> tuple:
        """The leaf that a sequence of tokens leads to; its nodes are made on the way."""
        path: tuple = (len(tokens),)
        for token in tokens[: self.config.depth - 2]:
            seen = self.children.setdefault(path, set())
            if token not in seen:
                if len(seen) >= self.config.max_children and not (self.config.keep_http_status and _is_status(token)):
                    token = WILDCARD
                seen.add(token)
            path = (*path, token)
        self.leaves.setdefault(path, [])
        return path

    def restore(self, path: tuple, initial: str | None = None, template: list[str] | None = None) -> int:
        """Puts back a leaf, and a cluster of it if there is one."""
        for depth in range(1, len(path)):
            self.children.setdefault(path[:depth], set()).add(path[depth])
        leaf = self.leaves.setdefault(path, [])
        if template is None:
            return -1
        self.templates.append(template)
        self.initial.append(initial)
        leaf.append(len(self.templates) - 1)
        return leaf[-1]

    def score(self, template: list[str], tokens: list[str]) -> float:
        """Share of equal or wildcard places; -1 if a status code meets anything but itself."""
        same = 0
        for t, m in zip(template, tokens, strict=True):
            if t == m:
                same += 1
            elif self.config.keep_http_status and (_is_status(t) or _is_status(m)):
                return -1.0
            elif t == WILDCARD:
                same += 1
        return same / len(tokens)

    def add(self, tokens: list[str]) -> tuple[int, bool]:
        """The cluster a sequence belongs to now, and whether its template became more general. -1: overflow."""
        leaf = self.leaves[self.path(tokens)]
        scored = [(self.score(self.templates[k], tokens), -k) for k in leaf]
        best, k = max(scored, default=(-1.0, 0))
        if best >= self.config.similarity:
            template = self.templates[-k]
            merged = [t if t == m else WILDCARD for t, m in zip(template, tokens, strict=True)]
            self.templates[-k] = merged
            return -k, merged != template
        if len(self.templates) >= self.config.max_clusters:
            return -1, False
        self.templates.append(list(tokens))
        self.initial.append(" ".join(tokens))
        leaf.append(len(self.templates) - 1)
        return leaf[-1], False


def distinct_sequences(logs: DataFrame, config: Config = Config()) -> DataFrame:
    """Per service and masked token sequence: first and last time, lines, worst severity and the first body."""
    return _distinct(logs, config).drop("first_id")


#: The column in which tokenised() leaves a line's masked tokens.
TOKENS = "_masked_tokens"


def tokenised(logs: DataFrame, config: Config = Config()) -> DataFrame:
    """logs with their masked tokens, for those that hand the same lines to mine() and template_hits()."""
    return logs.withColumn(TOKENS, log_tokens(F.col("body"), config.keep_http_status))


def _tokens(logs: DataFrame, config: Config) -> Column:
    return F.col(TOKENS) if TOKENS in logs.columns else log_tokens(F.col("body"), config.keep_http_status)


def _distinct(logs: DataFrame, config: Config) -> DataFrame:
    return logs.withColumn("tokens", _tokens(logs, config)).groupBy("service", "tokens").agg(
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count("*").alias("lines"), F.max("severity_number").alias("max_severity"), F.min_by("body", F.struct("ts_ns", "log_id")).alias("sample"),
        F.min(F.struct("ts_ns", "log_id"))["log_id"].alias("first_id"),
    )


#: Rows that mining leaves: clusters (kind c: path, position in the leaf, initial, template), leaves (kind l: path) and
#: assignments (kind s: the sequence key belongs to the cluster at position of path from the line (valid_from, valid_id) on).
STATE = "kind string, service string, path string, position int, key string, tokens array<string>, initial string, template string, valid_from long, valid_id string"
Line = tuple[int, str]


@dataclass
class _Mining:
    """One group: its tree, its sequences by leaf, and the lines at which something changed."""

    tree: Tree
    of: dict[str, tuple[list[str], tuple, int]] = field(default_factory=dict)  # tokens, path, cluster
    by_leaf: dict[tuple, list[str]] = field(default_factory=dict)
    waits: dict[str, tuple[Line, Line]] = field(default_factory=dict)  # to be tried again with the line after these: the first and the last change
    at_position: dict[tuple[str, int], int] = field(default_factory=dict)
    known_leaves: set[tuple] = field(default_factory=set)
    assigned: list[tuple[str, Line, int]] = field(default_factory=list)
    touched: set[int] = field(default_factory=set)
    begun: set[str] = field(default_factory=set)

    def put(self, key: str, tokens: list[str], path: tuple, cluster: int) -> None:
        if key not in self.of:
            self.by_leaf.setdefault(path, []).append(key)
        self.of[key] = tokens, path, cluster

    def line(self, key: str, tokens: list[str], at: Line) -> None:
        """A line whose sequence is new, had no room so far, or comes for the first time in this run."""
        if key in self.of and self.of[key][2] >= 0:
            self.assigned.append((key, at, self.of[key][2]))
            return
        before = len(self.tree.templates)
        cluster, changed = self.tree.add(tokens)
        path = self.tree.path(tokens)
        self.put(key, tokens, path, cluster)
        if cluster >= 0 or key not in self.begun:
            self.assigned.append((key, at, cluster))
        self.begun.add(key)
        if changed or len(self.tree.templates) > before:
            self.touched.add(cluster)
        if changed:
            self.judge_again(path, cluster, at)

    def judge_again(self, path: tuple, cluster: int, at: Line) -> None:
        """After a template became more general: sequences of the leaf that it matches in full go from later clusters to it; those without a cluster are tried with their next line."""
        for other in self.by_leaf[path]:
            tokens, _, its = self.of[other]
            if its > cluster and self.tree.score(self.tree.templates[cluster], tokens) == 1.0:
                self.of[other] = tokens, path, cluster
                self.assigned.append((other, at, cluster))
            elif its < 0:
                self.waits[other] = self.waits[other][0] if other in self.waits else at, at

    def later_line(self, key: str, at: Line) -> None:
        """A line of a sequence that came before: nothing, unless the sequence waits for it."""
        first, last = self.waits[key]
        if first < at:
            del self.waits[key]
            if last >= at:
                self.waits[key] = last, last
            self.line(key, self.of[key][0], at)


def _mine(service: str, old: pd.DataFrame, new: pd.DataFrame, config: Config) -> pd.DataFrame:
    """Rows that mining the sequences new adds to the rows old of the same group."""
    work = _begun(old, config)
    for r in new.sort_values(["first_ns", "first_id", "key"]).itertuples():
        work.line(r.key, list(r.tokens), (r.first_ns, r.first_id))
    return _left(service, work)


def _begun(old: pd.DataFrame, config: Config) -> _Mining:
    """A group with the rows that earlier runs have left."""
    work = _Mining(Tree(config))
    paths = {p: tuple(int(x) if k == 0 else x for k, x in enumerate(p.split(" "))) for p in old["path"].unique()}
    for path in paths.values():
        work.tree.restore(path)
    for r in old[old["kind"] == "c"].sort_values(["first_ns", "first_id", "path", "position"]).itertuples():
        work.at_position[r.path, r.position] = work.tree.restore(paths[r.path], r.initial, r.template.split(" "))
    for r in old[old["kind"] == "s"].sort_values(["valid_from", "valid_id", "key"]).itertuples():
        work.put(r.key, list(r.tokens), paths[r.path], work.at_position.get((r.path, r.position), -1))
    work.known_leaves = set(work.tree.leaves)
    return work


def _left(service: str, work: _Mining) -> pd.DataFrame:
    """The rows that a group adds."""
    tree, name = work.tree, lambda path: " ".join(map(str, path))
    place = {k: (name(path), n) for path, leaf in tree.leaves.items() for n, k in enumerate(leaf)}
    first = {k: at for key, at, k in reversed(work.assigned)}
    rows: list[tuple] = [("l", service, name(p), None, None, None, None, None, None, None) for p in tree.leaves if p not in work.known_leaves]
    rows += [("c", service, *place[k], None, None, tree.initial[k], " ".join(tree.templates[k]), *first[k]) for k in sorted(work.touched)]
    for key, (ts, log_id), k in work.assigned:
        tokens, path, _ = work.of[key]
        text = (tree.initial[k], " ".join(tree.templates[k])) if k >= 0 else (OVERFLOW, OVERFLOW)
        rows.append(("s", service, name(path), place[k][1] if k >= 0 else -1, key, tokens, *text, ts, log_id))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")])


def mine(logs: DataFrame, config: Config = Config(), state: DataFrame | None = None) -> DataFrame:
    """The rows (see STATE) that mining logs adds to a state; a sequence's rows s say from which line on it belongs where."""
    sequences = _distinct(logs, config).select("service", "tokens", F.size("tokens").alias("n_tokens"), _key().alias("key"), "first_ns", "first_id")
    sequences, state = cut(sequences), logs.sparkSession.createDataFrame([], STATE) if state is None else cut(current(state))
    found = cut(_grouped(sequences, state, config, ["service", "n_tokens"]))
    made = state.where("kind = 'c'").select("service", "path", "position", "valid_from", "valid_id").unionByName(found.where("kind = 'c'").select("service", "path", "position", "valid_from", "valid_id"))
    made = made.groupBy("service", "path", "position").agg(F.min(F.struct("valid_from", "valid_id")).alias("at"))
    nth = Window.partitionBy("service").orderBy("at", "path", "position")
    full = made.withColumn("k", F.row_number().over(nth)).groupBy("service").agg(F.max("k").alias("n"), F.min(F.when(F.col("k") == config.max_clusters, F.col("at.valid_from"))).alias("full_ns"))
    full = full.where(F.col("n") > config.max_clusters).select("service", "full_ns")
    if full.isEmpty():
        return found
    full = cut(full)
    late = logs.join(full, "service").where(F.col("ts_ns") >= F.col("full_ns")).select("service", F.md5(F.concat_ws(" ", _tokens(logs, config))).alias("key"), "ts_ns", "log_id")
    again = sequences.join(full.select("service"), "service", "left_semi")
    return found.join(full, "service", "left_anti").unionByName(_in_order(again, state.join(full, "service", "left_semi"), late, config))


def _key():  # noqa: ANN202
    return F.md5(F.concat_ws(" ", "tokens"))


def _grouped(sequences: DataFrame, state: DataFrame, config: Config, by: list[str]) -> DataFrame:
    def run(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        return _mine(key[0], old, new, config)

    old = _with_first(state).withColumn("n_tokens", F.substring_index("path", " ", 1).cast("int"))
    return old.groupBy(*by).cogroup(sequences.groupBy(*by)).applyInPandas(run, STATE)


def _with_first(state: DataFrame) -> DataFrame:
    first = Window.partitionBy("service", "path", "position")
    return state.withColumns({"first_ns": F.min("valid_from").over(first), "first_id": F.min("valid_id").over(first)})


def _in_order(sequences: DataFrame, state: DataFrame, lines: DataFrame, config: Config) -> DataFrame:
    """_grouped by service, where lines (service, key, ts_ns, log_id) of sequences without a cluster are tried again.

    Spark sorts a service's state, then its lines by time; they pass through the task in batches and no line is kept.
    """
    old = _with_first(state).withColumns({"phase": F.lit(0), "ts_ns": F.lit(0).cast("long"), "log_id": F.lit("")})
    new = sequences.select("service", "key", "tokens", F.col("first_ns").alias("ts_ns"), F.col("first_id").alias("log_id"), F.lit(1).alias("phase"))
    rows = old.unionByName(new, True).unionByName(lines.select("service", "key", "ts_ns", "log_id", F.lit(2).alias("phase")), True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, before, work = None, [], None
        for batch in batches:
            for name, part in batch.groupby("service", sort=False):
                if name != service:
                    if work is not None:
                        yield _left(service, work)
                    service, before, work = name, [], None
                before.append(part[part["phase"] == 0])
                part = part[part["phase"] > 0]
                if work is None and len(part):
                    work, before = _begun(pd.concat(before), config), []
                for key, tokens, *at in zip(part["key"], part["tokens"], part["ts_ns"].tolist(), part["log_id"], strict=True):
                    if tokens is not None:
                        work.line(key, list(tokens), tuple(at))
                    elif key in work.waits:
                        work.later_line(key, tuple(at))
        if work is not None:
            yield _left(service, work)

    late = F.when(F.col("phase") == 0, 0).otherwise(1)
    return rows.repartition("service").sortWithinPartitions("service", late, "ts_ns", "log_id", "key", "phase").mapInPandas(run, STATE)


def current(state: DataFrame) -> DataFrame:
    """Of rows that runs have left one after the other: the newest of each cluster and sequence, and every leaf once."""
    clusters = latest(state.where("kind = 'c'"), ["kind", "service", "path", "position"], "valid_from", "valid_id")
    sequences = latest(state.where("kind = 's'"), ["kind", "service", "key"], "valid_from", "valid_id")
    leaves = state.where("kind = 'l'").dropDuplicates(["service", "path"])
    return clusters.select(*state.columns).unionByName(sequences.select(*state.columns)).unionByName(leaves)


def assignments(state: DataFrame) -> DataFrame:
    """(service, key, valid_from, valid_id, initial, template, template_id): the cluster of each sequence from a line on."""
    own = state.where("kind = 's'").select("service", "key", "valid_from", "valid_id", "initial", "template")
    return own.withColumn("template_id", short_hash(F.col("service"), F.col("initial")))


def drain_templates(logs: DataFrame, config: Config = Config()) -> DataFrame:
    """assignments() of mining logs from nothing."""
    return assignments(mine(logs, config))


def template_hits(logs: DataFrame, assigned: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per log with its template: the assignment in force at its line.

    A sequence that owns most lines would be one key of the join, so lines are joined through their distinct sequences
    only where Spark cannot send the history to every task; its own skew handling splits such a key.
    """
    keyed = logs.withColumn("key", F.md5(F.concat_ws(" ", _tokens(logs, config))))
    spans = assigned.groupBy("service", "key").agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_id", "template_id"))).alias("history"))
    before = lambda h: (h["valid_from"] < F.col("ts_ns")) | ((h["valid_from"] == F.col("ts_ns")) & (h["valid_id"] <= F.col("log_id")))
    in_force = F.element_at(F.filter("history", before), -1)["template_id"]
    return keyed.join(spans, ["service", "key"]).select("log_id", in_force.alias("template_id"), "service", "ts_ns", "severity_number", "trace_id", "span_id")


def template_stats(hits: DataFrame, logs: DataFrame, most_bytes: int = 512) -> DataFrame:
    with_body = hits.join(logs.select("log_id", "body"), "log_id")
    return with_body.groupBy("template_id", "service").agg(
        F.count("*").alias("lines"), F.min("ts_ns").alias("first_seen"), F.max("ts_ns").alias("last_seen"), F.max("severity_number").alias("max_severity"),
        truncate_utf8(F.min_by("body", F.struct("ts_ns", "log_id")), most_bytes).alias("sample"),
    )


def restored_templates(state: DataFrame) -> DataFrame:
    """The templates (service, template_id, initial, template) of a state."""
    own = current(state).where("kind = 'c'").select("service", "initial", "template")
    return own.withColumn("template_id", short_hash(F.col("service"), F.col("initial"))).select("service", "template_id", "initial", "template")


def pre_epoch_pairs(candidates: DataFrame, old: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidates (template_id, service, tokens) that are an old template apart from a status code: these are not new."""
    same_start = F.lit(True)
    for k in range(1, config.depth - 1):
        a, b = F.get("tokens", F.lit(k - 1)), F.get("old_tokens", F.lit(k - 1))
        same_start = same_start & (a.eqNullSafe(b) | F.coalesce(b == WILDCARD, F.lit(False)))
    same = F.zip_with("tokens", "old_tokens", lambda m, t: ((t == m) | (t == WILDCARD)).cast("int"))
    share = F.aggregate(same, F.lit(0), lambda a, x: a + x) / F.greatest(F.size("tokens"), F.lit(1))
    has_status = F.exists("tokens", lambda t: t.rlike("^[1-5][0-9]{2}$"))
    pairs = candidates.join(old.select("service", F.col("tokens").alias("old_tokens")), "service").where(F.size("tokens") == F.size("old_tokens"))
    return pairs.where(has_status & same_start & (share >= config.similarity)).select("template_id").distinct()


def suppress_pre_epoch(candidates: DataFrame, old: DataFrame, config: Config = Config()) -> DataFrame:
    return candidates.join(pre_epoch_pairs(candidates, old, config), "template_id", "left_anti")


def remine(logs: DataFrame, stored: DataFrame, silenced: DataFrame, start_ns: int, end_ns: int, config: Config = Config()) -> tuple[DataFrame, DataFrame, int]:
    """(report per service, silence settings left without a template, the new watermark) of mining the stored logs of a window anew.

    Replays count once. Lines from the watermark, the window's end, on are for the live miner.
    """
    once = logs.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns)).dropDuplicates(["ts_ns", "log_id"])
    new = drain_templates(once, config).select("service", "template_id").distinct().withColumn("new", F.lit(1))
    old = stored.select("service", "template_id").distinct().withColumn("old", F.lit(1))
    both = old.join(new, ["service", "template_id"], "full_outer")
    report = both.groupBy("service").agg(
        F.count("old").alias("before"), F.count("new").alias("after"), F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"),
        F.count_if(F.col("new").isNotNull() & F.col("old").isNotNull()).alias("unchanged"),
    )
    return report, silenced.join(new, "template_id", "left_anti"), end_ns
