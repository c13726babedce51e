"""The main text of web pages: boosted trees over DOM nodes, decoded top down.

Every node gets features of its tag, attribute words, depth, subtree text and link density, children and siblings.
Boosted trees give the log-odds that it is part of the article or holds it. The choice over a page is the most likely
one in which a node that is dropped takes its whole subtree with it, found by one pass from the leaves to the root:
so no descendant of a dropped node is kept. The trees are fitted once on the driver, on a fixed number of labelled
pages from sample_pages; pages are then read where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.llm import boosting
from obsflow.llm.common import groups_of_rows
from obsflow.llm.dom import BLOCK, Page, parse
from obsflow.llm.sample_pages import UNWANTED, pages

#: Labelled pages that the trees are fitted on.
TRAINING_PAGES = 900


@dataclass
class Model:
    odds: dict[str, float]
    trees: boosting.Trees


def _words(page: Page) -> list[list[str]]:
    return [[f"<{t}>", *names] for t, names in zip(page.tag, page.tokens, strict=True)]


def features(batch: list[Page], odds: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages one after the other; each node's parent among them and its depth."""
    parent, depth, tag_odds, low, high, hidden = [], [], [], [], [], []
    own_chars, own_words, own_marks, own_link, tags = [], [], [], [], []
    offset = 0
    for page in batch:
        n = len(page.tag)
        chars, words, marks = [0] * n, [0] * n, [0] * n
        for node, text, _ in page.texts:
            chars[node] += len(text)
            words[node] += text.count(" ") + 1 if len(text) > 1 else 0
            marks[node] += text.count(".") + text.count(",")
        link = [False] * n
        for k in range(1, n):
            link[k] = link[page.parent[k]] or page.tag[k] == "a"
        parent += [p + offset for p in page.parent]
        depth += page.depth
        for t, names in zip(page.tag, page.tokens, strict=True):
            tag_odds.append(odds.get(f"<{t}>", 0.0))
            found = [odds.get(w, 0.0) for w in names] or [0.0]
            low.append(min(found))
            high.append(max(found))
            hidden.append("hidden" in names)
        own_chars += chars
        own_words += words
        own_marks += marks
        own_link += [c if is_link else 0 for c, is_link in zip(chars, link, strict=True)]
        tags += page.tag
        offset += n
    parent, depth = np.asarray(parent), np.asarray(depth)
    tag_odds, low, high = np.asarray(tag_odds), np.asarray(low), np.asarray(high)
    sums = np.stack([np.asarray(x, float) for x in (own_chars, own_words, own_marks, own_link, np.ones(offset))], axis=1)
    own = sums[:, 0].copy()
    root = depth == 0
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    for nodes in reversed(levels[1:]):
        np.add.at(sums, parent[nodes], sums[nodes])
    anc_low, anc_high = np.zeros(offset), np.zeros(offset)
    worst, best = np.minimum(tag_odds, low), np.maximum(tag_odds, high)
    for nodes in levels[1:]:
        up = parent[nodes]
        anc_low[nodes], anc_high[nodes] = np.minimum(anc_low[up], worst[up]), np.maximum(anc_high[up], best[up])
    children = np.bincount(parent[~root], minlength=offset)
    inner = np.flatnonzero(~root)
    order = inner[np.lexsort((inner, parent[inner]))]
    first = np.concatenate([[True], parent[order][1:] != parent[order][:-1]]) if len(order) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    index, before, after = np.zeros(offset), np.zeros(offset), np.zeros(offset)
    index[order] = np.arange(len(order)) - begin
    same = ~first[1:] if len(order) else np.zeros(0, bool)
    before[order[1:][same]], after[order[:-1][same]] = sums[order[:-1][same], 0], sums[order[1:][same], 0]
    page_of = np.cumsum(root) - 1
    whole = sums[root, 0][page_of]
    passed = np.cumsum(own) - own
    passed -= passed[root][page_of]
    chars = sums[:, 0] + 1
    siblings = children[parent]
    block = np.asarray([t in BLOCK for t in tags])
    out = np.stack([
        tag_odds, low, high, np.asarray(hidden, float), anc_low, anc_high, depth, np.log(chars), np.log(sums[:, 1] + 1), sums[:, 3] / chars, 100 * sums[:, 4] / chars,
        100 * sums[:, 2] / chars, np.log1p(children), index / np.maximum(siblings, 1), np.log1p(siblings), sums[:, 0] / (sums[parent, 0] + 1), sums[:, 0] / (whole + 1),
        np.log1p(before), np.log1p(after), np.log1p(own), sums[:, 0] / (sums[:, 1] + 1), passed / (whole + 1), block,
    ], axis=1)
    return out, parent, depth


def labels(page: Page) -> list[bool]:
    """Of a training page: whether a node holds any wanted text."""
    wanted = [False] * len(page.tag)
    bad = [False] * len(page.tag)
    for node, text, _ in page.texts:
        if text.strip():
            (bad if UNWANTED in text else wanted)[node] = True
    for k in range(len(page.tag) - 1, 0, -1):
        wanted[page.parent[k]] = wanted[page.parent[k]] or wanted[k]
        bad[page.parent[k]] = bad[page.parent[k]] or bad[k]
    return [w and not (b and not w) for w, b in zip(wanted, bad, strict=True)]


def _unwanted_first(page: Page) -> Page:
    """Text after a mark in its node is unwanted, too."""
    seen: set[int] = {node for node, text, _ in page.texts if UNWANTED in text}
    page.texts = [(node, text if node not in seen or UNWANTED in text else UNWANTED + text, b) for node, text, b in page.texts]
    return page


def train(n: int = TRAINING_PAGES, seed: int = 1) -> Model:
    batch = [_unwanted_first(parse(p)) for p in pages(n, seed)]
    target = [labels(p) for p in batch]
    for page in batch:
        page.texts = [(node, text.replace(UNWANTED, ""), b) for node, text, b in page.texts]
    counts: dict[str, list[int]] = {}
    for page, wanted in zip(batch, target, strict=True):
        for names, w in zip(_words(page), wanted, strict=True):
            for name in set(names):
                counts.setdefault(name, [0, 0])[w] += 1
    odds = {name: float(np.log((yes + 1) / (no + 1))) for name, (no, yes) in counts.items()}
    x, _, depth = features(batch, odds)
    y = np.asarray([w for wanted in target for w in wanted], float)
    has_text = np.exp(x[:, 7]) > 1.5
    use = has_text & (depth > 0)
    return Model(odds, boosting.fit(x[use], y[use], np.ones(int(use.sum()))))


def decode(log_odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The most likely choice in which every kept node has kept ancestors only."""
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
    all_dropped, best = drop.copy(), keep.copy()
    chosen = np.ones(len(parent), bool)
    for nodes in reversed(levels[1:]):
        chosen[nodes] = best[nodes] >= all_dropped[nodes]
        np.add.at(best, parent[nodes], np.maximum(best[nodes], all_dropped[nodes]))
        np.add.at(all_dropped, parent[nodes], all_dropped[nodes])
    for nodes in levels[1:]:
        chosen[nodes] &= chosen[parent[nodes]]
    return chosen


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    batch = [parse(s or "") for s in sources]
    x, parent, depth = features(batch, model.odds)
    score = np.where(depth == 0, 30.0, model.trees.log_odds(x))
    chosen = decode(score, parent, depth)
    out, offset = [], 0
    for page in batch:
        blocks: list[list[str]] = []
        fresh = True
        for node, text, broke in page.texts:
            fresh = fresh or broke
            if chosen[offset + node]:
                if fresh:
                    blocks.append([])
                    fresh = False
                blocks[-1].append(text)
        lines = (" ".join("".join(b).split()) for b in blocks)
        out.append("\n".join(line for line in lines if line))
        offset += len(page.tag)
    return out


def extracted(table: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of a table of pages.

    Null and empty pages and pages without an article have an empty text; repeated rows are extracted each; an empty
    table gives no rows; null ids and urls stay null; other columns are not read.
    """
    shared = table.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of_rows(batches, "html", 1 << 20):
            texts = main_texts(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    plain = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
