"""Training-data operators against brute force on small texts with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from obsflow.llm import chunks, decontaminate, extract, lbl, licenses, packing, quality, rans, repeats, simhash
from obsflow.llm.components import components
from obsflow.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, d long, marks string, kept boolean, g long"


def prose(draw, n):
    return " ".join("".join(draw.choice(["th", "er", "on", "in", "ea", "st", "ou"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(8)
    base = [prose(draw, draw.randint(30, 160)) for _ in range(24)]
    passage = prose(draw, 60)
    out = [*base, base[3], base[3] + " end", base[5][:200] + "X" + base[5][200:], "Ä" + base[7], passage + ". " + base[8], base[9] + "\n" + passage, None, "", " \n ", "one", "a b", "\x85é x"]
    out += [" ".join(["same words again here"] * 40), "| " * 60 + "x y", "long " + prose(draw, 9000)]
    return [(k, t) for k, t in enumerate(out)] + [(3, base[3]), (None, base[2]), (None, None)]


def frame(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i == 4 else "s", 0, 7, 8, "m", True, 9) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rans_round_trip(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = rans.round_trip(docs, path).collect()
    assert len(rows) == len(texts)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i))
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    assert got == Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in texts)
    assert rans.round_trip(empty, path).count() == 0


def test_rans_stretches_and_damage():
    draw = np.random.default_rng(1)
    ids = draw.zipf(1.3, 300_000) % 500
    table = rans.Table.of(np.bincount(ids, minlength=600))
    block = rans.to_block(np.asarray([1]), np.asarray([False]), np.asarray([len(ids)]), ids, table)
    assert (rans.from_block(block, table)[3] == ids).all()
    step = rans.LANES * rans.EVERY
    assert (rans.from_block(block, table, stretch=1)[3] == ids[step : 2 * step]).all()
    with pytest.raises(ValueError):
        rans.from_block(block[:900] + bytes([block[900] ^ 1]) + block[901:], table)
    assert len(block) < 4 * len(ids)


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want, total = Counter(), 0
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    rows = packing.pack(docs, path).collect()
    assert Counter(tuple(r[:5]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-total // 1024) + 1
    assert packing.pack(empty, path).count() == 0


def test_patterns_hold_every_piece():
    draw = np.random.default_rng(2)
    for counts in (draw.integers(0, 40, 257), np.bincount([200] * 70 + [90] * 7 + [1], minlength=257)):
        counts[0] = 0
        held = Counter()
        for lengths, copies in packing.patterns(counts, 256, least=200):
            assert sum(lengths) <= 256
            held.update({n: lengths.count(n) * copies for n in set(lengths)})
        assert held == Counter({n: int(c) for n, c in enumerate(counts) if c})


def test_decontamination(spark, docs, texts, empty):
    source = dict((i, t) for i, t in texts if i is not None)
    items = [(1, source[0][:150].rsplit(" ", 1)[0]), (2, "quite another thing is said in this one here"), (3, None), (4, ""), (5, source[2].upper().replace(" ", ", ")), (6, "one"), (6, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    want = {}
    for i, t in texts:
        tokens = decontaminate.folded_words(t)
        for item, passage in items:
            own = decontaminate.folded_words(passage)
            if not own or not tokens:
                continue
            counts = Counter(decontaminate.shingles(own, 5).tolist())
            for k in range(max(1, len(tokens) - len(own) + 1)):
                score = decontaminate.similarity(Counter(decontaminate.shingles(tokens[k : k + len(own)], 5).tolist()), counts)
                if score >= 0.8:
                    want[i, item] = max(score, want.get((i, item), 0))
    assert got == want and {(0, 1), (2, 5)} <= want.keys()
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in texts} - {i for i, _ in want if i is not None}


def test_lbl_scores(docs, texts, empty):
    rows = lbl.scored(docs).collect()
    tokens = {(i, t): lbl.split_words(t) + [b""] for i, t in texts}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in texts if not held(i) for w in tokens[i, t])
    total = np.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    want = Counter((i, held(i), len(w), sum(counts[x] > 0 for x in w), round(float(sum(np.log10(counts[x] + 0.1) - total for x in w)), 4)) for (i, t), w in ((x, tokens[x]) for x in texts))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in rows)
    assert lbl.scored(empty).count() == 0


def test_chunks_find_repeats_and_survive_shifts(docs, texts, empty):
    rows = chunks.repeated_passages(docs).collect()
    found = {r.doc_id for r in rows}
    assert {24, 25, 26, 27, 29} <= found and not found & set(range(24))
    assert all(r.end - r.start >= 100 for r in rows)
    assert chunks.repeated_passages(empty).count() == 0
    draw = random.Random(1)
    text = prose(draw, 800).encode()
    cut = lambda b: set(b[a:e] for cuts in chunks.boundaries(np.frombuffer(b, np.uint8), np.asarray([len(b)])) for a, e in zip([0, *cuts[:-1]], cuts, strict=True))
    assert len(cut(text) - cut(text[:500] + b"inserted" + text[500:])) <= 3


def test_quality_counts(docs, texts, empty):
    rows = quality.quality(docs).collect()
    want = Counter()
    for i, t in texts:
        t = t or ""
        w = t.encode().split()
        windows, covered = defaultdict(list), set()
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        for places in windows.values():
            if len(places) > 1:
                for k in places:
                    covered.update(range(k, k + 8))
        lines = [x for x in t.split("\n") if x.encode().split()]
        counts = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        want[(i, *counts, counts[0] < 20 or 100 * counts[4] > 30 * counts[0])] += 1
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r[n] for n in names) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    kept = {r.doc_id for r in rows if r.kept}
    assert set(range(24)) <= kept and 37 not in kept
    assert quality.quality(empty).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns


def naive_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash_components(docs, texts, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i, t] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    roots = naive_components(sorted(set(prints.values())))
    least = defaultdict(list)
    for (i, _), p in prints.items():
        if i is not None:
            least[roots[p]].append(i)
    want = Counter((i, f"{prints[i, t]:016x}", min(least[roots[prints[i, t]]], default=None)) for i, t in texts)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.one_of_each(docs).collect()
    assert {24, 3} & {r.doc_id for r in left} == {3} and sum(r.doc_id == 3 for r in left) == 1


def test_large_cells_link_exactly(spark):
    draw = random.Random(6)
    base = draw.getrandbits(64)
    values = {base}
    while len(values) < 150:  # a family around one value, and strangers
        values.add(draw.choice(sorted(values)) ^ (1 << draw.randrange(64)) ^ (draw.random() < 0.5) * (1 << draw.randrange(64)))
    values |= {draw.getrandbits(64) for _ in range(100)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    got = {r.node & (1 << 64) - 1: r.root for r in found.collect()}
    roots = naive_components(sorted(values))
    groups = defaultdict(set)
    for v, r in roots.items():
        groups[r].add(v)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k in got if got[k] == r) for r in set(got.values())}


def test_repeated_strings(spark, docs, texts, empty):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups run over batches
    try:
        rows = repeats.repeated_strings(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {}
    order = lambda i: repeats.LAST if i is None else i
    for i, t in texts:
        data = (t or "").encode()
        for k in range(len(data) - 49):
            first[data[k : k + 50]] = min(order(i), first.get(data[k : k + 50], repeats.LAST))
    want = Counter()
    for i, t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < order(i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()] += 1
    assert Counter((r._row.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows) == want
    assert repeats.repeated_strings(empty).count() == 0


def test_licences(spark, empty):
    notices = ["Released under the MIT License.", "x y\nThis work is licensed under the GNU General Public License, version 3.\nz", "Licensed under CC BY-NC 4.0.", "All rights reserved.", None, "", "the state of the art in general"]
    frame = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(notices)], "doc_id long, text string, probability double")
    model = licenses.train(spark, licenses.PLAIN)
    got = {r.doc_id: (r.family, r.paragraph) for r in licenses.licenses(frame, model).collect()}
    assert got == {0: ("mit", 0), 1: ("gpl", 1), 2: ("cc-by-nc", 0), 3: ("proprietary", 0)}
    assert licenses.licenses(empty, model).count() == 0


def test_main_text(spark):
    model = extract.train(250)
    page = (
        "<html><head><title>T</title><script>x('<p>')</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Title &amp; more</h1><p><b>First\n  line here, with enough words to read.<br><p>Second paragraph of the text, also long enough.</p></article>"
        "<section class='comments'><h3>Comments</h3><div class='comment'><p>Nice one, I liked it.</p></div></section><footer>&copy; site</footer></bo"
    )
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "v", page, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extracted(rows, model).collect()}
    want = "Title & more\nFirst line here, with enough words to read.\nSecond paragraph of the text, also long enough."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), None: (want, len(want))}


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    draw = random.Random(2)
    clean = [prose(draw, 80) for _ in range(12)]
    texts = [*clean, clean[1], clean[2] + "\n" + prose(draw, 40), "too short", "#### " * 50, clean[5] + " " + "the benchmark asks for exactly these nine or ten words"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "The benchmark asks for exactly these nine or ten words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert left == set(range(12)) | {13}
    assert spark.range(1).select(F.lit(1)).count() == 1
