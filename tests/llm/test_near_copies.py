"""The near-duplicate stage of the pipeline on planted copies."""

import random

import corpus_pipeline
from obsflow.llm import near_copies


def words(draw, n):
    return ["".join(draw.choice(["th", "er", "on", "in", "ea", "st", "ou"]) for _ in range(draw.randint(2, 5))) for _ in range(n)]


def grams(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def edited(draw, text, edits):
    w = text.split()
    for k in draw.sample(range(0, len(w), 12), edits):
        w[k] = "edited" + str(draw.randrange(10**6))
    return " ".join(w)


def roots(texts, least):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [grams(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(k) for k in range(len(texts))}


def test_stage_drops_planted_copies(spark):
    draw = random.Random(5)
    texts, planted = [], {}
    for edits in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10):
        for _ in range(6):
            base = " ".join(words(draw, 400))
            texts += [base, edited(draw, base, edits)]
            planted[len(texts) - 1] = jaccard(*texts[-2:])
    base = " ".join(words(draw, 300))  # one family of more members than a cell is compared pair by pair
    texts += [base] + [edited(draw, base, draw.randint(1, 9)) for _ in range(90)]
    texts += ["one two", "One  two", "", " \n", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (0, texts[0], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert any(0.8 <= s < 0.85 for s in planted.values()) and any(s > 0.95 for s in planted.values()) and any(s < 0.8 for s in planted.values())
    assert not {k for k, s in planted.items() if s >= 0.8} & set(got)
    assert {k for k, s in planted.items() if s < 0.8} <= set(got)
    assert got == sorted(roots([t or "" for t in texts], 0.8))
    assert left.where("doc_id is null").count() == 1
    assert near_copies.one_of_each(docs.where("false")).count() == 0


def test_pivot_tables_link_without_bands(spark):
    draw = random.Random(9)
    base = " ".join(words(draw, 900))
    texts = [base, edited(draw, base, 1), edited(draw, base, 2)] + [" ".join(words(draw, 200)) for _ in range(5)] + [""]
    texts += [" ".join([base, base]), base + " " + base.split()[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS text_hash")
    nodes = near_copies._signatures(docs, 5).cache()
    within = {r.doc_id: r.fp for r in nodes.collect()}
    near = {(a, b) for a in within for b in within if a < b and ((within[a] ^ within[b]) & (1 << 64) - 1).bit_count() <= 2 and texts[a] and texts[b]}
    assert near and any((within[a] ^ within[b]) for a, b in near) and not any(3 <= x <= 8 for p in near for x in p)
    # no band has a key, so that every link comes from the pivot tables
    found = near_copies.links(nodes.selectExpr("doc_id", "text_hash", "node", "n", "fp", "slice(bands, 1, 0) AS bands"), docs, 5, 0.8)
    name = {r.node: r.doc_id for r in nodes.collect()}
    linked = {tuple(sorted((name[r.a], name[r.b]))) for r in found.collect()}
    assert linked and linked <= {p for p in near if jaccard(texts[p[0]], texts[p[1]]) >= 0.8}
