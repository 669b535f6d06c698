import random

import numpy as np

from tabulon.llm import simhash


def sets_of(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(800)]
    rows = []
    for k in range(40):
        w = [r.choice(words) for _ in range(r.randint(60, 300))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(4):
            v = list(w)
            for _ in range(r.randint(1, max(1, len(v) // 30))):
                v[r.randrange(len(v))] = r.choice(words)
            rows.append((len(rows), " ".join(v)))
    return rows


def test_all_pairs_of_jaccard_are_linked(spark):
    rows = corpus()
    s = [sets_of(t) for _, t in rows]
    fps = np.array([int(simhash.majority([simhash.shingle_hashes(t, 5)])[0]) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    far = 0
    for i in range(len(rows)):
        for j in range(i):
            alike, close = len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8, int(fps[i] ^ fps[j]).bit_count() <= 4
            far += alike and not close
            if alike or close:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert far > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x.doc_id for x in simhash.keep_one(docs, words=5, similarity=0.8).collect())
    assert got == sorted({find(i) for i in range(len(rows))})
    blocks = simhash.keep_one(docs.selectExpr("*", "1 AS hash", "2 AS keep_id", "3 AS row"), words=5, similarity=0.8, block_texts=2, block_chars=4_000)
    assert sorted(x.doc_id for x in blocks.collect()) == got and blocks.columns == ["doc_id", "text", "hash", "keep_id", "row"]
    assert simhash.keep_one(docs.limit(0), words=5, similarity=0.8).count() == 0


def test_forest_equals_all_pairs():
    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 1 << 63, 60, np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[r.random(len(b)) > 0.08], r.integers(0, 1 << 63, 3, np.uint64)])) for b in base for _ in range(8)]
    sets.append(np.array([5], np.uint64))

    def labels(pairs):
        at = list(range(len(sets)))
        for i, j in pairs:
            a, b = at[i], at[j]
            at = [min(a, b) if x in (a, b) else x for x in at]
        return at

    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    got = simhash.similar_forest(sets, 0.8)
    assert labels(got) == labels(pairs) and all(jaccard(sets[i], sets[j]) >= 0.8 for i, j in got)
