import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tabulon.llm import simhash, sketches


def shingles(text, n=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def brute_print(text):
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = np.array([brute_print(t) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4), strict=True):
        parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, f"{int(f):016x}", least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))}


def corpus():
    r = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(30, 400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(120):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((1000 + k, " ".join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "Ab"), (5004, "aB"), (5005, "x y z"), (5003, "Ab"), (6000, "long " * 50000)]


def test_near_duplicates(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS id", "3 AS component_id")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == brute_components(rows)
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_components(rows)})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_balls_find_every_pair():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 100, np.uint64)
    flips = [np.array([sum(1 << int(b) for b in r.choice(64, k, False)) for _ in base], np.uint64) for k in (1, 2, 3, 4, 5)]
    x = np.unique(np.concatenate([base, *[base ^ f for f in flips]]))

    def labels(a, b):
        d = dict(zip(*(v.tolist() for v in simhash.forest(a, b)), strict=True))
        return [d.get(v, v) for v in x.tolist()]

    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    for bits, at_once in ((6, 1 << 20), (6, 500), (2, 10_000), (11, 1 << 20)):
        found = [simhash.bucket_links(x, b, bits, 4, at_once) for b in range(1 << bits)]
        assert labels(*(np.concatenate([f[k] for f in found]) for k in (0, 1))) == labels(x[i], x[j])


def test_buckets_stay_bounded():
    masks = simhash.linear_hash(simhash.flip_masks(2))
    for n in (10**3, 2 * 10**6, 16 * 10**6, 10**9, 50 * 10**9):
        bits = simhash.bucket_bits(n)
        rows = len(np.unique(masks & (1 << bits) - 1))
        assert n * rows >> bits <= simhash.SPLIT_AT and rows <= 1 + bits + bits * (bits - 1) // 2


def test_hubs_are_dealt(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 5000) for i in range(1, 3000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for e in edges for i in e if i}


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


def test_sketches_estimate(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    a = [r.choice(words) for _ in range(2000)]
    b = a[:1000] + [r.choice(words) for _ in range(1000)]
    rows = [(1, " ".join(a), " ".join(b)), (2, "same text here", "same text here"), (3, None, ""), (4, "", "one two"), (5, "x " * 30000, "x")]
    F = sketches.F
    t = spark.createDataFrame(rows, "id int, a string, b string").select("id", sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    got = {x.id: x for x in t.select("id", sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("a"), F.col("b")).alias("c"), sketches.distinct_shingles(F.col("a")).alias("n")).collect()}
    sa, sb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    assert abs(got[1].r - len(sa & sb) / len(sa | sb)) < 0.15 and abs(got[1].c - len(sa & sb) / len(sa)) < 0.2 and abs(got[1].n / len(sa) - 1) < 0.3
    assert (got[2].r, got[3].r, got[4].r, got[5].n) == (1.0, 1.0, 0.0, 1.0)


def test_sketches_merge(spark):
    F = sketches.F
    parts = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, "h i j k l m n o"), (2, ""), (None, "p q r s t")], "k int, t string")
    got = {x.k: list(x.s) for x in sketches.merged(parts.select("k", sketches.sketch(F.col("t"), 3).alias("s")), "k", "s", 3).collect()}
    one = {x.k: list(x.s) for x in parts.groupBy("k").agg(F.flatten(F.collect_list(sketches.sketch(F.col("t"), 1000))).alias("s")).collect()}
    assert got == {k: sorted(set(v))[:3] for k, v in one.items()}


def test_next_documents(spark, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(sketches, "FEW", 20)
    rows = [(i, "".join(r.choice("ab cdé ") for _ in range(r.randint(0, 40)))) for i in r.sample(range(-(10**6), 10**6), 1500)] + [(None, "null id"), (2 * 10**6, "aa"), (2 * 10**6, "ab"), (1 << 62, "far")]
    rows += [(77, f"text {i}") for i in range(300)]  # an id that fills whole ranges
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS b", "2 AS last")
    got = [(x.doc_id, x.text, x.next_t) for x in sketches.with_next(docs, {"t": sketches.F.col("text")}).collect()]
    hashes = {x.text: x.h for x in docs.select("text", sketches.F.xxhash64("text").alias("h")).collect()}
    rows.sort(key=lambda x: (-(x[0] if x[0] is not None else -1 << 63), hashes[x[1]]))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted([(a[0], a[1], b[1]) for a, b in zip(rows, rows[1:] + rows[:1], strict=True)], key=key)
    with pytest.raises(TypeError):
        sketches.with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"), {})


def test_ranges_are_even(spark):
    F = sketches.F
    ids = spark.range(2000).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(1 << 61,)], "doc_id long"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / 8 for i in range(1, 8)], 1000)).first()[0]
    n = [x["count"] for x in ids.groupBy(sketches._range_of(F.col("doc_id"), F.xxhash64("doc_id"), cuts)).count().collect()]
    assert len(n) == 8 and max(n) <= 252


def sketch_of(spark, text):
    """A bottom-k sketch by brute force; only the hash of a list of words is Spark's."""
    w = re.split(r"[ \t\n\x0b\x0c\r]+", text.lower())
    w = [x for x in w if x]
    shingles = [w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else []
    if not shingles:
        return []
    got = spark.createDataFrame([(s,) for s in shingles], "s array<string>").select(sketches.F.xxhash64("s").alias("h")).collect()
    return sorted({x.h for x in got})[:128]


def test_op10_by_brute_force(spark):
    rows = [(5, "one two three four five six seven " * 4), (4, None), (3, "A b\tc"), (3, "A b\tc"), (2, ""), (None, "seven six five four three two one " * 60 + "".join(f"w{i} " for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS body", "2 AS sketch", "3 AS edited")
    got = sorted(sketches.edited_fingerprints(docs).collect(), key=lambda x: (x.doc_id is None, -(x.doc_id or 0)))
    texts = [t or "" for _, t in rows]
    print_of = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in s)

    def alike(a, b):
        union = sorted({*a, *b})[:128]
        return sum(h in a and h in b for h in union) / len(union) if union else 1.0

    for x, t, n in zip(got, texts, texts[1:] + texts[:1], strict=True):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        a, b, c = (sketch_of(spark, s) for s in (t, edited, n))
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (print_of(a), print_of(b)) and abs(x.near_edited - alike(a, b)) < 1e-12 and abs(x.near_next - alike(a, c)) < 1e-12
    assert sketches.edited_fingerprints(docs.limit(0)).count() == 0


def test_op10_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in sketches.op10_fingerprints(spark, sf).collect()}
    for (i, x), (_, y) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(x) // 3
        assert got[i].edited_sha256 == hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest() and got[i].n_chars == len(x) and 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1


def test_op10_where_broadcasts_are_small(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        sketches.op10_fingerprints(spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "x"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "x")).collect()}
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    assert len(got) == len(docs)
    for (i, x), (_, y) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(x) // 3
        assert got[i].edited_sha256 == hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest()
