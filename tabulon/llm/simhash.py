"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Two fingerprints at distance <= r meet in a variant that is within r/2 of both. Every fingerprint therefore stands for its
ball of radius r/2 (2081 variants for r = 4), fingerprints are shuffled on variants, and those that share one are linked.

The shuffle does not carry the variants themselves. A GF(2)-linear hash H splits the variant space into buckets; since
H(x ^ m) = H(x) ^ H(m), a receiver of (bucket, x) lists exactly x's variants in that bucket from a table of flip masks
sorted by H(m), so each variant is made once, in the task that needs it, and a row on the wire stands for dozens of them.
H's bits are parities of classes of bit positions: flipping at most two bits changes at most two parities, so a ball of
radius 2 meets 1 + c + c(c-1)/2 of 2^c buckets only (22 of 64, 137 of 65,536).
Within a bucket a variant shared by several fingerprints yields a star instead of all pairs (all sharers are within r of
each other by the triangle inequality; each link is verified by popcount), and stars are reduced to a spanning forest, so
a bucket never emits more links than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import load, lookup, shielded, stored

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Bits that name a bucket, at least; as many as it takes for a bucket to get at most SPLIT_AT rows.
BUCKET_BITS = 6
SPLIT_AT = 2_000_000
#: Variants that a task holds at once; a bucket is worked through in sub-buckets of about so many.
VARIANTS_AT_ONCE = 1_000_000
HASH_BITS = 24
#: Min-hash bands and rows a band: sets of Jaccard 0.8 share no band once in 190,000 pairs, (1 - 0.8^6)^40.
BANDS, BAND_ROWS = 40, 6
#: Texts and characters of a block: of candidates that hang together, two blocks at a time are compared in one task.
BLOCK_TEXTS, BLOCK_CHARS = 4_000, 16_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; of the whole sequence if shorter; none for no words."""
    w = (text or "").encode().translate(_LOWER).split()  # bytes.split() splits at 20 and 09-0D
    if not w:
        return np.zeros(0, np.uint64)
    flat, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(flat, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((h(flat[a:b], seed) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(w) - words + 1)


_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """Per array: the 64-bit word whose bits are set in over half of its hashes (zero for none)."""
    out = np.zeros(len(hashes), np.uint64)
    full = [i for i, h in enumerate(hashes) if len(h)]
    if not full:
        return out
    n = np.array([len(hashes[i]) for i in full])
    flat = np.concatenate([hashes[i] for i in full]).astype("<u8").view(np.uint8).reshape(-1, 8)
    blocks = [np.arange(a, a + k, 255) for a, k in zip(np.cumsum(n) - n, n, strict=True)]  # a lane of 8 bits counts to 255
    first = np.cumsum([0, *map(len, blocks[:-1])])
    cuts = np.concatenate(blocks)
    fp = np.zeros(len(full), np.uint64)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[flat[:, byte]], cuts)
        for bit in range(8):
            ones = np.add.reduceat(((lanes >> np.uint64(8 * bit)) & np.uint64(255)).astype(np.int64), first)
            fp |= (2 * ones > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = fp
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per row of ``docs``; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, made, held, size = b.column(1), [], [], 0
            for t in texts:
                held.append(shingle_hashes(t.as_py(), words))
                size += len(held[-1])
                if size > 200_000:
                    made.append(majority(held))
                    held, size = [], 0
            made.append(majority(held))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(made).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _linear_hash() -> np.ndarray:
    """Eight tables of 256 whose XOR over a word's bytes is the hash: parities of six classes of bits, then of parts of these.

    The first b output bits tell max(b, 6) classes of input bits apart, which keeps the ball's buckets few at every b.
    """
    column = [1 << i % 6 | (0, 1 << 6 + i % 6, 1 << 12 + i % 6, 1 << 18 + i % 6)[i // 6 % 4] for i in range(BITS)]
    return np.array([[np.bitwise_xor.reduce([0, *(column[8 * i + j] for j in range(8) if b >> j & 1)]) for b in range(256)] for i in range(8)], np.int64)


_TABLES = _linear_hash()


def linear_hash(x: np.ndarray) -> np.ndarray:
    b = np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)
    out = _TABLES[0][b[:, 0]]
    for i in range(1, 8):
        out = out ^ _TABLES[i][b[:, i]]
    return out


def flip_masks(radius: int) -> np.ndarray:
    """All words of at most ``radius`` set bits: XORed to a fingerprint they give its ball."""
    return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(BITS), k)], np.uint64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b reduced to (node, smallest node of its component) for every node that isn't the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def bucket_links(fps: np.ndarray, bucket: int, bits: int, radius: int = RADIUS, at_once: int = VARIANTS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct ``fps`` that meet in a variant v with the low ``bits`` bits of H(v) equal to ``bucket``."""
    masks = flip_masks(radius // 2)
    mask_hash, fp_hash = linear_hash(masks), linear_hash(fps)
    more, variants = 0, len(fps) * len(masks) // len(np.unique(mask_hash & (1 << bits) - 1))
    while variants >> more > at_once and bits + more < HASH_BITS:
        more += 1
    low = (1 << (bits + more)) - 1
    by_class: dict[int, list[int]] = {}
    for i, c in enumerate((mask_hash & low).tolist()):
        by_class.setdefault(c, []).append(i)
    classes = {c: masks[i] for c, i in by_class.items()}
    order = np.argsort(fp_hash & low, kind="stable")
    sorted_hash = (fp_hash & low)[order]
    heads, starts = np.unique(sorted_hash, return_index=True)
    groups = dict(zip(heads.tolist(), np.split(fps[order], starts[1:]), strict=True))
    found_a, found_b = [], []
    for sub in range(1 << more):
        s, v, w = sub << bits | bucket, [], []
        smaller = groups if len(groups) <= len(classes) else {c ^ s: None for c in classes}
        for h in smaller:
            g, m = groups.get(h), classes.get(h ^ s)
            if g is not None and m is not None:
                v.append((g[:, None] ^ m[None, :]).ravel())
                w.append(np.repeat(g, len(m)))
        if not v:
            continue
        variants, owner = np.concatenate(v), np.concatenate(w)
        order = np.argsort(variants)
        variants, owner = variants[order], owner[order]
        same = np.flatnonzero(variants[1:] == variants[:-1]) + 1
        if not len(same):
            continue
        new = np.ones(len(variants), bool)
        new[same] = False
        head = np.maximum.accumulate(np.where(new, np.arange(len(variants)), 0))[same]
        a, b = owner[head], owner[same]
        near = np.bitwise_count(a ^ b) <= radius
        x, y = forest(a[near], b[near])
        found_a.append(x)
        found_b.append(y)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(found_a), np.concatenate(found_b)) if len(found_a) > 1 else (found_a[0], found_b[0])


def bucket_bits(n: int, radius: int = RADIUS) -> int:
    """Bits of a bucket's name so that a bucket of ``n`` fingerprints' balls has SPLIT_AT rows on average, at most."""
    hashes = linear_hash(flip_masks(radius // 2))
    bits = BUCKET_BITS
    while n * len(np.unique(hashes & (1 << bits) - 1)) >> bits > SPLIT_AT and bits < HASH_BITS:
        bits += 1
    return bits


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect exactly what pairs at distance <= ``radius`` connect; ``fps``: distinct fp long."""
    bits = bucket_bits(fps.count(), radius)
    low = (1 << bits) - 1
    syndromes = np.unique(linear_hash(flip_masks(radius // 2)) & low)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for part in np.array_split(x, max(1, len(x) * len(syndromes) // 1_000_000)):
                to = (linear_hash(part.view(np.uint64)) & low)[:, None] ^ syndromes[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), pa.array(np.repeat(part, len(syndromes)))], names=["bucket", "fp"])

    def meet(group: pa.Table) -> pa.Table:
        a, b = bucket_links(group["fp"].to_numpy().view(np.uint64), group["bucket"][0].as_py(), bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.mapInArrow(deal, "bucket int, fp long").groupBy("bucket").applyInArrow(meet, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): alternating large-star and small-star rounds until nothing changes; nodes without edges have no row."""

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        least = stored(near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("times")), "least")
        moved = lookup(near, least, ["u"], n, "times", F.col("v"))  # a hub's links are dealt
        if large:
            return stored(moved.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        return stored(moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        now = star(star(now, True, 2 * state[0]), False, 2 * state[0])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """(id_col, fingerprint, component_id) per row of ``docs``: 16 hex digits, and the smallest id reachable by links.

    Null or wordless texts have fingerprint zero and link like any other; repeated rows and equal texts share a component;
    a null id never is the smallest (a component of null ids only has a null component_id); an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "times", F.coalesce("root", "fp").alias("root")), "rooted")
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    n = prints.count()
    classes = lookup(rooted.select("fp", "times", "root"), by_root, ["root"], n, "fps", F.col("fp")).drop("root")
    out = lookup(prints, classes, ["fp"], n, "times", F.col("id"))  # one text may hold a third of all rows
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


_MIX = np.random.default_rng(20_240_502).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64) | np.array([[0], [1]], np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """[set, band]: equal keys where two sets have the same least hashes in all rows of a band; sets aren't empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for i, (x, m) in enumerate(_MIX.T):
        least = np.minimum.reduceat((flat ^ x) * m, starts)
        b = i // BAND_ROWS
        keys[:, b] = ((keys[:, b] ^ least) + np.uint64(b + 1)) * np.uint64(0x9E3779B97F4A7C15)
        keys[:, b] ^= keys[:, b] >> np.uint64(29)
    return keys


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of exact Jaccard >= ``similarity`` that connect exactly what all such pairs connect.

    Breadth first: a set is compared with those not reached yet, so that a group of near copies costs a few rounds.
    """
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    open_, n_open, listed, out = np.ones(len(sets), bool), len(sets), len(sets), []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        n_open -= 1
        queue = [root]
        while queue and n_open:
            if 2 * n_open < listed:  # postings of what is left only
                left = open_[owner]
                flat, owner, listed = flat[left], owner[left], n_open
            at = queue.pop()
            lo, hi = np.searchsorted(flat, sets[at]), np.searchsorted(flat, sets[at], "right")
            n = hi - lo
            met = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            who, both = np.unique(met[open_[met]], return_counts=True)
            near = who[both >= similarity * (size[at] + size[who] - both) - 1e-9]
            open_[near] = False
            n_open -= len(near)
            out += [(at, int(x)) for x in near]
            queue += near.tolist()
    return out


def _rows_of(docs: DataFrame) -> DataFrame:
    """(id, t, h) per row: a text (null counts as empty) and its hash, which with the id tells rows apart."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return rows.withColumn("h", F.xxhash64("t"))


def similar_links(docs: DataFrame, prints: DataFrame, similarity: float, words: int, block_texts: int = BLOCK_TEXTS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(a, b): links between fingerprints of texts whose shingle sets have Jaccard >= ``similarity``.

    Texts that share a min-hash band are candidates; what they connect is compared by exact Jaccard: sets of a block in one
    task, larger ones by pairs of blocks, so that a task holds two blocks however large a set is.
    """
    n, bits = prints.count(), BUCKET_BITS
    while n >> (bits - BUCKET_BITS) > SPLIT_AT and bits < HASH_BITS:
        bits += 1
    low = np.uint64((1 << bits) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = band_keys([np.unique(h) for h in held]).ravel()
            fps = np.repeat(majority(held).view(np.int64), BANDS)
            return pa.RecordBatch.from_arrays([pa.array((keys & low).astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(fps)], names=["bucket", "key", "fp"])

        for b in batches:
            held, size = [], 0
            for t in b.column(0):
                hashes = shingle_hashes(t.as_py(), words)
                if len(hashes):
                    held.append(hashes)
                    size += len(hashes)
                if size > 200_000:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    def meet(group: pa.Table) -> pa.Table:
        key, fp = group["key"].to_numpy(), group["fp"].to_numpy()
        order = np.argsort(key, kind="stable")
        key, fp = key[order], fp[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = fp[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        far = head != fp
        a, b = forest(head[far], fp[far]) if far.any() else (fp[:0], fp[:0])
        return pa.table({"a": a, "b": b})

    def compare(group: pa.Table) -> pa.Table:
        texts = dict(zip(group["t"].to_pylist(), group["fp"].to_pylist(), strict=True))
        found = similar_forest([shingle_set(t, words) for t in texts], similarity)
        fps = list(texts.values())
        return pa.table({"a": pa.array([fps[i] for i, _ in found], pa.int64()), "b": pa.array([fps[j] for _, j in found], pa.int64())})

    shared = _rows_of(docs).select("t").mapInArrow(deal, "bucket int, key long, fp long")
    candidates = components(shared.groupBy("bucket").applyInArrow(meet, "a long, b long"))
    may = candidates.select(F.col("node").alias("fp"), F.col("root").alias("may"))
    may = may.union(may.select(F.col("may").alias("fp"), "may").distinct())
    texts = prints.groupBy("h", "fp").agg(F.min("id").alias("of_id"), F.first("chars").alias("chars")).withColumnRenamed("h", "of_h")  # a row of each text
    texts = stored(texts.join(may, "fp"), "grouped")
    sets = texts.groupBy("may").agg(F.count(F.lit(1)).alias("times"), F.sum("chars").alias("chars"))
    sets = sets.select("may", "times", F.greatest(F.ceil(F.col("times") / block_texts), F.ceil(F.col("chars") / block_chars)).cast("int").alias("blocks"))
    wanted = lookup(texts.select("of_id", "of_h", "fp", "may"), sets, ["may"], n, "times", F.col("of_h"))
    wanted = stored(wanted.withColumn("block", F.pmod(F.xxhash64("of_h"), F.col("blocks")).cast("int")), "wanted")
    rows = _rows_of(docs)
    rows = rows.join(wanted.hint("shuffle_hash"), rows["id"].eqNullSafe(wanted["of_id"]) & (rows["h"] == wanted["of_h"]))
    pair = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    rows = rows.select("may", "fp", "t", "block", F.explode(pair).alias("other"))
    rows = rows.select("may", "fp", "t", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return rows.groupBy("may", "low", "high").applyInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, similarity: float | None = None, **blocks: int) -> DataFrame:
    """``docs`` with one document of each component: the least by id (null last) and text hash. Of rows that repeat both, one stays.

    With a ``similarity``, texts whose shingle sets reach that Jaccard are linked too, however far their fingerprints are.
    A null text counts as empty; an empty table stays empty; columns are those of ``docs``, whatever they are called.
    """
    whole, (docs, name) = docs, shielded(docs)
    docs = docs.withColumnsRenamed({name["doc_id"]: "doc_id", name["text"]: "text"})
    rows = _rows_of(docs)
    key = F.struct("id", "h", F.char_length("t").alias("chars"))
    prints = stored(fingerprints(rows.select(key.alias("k"), "t"), "k", "t", words).select("id.id", "id.h", "id.chars", "fp"), "prints")
    fps = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("times")), "nodes")
    near = links(fps.select("fp"), radius)
    if similarity is not None:
        near = near.union(similar_links(docs, prints, similarity, words, **blocks))
    roots = fps.join(components(near).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "times", F.coalesce("root", "fp").alias("root"))
    rooted = stored(lookup(prints.select("id", "h", "fp"), roots, ["fp"], prints.count(), "times", F.col("h")).select("id", "h", "root"), "rooted")
    keep = stored(rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("k")).select(F.col("k.id").alias("keep_id"), F.col("k.h").alias("keep_h")), "keep")
    here = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    # hinted, so that the plan is the same at every size
    out = docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["keep_id"]) & (here == keep["keep_h"]), "left_semi")
    repeated = rooted.groupBy("id", "h").count().where("count > 1").limit(1)
    if repeated.count():
        out = out.withColumn("hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).dropDuplicates(["doc_id", "hash"])
    return out.select(*docs.columns).toDF(*whole.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at 4 differing bits of 64."""
    return near_duplicates(load(spark, sf_dir, "documents"))
