"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / size copies. Documents are ordered by size class, then by a hash of id and
text; the prefix sum of expected copies, moved by one random offset a source, is cut at the integers, and a document is
emitted once for each integer it crosses. The order is dealt over (source, size class, leading bits of the hash) buckets, so
that a source with a third of all rows is no task of its own; only the buckets' counts are summed up per source. More rows
make more buckets, never another order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import load, numbered, shielded, stored

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
#: Rows of a bucket, about, of a size class that holds an eighth of all; buckets of a class are a power of two, 64 at least.
BUCKET_ROWS = 4_096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes between a power of two and the next; sizes below eight are their own."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.call_function("shiftright", size, bits - 4) % 8).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (skey, source, source_size: one row a source) with target double.

    Targets share the sum of sizes by weight, weights repeating over sources by code point, null last; a target stops at
    ``most`` times its source's size and the excess is shared anew until none is above. Each round of sharing is an
    aggregation, and the places are numbered in parallel, so that sources may be as many as hosts. Sizes are multiplied as
    decimals: a weight times the words of all sources is beyond an int in a few GB, and caps times many weights beyond a long.
    """
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    w = stored(placed.select("skey", "source_size", (F.col("source_size") * most).alias("cap"), weight.alias("w")), "weights")
    whole = lambda c: c.cast("decimal(19,0)")
    above_level = lambda: whole(F.col("cap")) * whole(F.lit(rest_w)) <= whole(F.col("w")) * whole(F.lit(rest))
    total, rest_w = w.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    rest, full = total, None
    while rest_w:
        # who is above the level, among the sources that share it
        above = above_level()
        caps, ws, n = w.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(above, F.col("w"))), F.count(F.when(above, 1))).first()
        if n == full:
            break
        full, rest, rest_w = n, total - (caps or 0), w.agg(F.sum("w")).first()[0] - (ws or 0)
    level = (whole(F.col("w")) * whole(F.lit(rest))).cast("double") / F.lit(float(rest_w or 1))
    capped = above_level() if rest_w else F.lit(True)
    return w.select("skey", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(level).alias("target"))


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, keep: bool = True) -> DataFrame:
    """``docs`` (all columns if ``keep``, else id_col) with mix_size, mix_source_size, mix_target and mix_copies of each row.

    A null text has size 0; null is a source of its own, after all others; a source without words has target 0 and no
    copies. Repeated rows count each. The same rows give the same copies on every run: ties are broken by the row's hash.
    An empty table gives no rows; columns of ``docs`` may have any names, those of these four included (the new ones are last).
    """
    inner, name = shielded(docs)
    at, text, place = (F.col(name[c]) for c in (id_col, text_col, source_col))
    kept = inner.columns if keep else [name[id_col]]
    body = F.concat(F.coalesce(at.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit("")))
    rows = inner.select(*kept, word_count(text).alias("size"), F.coalesce(F.concat(F.lit("s"), place.cast("string")), F.lit("n")).alias("skey"), F.coalesce(_hex(body, 8), F.lit(0)).alias("hash"))
    bits = max(6, (docs.count() // (8 * BUCKET_ROWS)).bit_length())
    # never null, and said so: else the join's null filter would count the words once more for each mention
    rows = rows.withColumns({"class": F.coalesce(size_class(F.col("size")), F.lit(0)), "salt": F.coalesce(F.call_function("shiftright", "hash", F.lit(32 - bits)).cast("int"), F.lit(0))})
    key = ["skey", "class", "salt"]
    counted = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "buckets")
    sizes = counted.groupBy("skey").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30)))
    # two levels, so that no task sums up all buckets of a hot source: classes are few, salts grow with the table
    earlier = lambda parts, order: F.coalesce(F.sum("n").over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_class = counted.groupBy("skey", "class").agg(F.sum("n").alias("n")).select("skey", "class", earlier(["skey"], "class").alias("lower"))
    within = counted.withColumn("within", earlier(["skey", "class"], "salt")).join(by_class, ["skey", "class"])
    offset = _hex(F.concat(F.lit(f"{seed}|"), F.col("skey")), 5) / F.lit(float(1 << 20))
    shares = targets(sizes, weights, most)
    buckets = within.select(*key, (F.col("lower") + F.col("within")).alias("before")).join(shares, "skey").withColumn("offset", offset)
    out = rows.join(buckets, key)
    tie = F.xxhash64(*[c for c, t in inner.select(*kept).dtypes if "map<" not in t and "variant" not in t], F.lit(0))
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*key).orderBy("hash", "size", at.asc_nulls_last(), tie))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = out.withColumns({"rank": rank, "expected": expected})
    crossed = F.floor(F.col("offset") + F.col("rank") * F.col("expected")) - F.floor(F.col("offset") + (F.col("rank") - 1) * F.col("expected"))
    made = [F.col("size"), F.col("source_size"), F.col("target"), F.least(crossed, F.ceil("expected")).alias("copies")]
    return out.select(*kept, *made).toDF(*(docs.columns if keep else [id_col]), "mix_size", "mix_source_size", "mix_target", "mix_copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; same columns, whatever they are called."""
    inner, name = shielded(docs)
    out = copies(inner, name[id_col], name[text_col], name[source_col], **how).where("mix_copies > 0")
    out = out.withColumn("mix_copies", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return out.select(*inner.columns).toDF(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    got = copies(load(spark, sf_dir, "documents"), keep=False)
    return got.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


ORACLE = f"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         coalesce('s' || source, 'n') AS skey,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY skey),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * {MOST} AS cap FROM p),
q AS (SELECT *, cap / w AS ratio FROM w),
c AS (SELECT *, sum(cap) OVER (ORDER BY ratio, place) AS caps, sum(w) OVER (ORDER BY ratio, place) AS ws,
             sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM q),
f AS (SELECT *, caps + ratio * (all_w - ws) <= total AS is_full FROM c),
g AS (SELECT *, total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest,
             all_w - sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS rest_w FROM f),
t AS (SELECT skey, source_size,
             CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(rest_w AS DOUBLE) END AS target,
             CAST('0x' || substr(md5('{SEED}|' || skey), 1, 5) AS BIGINT) / 1048576.0 AS u FROM g),
n AS (SELECT r.*, t.source_size, t.target, CAST(t.u AS DOUBLE) AS u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
             row_number() OVER (PARTITION BY r.skey ORDER BY CASE WHEN r.size < 8 THEN r.size ELSE length(bin(r.size)) * 8 + (r.size >> (length(bin(r.size)) - 4)) % 8 END, r.hash, r.size, r.doc_id NULLS LAST) AS k
      FROM r JOIN t ON r.skey = t.skey)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(u + k * e) - floor(u + (k - 1) * e), ceil(e)) AS BIGINT) * size AS taken
FROM n
"""
