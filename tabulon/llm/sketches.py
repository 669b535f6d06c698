"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge to the
sketch of the whole; two of them estimate resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import load, stored

K = 128
WORDS = 5
#: Documents are put in order by ranges of ids, cut at quantiles: of FEW documents about, but at most RANGES ranges.
FEW, RANGES = 256, 32_768
#: Parts by text hash of an id that fills whole ranges: six leading bits.
PARTS = 64
#: One row a range is broadcast up to so many (40 bytes each).
BROADCAST_ROWS = 500_000
LEAST_ID = -(1 << 63)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Bottom-k sketch of a text (lower-cased, white-space words): the whole sequence if shorter than a shingle; [] for no words or null."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    # the words are bound to a lambda's variable, so that they are split once, not once a shingle
    hashes = F.transform(F.array(split), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words)))).otherwise(F.array().cast("array<bigint>")))
    return F.slice(F.sort_array(F.array_distinct(F.element_at(hashes, 1))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of distinct shingles in common, 0 to 1; two empty sketches are alike, an empty and another one not."""
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.greatest(F.size(union), F.lit(1)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = (F.element_at(a, F.when(F.size(a) > 0, F.size(a)).otherwise(F.lit(None))).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too; 1 for an empty a."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / F.greatest(na, F.lit(1.0))))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def merged(parts: DataFrame, key: str, sketch_col: str, k: int = K) -> DataFrame:
    """(key, sketch_col): one sketch a key from any number of parts. A hot key's hashes are thinned to k in 64 slices first."""
    hashes = parts.select(key, F.explode(sketch_col).alias("h")).withColumn("slice", F.pmod("h", F.lit(64))).distinct()
    first = Window.partitionBy(key, "slice").orderBy("h")
    thin = hashes.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    last = thin.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("n") <= k)
    full = last.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))
    keys = parts.select(key).distinct()
    return keys.join(full, keys[key].eqNullSafe(full[key]), "left").select(keys[key], F.coalesce(sketch_col, F.array().cast("array<bigint>")).alias(sketch_col))


def _literal(numbers: list, kind: str) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def _range_of(at: Column, h: Column, cuts: list[int]) -> Column:
    """The place, later for lower ids, of the range of ``at``; ranges begin at ``cuts``. An id that fills whole ranges is dealt over PARTS by ``h``."""
    edges, heavy = sorted(set(cuts)), sorted(c for c, k in Counter(cuts).items() if k > 1)
    if not edges:
        return F.lit(0).cast("long")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(edges).bit_length()))))
    edge = lambda i: F.element_at(_literal(edges, "bigint"), F.least(i, F.lit(len(edges))))
    # the id goes through the state: as a free variable of the function the optimiser overlooks it
    start = F.struct(F.lit(0).alias("n"), at.alias("at"))
    step = lambda a, s: F.when((a["n"] + s <= len(edges)) & (edge(a["n"] + s) <= a["at"]), a["n"] + s).otherwise(a["n"])
    found = F.aggregate(steps, start, lambda a, s: F.struct(step(a, s).alias("n"), a["at"].alias("at")), lambda a: a["n"])
    part = F.when(F.array_contains(_literal(heavy, "bigint"), at), F.call_function("shiftright", h, F.lit(58)) + PARTS // 2).otherwise(0) if heavy else F.lit(0)
    return (part - found.cast("long") * PARTS).cast("long")


def with_next(docs: DataFrame, values: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus, for each of ``values`` computed on a document, next_<name>: that of the next document by descending id.

    After the last document comes the first. Ids are whole numbers (a TypeError otherwise); a null id counts as the lowest;
    of rows that repeat an id, the smaller xxhash64 of the text comes first. A null text is a text of its own. An empty table
    gives no rows. Texts move once: by ranges of ids, cut at quantiles, so that gaps between ids don't matter; a range's last
    document gets its successor, the first one of the next range, by a join of one row a range, whose texts alone are picked
    out by a second scan. Names that begin with two underscores must be free.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col}: the order of documents is that of whole numbers")
    # ranges and documents in them are in ascending order of (minus the range of ids, minus the id, the text's hash)
    rows = docs.withColumns({"__at": F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)), "__h": F.xxhash64(text_col)})
    n = rows.count()
    ranges = max(1, min(n // FEW, RANGES))
    cuts = rows.agg(F.percentile_approx("__at", _literal([i / ranges for i in range(1, ranges)], "double"), 20 * ranges)).first()[0] if ranges > 1 else []
    rows = rows.withColumn("__b", _range_of(F.col("__at"), F.col("__h"), cuts))
    order = [F.col("__at").desc(), F.col("__h")]
    # a row a range, whose number doesn't grow with the table: RANGES, and PARTS for each id that fills two of them
    tops = stored(rows.groupBy("__b").agg(F.min(F.struct((-1 - F.col("__at")).alias("a"), "__h")).alias("top")), "tops")
    heads = tops.withColumn("__of", F.coalesce(F.lag("__b").over(Window.orderBy("__b")), F.max("__b").over(Window.partitionBy())))
    heads = heads.select((-1 - F.col("top.a")).alias("__ha"), F.col("top.__h").alias("__hh"), "__of")
    place = Window.partitionBy("__b").orderBy(*order)
    own = rows.repartition("__b").withColumns(values).withColumn("__last", F.lead(F.lit(1)).over(place).isNull())
    own = own.withColumns({f"__in_{v}": F.lead(v).over(place) for v in values})
    first = rows.join(F.broadcast(heads) if tops.count() <= BROADCAST_ROWS else heads, (F.col("__at") == F.col("__ha")) & (F.col("__h") == F.col("__hh"))).groupBy("__of").agg(F.min(text_col).alias(text_col))
    first = first.withColumns(values).select(F.col("__of").alias("__fb"), *(F.col(v).alias(f"__out_{v}") for v in values))
    out = own.join(first, own["__b"] == first["__fb"], "left")
    return out.select(*docs.columns, *values, *(F.when(F.col("__last"), F.col(f"__out_{v}")).otherwise(F.col(f"__in_{v}")).alias(f"next_{v}") for v in values))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like it is to this and to the next document."""
    return edited_fingerprints(load(spark, sf_dir, "documents"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): sketches of texts and of texts edited by the next document's beginning.

    Null counts as empty text; a text without words has an empty sketch; rows that repeat an id stay apart, in the order of
    ``with_next``; the only row of a table is its own next one; an empty table gives no rows; other columns don't matter.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs, {"body": F.col("text"), "sketch": sketch(F.col("text"))})
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substring("next_body", F.lit(1), F.col("cut")))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"), containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
    )
