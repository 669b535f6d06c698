"""Language identification by Bayesian evidence fusion.

Text likelihoods come from a naive Bayes model over hashed character 1- to 3-grams. To its log-likelihood are added the log
odds of what a page declares about itself (markup language, the language part of its address) and the log prior of where it
comes from, smoothed over a hierarchy from all pages over address suffix and domain to the host. Both are estimated by
grouped aggregation of the text posteriors of all rows; a row's own contribution is taken out of every count it is judged by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import load, lookup, shielded, stored

#: Labelled rows that the text model is fitted on, at most: those of the smallest hashes. Everything else covers all rows.
SAMPLE = 2000
#: A language with fewer rows than so many among these gets those of its smallest hashes up to this number besides.
PER_LABEL = 100
#: Slots of the hashed n-gram tables: the model is languages x SLOTS floats, whatever the data.
SLOTS = 1 << 15
#: n-grams are not independent: a text's evidence grows to that of so many, whatever its length.
EVIDENCE = 300
#: Pseudo-counts with which a level of the hierarchy, or a declared value, leans on the level above.
LEAN = 8.0
#: Posterior below which a row is rejected.
CONFIDENCE = 0.5
#: A text is of no known language if its mean log-likelihood an n-gram lies below that of all but so few held-out labelled
#: texts, less a margin and a term for what a short text's mean varies by (over the root of its n-grams).
OUTLIERS, MARGIN, SHORT = 0.001, 0.5, 6.0
AT_ONCE = 300_000
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # [slot, language], log probabilities
    floor: float = float("-inf")  # of the mean log-likelihood an n-gram


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of lower-cased texts with a letter in them, and which text each is of."""
    lens = np.array([len(t) + 2 for t in texts])
    x = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), lens)
    letter = _is_letter(x)
    x = np.where(letter, x, np.uint32(32))
    out, own = [], []
    h = np.zeros(len(x), np.uint32)
    for n in range(3):
        m = len(x) - n
        h = h[:m] * np.uint32(31) + x[n:] * _SALT[n]
        any_letter = letter[:m].copy()
        for i in range(1, n + 1):
            any_letter |= letter[i : m + i]
        keep = any_letter & (owner[:m] == owner[n:])
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17))[keep] % SLOTS)
        own.append(owner[:m][keep])
    return np.concatenate(out), np.concatenate(own)


_LETTER = np.zeros(0x110000, bool)


def _is_letter(x: np.ndarray) -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return _LETTER[x]


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> TextModel:
    """A model of the labels of at most ``sample`` rows; null labels and texts teach nothing."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l"))
    rows = rows.withColumn("h", F.xxhash64("t", "l"))
    # hashes first: texts come to the driver only for those that are taken, and once for rows that repeat
    top = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    got = rows.where(F.col("h") <= top).dropDuplicates(["h"]).orderBy("h").collect() if top is not None else []
    seen = {r.l for r in got}
    seen = [x for x in seen if sum(r.l == x for r in got) >= PER_LABEL]
    few = rows.where(~F.col("l").isin(seen)) if seen else rows
    order = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    more = few.select("h", "l").distinct().withColumn("k", order).where(F.col("k") <= PER_LABEL).select("h") if top is not None else None
    more = {r.h for r in more.collect()} - {r.h for r in got} if more is not None else set()
    if more:
        got = sorted(got + few.where(F.col("h").isin(list(more))).dropDuplicates(["h"]).collect(), key=lambda r: r.h)
    languages = sorted({r.l for r in got})
    counts = [_counted(got[half::2], languages) for half in (0, 1)]
    model = _model(languages, counts[0] + counts[1])
    held = []
    for half in (0, 1):  # each half under a model of the other
        other = _model(languages, counts[1 - half])
        for at in range(half, len(got), 400):
            ll, n = score([r.t for r in got[at : at + 400 : 2]], other)
            held += (ll.max(1) * (1 / EVIDENCE + 1 / np.maximum(n, 1)))[n > 0].tolist()
    if held:
        model.floor = float(np.quantile(held, OUTLIERS)) - MARGIN
    return model


def _counted(rows: list, languages: list[str]) -> np.ndarray:
    """Counts [slot, language] of n-grams of rows (t, l)."""
    table = np.zeros((SLOTS, max(1, len(languages))))
    for i, language in enumerate(languages):
        for at in range(0, len(rows), 200):
            texts = [r.t.lower() for r in rows[at : at + 200] if r.l == language]
            if texts:
                table[:, i] += np.bincount(grams(texts)[0], minlength=SLOTS)
    return table


def _model(languages: list[str], counts: np.ndarray) -> TextModel:
    table = counts + 0.05
    return TextModel(languages, np.log(table / table.sum(0)).astype(np.float32))


def score(texts: list[str], model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihoods [text, language] and the number of n-grams of each text."""
    slots, owner = grams([t.lower() for t in texts])
    n = np.bincount(owner, minlength=len(texts))
    ll = np.stack([np.bincount(owner, model.table[slots, i], len(texts)) for i in range(model.table.shape[1])], 1)
    return ll * (EVIDENCE / (EVIDENCE + n))[:, None], n


def text_evidence(rows: DataFrame, text_col: str, model: TextModel, keep: list[str]) -> DataFrame:
    """``keep`` plus n_grams and ll array<double>: log-likelihoods by language."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded: languages x SLOTS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, lls, held, size = [], [], [], 0
            for t in [*b.column(0), None]:
                if t is not None:
                    held.append(t.as_py() or "")
                    size += len(held[-1])
                if held and (t is None or size > AT_ONCE):
                    ll, n = score(held, shared.value)
                    counts.append(n)
                    lls += list(ll)
                    held, size = [], 0
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(counts, pa.int64()), pa.array(lls, pa.list_(pa.float64()))], names=[*keep, "n_grams", "ll"])

    return rows.select(F.col(text_col).cast("string").alias("langid_text"), *keep).mapInArrow(run, ", ".join([*(f"{k} {fields[k]}" for k in keep), "n_grams long, ll array<double>"]))


def _softmax(scores: Column) -> Column:
    shifted = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(F.array(shifted), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def fuse(evidence: DataFrame, model: TextModel, levels: list[str], declared: list[str], lean: float = LEAN, confidence: float = CONFIDENCE) -> DataFrame:
    """``evidence`` plus language, posterior and rejected.

    ``levels``: columns from the widest to the narrowest place (suffix, domain, host); ``declared``: columns of what a row
    says of itself. A null place is a place of its own; a null declaration says nothing. A row without letters, with a
    posterior below ``confidence``, or with n-grams as unlikely in every language as no labelled text's, is rejected and has
    no language. Of equal posteriors the language first by name counts; rows that repeat count each; an empty table gives
    no rows.
    """
    k = range(max(1, len(model.languages)))
    inner, name = shielded(evidence)
    levels, declared = [name[c] for c in levels], [name[c] for c in declared]
    rows = inner.withColumns({"ll": F.col(name["ll"]), "n_grams": F.col(name["n_grams"])})
    p = _softmax(F.col("ll"))
    rows = rows.withColumn("p", F.when(F.col("n_grams") > 0, p).otherwise(F.array(*[F.lit(0.0)] * len(k))))
    rows = rows.withColumns({f"place_{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for i, c in enumerate(levels)})
    sums = lambda of: F.array(*(F.sum(of(i)) for i in k))
    places = [f"place_{i}" for i in range(len(levels))]
    counts = stored(rows.groupBy(*places).agg(sums(lambda i: F.col("p")[i]).alias("n"), F.count(F.lit(1)).alias("times")), "places")
    total = counts.agg(*(F.coalesce(F.sum(F.col("n")[i]), F.lit(0.0)) for i in k), F.coalesce(F.sum("times"), F.lit(0))).first()
    everywhere, n_rows = [float(x) for x in total[:-1]], total[-1]

    # a row has no say in its own priors: at every level its posterior is taken out of the counts
    def without(counts: Column) -> list[Column]:
        return [F.greatest(counts[i] - F.col("p")[i], F.lit(0.0)) for i in k]

    def smoothed(counts: list[Column], above: Column) -> Column:
        n = sum(counts[1:], counts[0])
        return F.array(*((counts[i] + lean * above[i]) / (n + lean) for i in k))

    spread = F.concat_ws("|", F.array_join("ll", ","), *places)
    out, seen = rows, ["n"]
    if levels:
        wide = counts
        for depth in range(1, len(levels)):  # of all levels above the narrowest, carried by the narrowest one's rows
            at = counts.groupBy(*places[:depth]).agg(sums(lambda i: F.col("n")[i]).alias(f"n_{depth}"), F.count(F.lit(1)).alias("hosts"))
            wide = lookup(wide, at, places[:depth], n_rows, "hosts", F.col(places[-1]))
        seen = [*(f"n_{depth}" for depth in range(1, len(levels))), "n"]
        out = lookup(rows, wide, places, n_rows, "times", spread)
    left = [F.greatest(F.lit(everywhere[i]) - F.col("p")[i], F.lit(0.0)) + 1.0 for i in k]
    out = out.withColumn("place_prior", F.array(*(x / sum(left[1:], left[0]) for x in left)))
    for j, c in enumerate(seen if levels else []):  # level by level, each smoothed towards the one above
        out = out.withColumn(f"place_{j}_prior", smoothed(without(F.col(c)), F.col("place_prior" if j == 0 else f"place_{j - 1}_prior")))
    place = f"place_{len(seen) - 1}_prior" if levels else "place_prior"
    score = [F.col("ll")[i] + F.log(F.col(place)[i]) for i in k]
    for d in declared:
        said = rows.where(F.col(d).isNotNull()).groupBy(F.col(d).alias(f"said_{d}")).agg(sums(lambda i: F.col("p")[i]).alias(f"by_{d}"), F.count(F.lit(1)).alias("times"))
        out = lookup(out.withColumn(f"said_{d}", F.col(d)), said, [f"said_{d}"], n_rows, "times", spread)
        by = smoothed(without(F.col(f"by_{d}")), F.col("place_prior"))
        score = [s + F.coalesce(F.log(by[i] / F.col("place_prior")[i]), F.lit(0.0)) for i, s in enumerate(score)]
    out = out.withColumn("posterior_all", _softmax(F.array(*score)))
    best = F.array_position("posterior_all", F.array_max("posterior_all")).cast("int")
    names = F.array(*[F.lit(x) for x in model.languages or [None]]).cast("array<string>")
    typical = F.array_max("ll") * (1 / EVIDENCE + 1 / F.greatest(F.col("n_grams"), F.lit(1)))
    foreign = typical < F.lit(model.floor) - SHORT / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1)))
    out = out.withColumn("posterior", F.array_max("posterior_all")).withColumn("rejected", (F.col("n_grams") == 0) | (F.col("posterior") < confidence) | foreign | F.lit(not model.languages))
    return out.withColumn("language", F.when(~F.col("rejected"), F.element_at(names, best))).select(*inner.columns, "language", "posterior", "rejected").toDF(*evidence.columns, "language", "posterior", "rejected")


def page_parts(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, text, markup, address, suffix, domain, host) of web pages: all lower-cased, null where a page has none."""
    html, url = F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*+>", " ")
    bare = F.regexp_replace(bare, r"&[#A-Za-z0-9]{1,10};", " ")
    none = lambda c: F.when(c != "", c)
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return pages.select(
        F.col(id_col).alias("id"), bare.alias("text"), none(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))).alias("markup"),
        none(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?=[/?#-]|$)", 1)).alias("address"),
        none(F.substring_index(host, ".", -1)).alias("suffix"), none(F.substring_index(host, ".", -2)).alias("domain"), none(host).alias("host"),
    )


def page_languages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, language, posterior, rejected, markup, address, host) per row of ``pages``; null url or html are empty.

    Html is read whole, however long; rows that repeat an id or a page stay apart; an empty table gives no rows; other
    columns, whatever their names, are not looked at.
    """
    parts = page_parts(pages, id_col, url_col, html_col)
    evidence = stored(text_evidence(parts, "text", model, ["id", "markup", "address", "suffix", "domain", "host"]), "evidence")
    out = fuse(evidence, model, ["suffix", "domain", "host"], ["markup", "address"])
    return out.select(F.col("id").alias(id_col), "language", F.round("posterior", 6).alias("posterior"), "rejected", "markup", "address", "host")


def document_languages(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", declared_col: str | None = "lang") -> DataFrame:
    """(id, h, language, posterior, rejected) per row of ``docs``; h: xxhash64 of the text. The source stands for the host."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("host"), (F.lower(F.col(declared_col)) if declared_col else F.lit(None)).cast("string").alias("said"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    evidence = stored(text_evidence(rows, "text", model, ["id", "h", "host", "said"]), "evidence")
    return fuse(evidence, model, ["host"], ["said"] if declared_col else []).select("id", "h", "language", "posterior", "rejected")


def identified(docs: DataFrame, model: TextModel) -> DataFrame:
    """``docs`` without the rows that are rejected; columns as they were, rows that repeat an id and a text share their fate."""
    gone = stored(document_languages(docs, model).where("rejected").select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).distinct(), "rejected")
    here = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (here == gone["gone_h"]), "left_anti")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; the text model is fitted on labelled documents."""
    return page_languages(load(spark, sf_dir, "pages"), fit(load(spark, sf_dir, "documents")))
