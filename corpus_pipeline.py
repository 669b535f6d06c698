"""A training corpus from ``documents``: language ID, SimHash near-dedup, PII, mixing, BPE; each stage written and read again.

All stages take nulls in any column, texts of any length, repeated rows, empty tables and further columns of any name: a null text
counts as empty, an empty table stays empty, and columns that a stage doesn't work on pass through (but for the last one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import bpe, langid, mixing, pii, simhash
from tabulon.llm._base import load, prepare, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the text model is fitted on a bounded sample of those labelled. Rows that repeat share their fate; without labelled rows none stays."""
    prepare(spark)
    return langid.identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles: SimHashes within 4 of 64 bits, or a Jaccard of 0.8 or more)."""
    prepare(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def pii_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that reveal it replaced; n_chars follows the text."""
    from pyspark.sql import functions as F

    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests that show the round trip."""
    prepare(spark)
    return bpe.encoded(docs, keep=("lang", "source"), keep_ids=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii_removal), ("mixing", mix), ("bpe", tokens)]

#: Fingerprints, hashed models and tokenizers aren't SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
