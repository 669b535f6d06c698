import hashlib

import numpy as np

import corpus_pipeline as P
from tabulon.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    kept, all_docs = docs, docs.collect()
    seen = {}
    for name, stage in P.STAGES[:-1]:
        kept = P.stored(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        seen[name] = kept.collect()
    assert {r.doc_id for r in seen["language_id"]} == {r.doc_id for r in all_docs if any(c.isalpha() for c in r.text or "")}
    fps = {r.doc_id: int(simhash.majority([simhash.shingle_hashes(r.text, 5)])[0]) for r in seen["language_id"]}
    left = [fps[r.doc_id] for r in seen["near_dedup"]]
    gone = [f for i, f in fps.items() if i not in {r.doc_id for r in seen["near_dedup"]}]
    x = np.array(left, np.uint64)
    assert (np.bitwise_count(x[:, None] ^ x[None, :]) <= 4).sum() == len(x)
    assert len(left) + len(gone) == len(fps)
    assert {r.doc_id for r in seen["pii"]} == {r.doc_id for r in seen["near_dedup"]} and all(r.n_chars == len(r.text) for r in seen["pii"])
    final = P.run(spark, SF).collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in seen["mixing"])
    texts = {r.doc_id: r.text for r in seen["mixing"]}
    for r in final:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (None, "the cat and the dog ran over the hill", "en", None, 1), (9, "the cat and the dog ran over a hill " * 3000, "en", "s", 1)], docs.schema)
    rows = docs.union(docs.limit(5)).union(odd).selectExpr("*", "1 AS h", "2 AS mix_size", "3 AS pii_id", "4 AS keep_id", "'x' AS t")
    for some in (rows, rows.limit(0)):
        for name, stage in P.STAGES:
            some = P.stored(stage(spark, some, SF), name)
            assert name == "bpe" or some.columns == rows.columns
    assert some.count() == 0
