from tabulon.llm import licenses


def test_full_texts_are_known(spark):
    full = {i: t for i, t in licenses.KNOWN if len(t) > 5000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(full)
    docs = spark.createDataFrame(sorted(full.items()), "doc_id string, text string")
    assert {x.doc_id: x.license_id for x in licenses.license_scan(docs).collect()} == {i: i for i in full}
