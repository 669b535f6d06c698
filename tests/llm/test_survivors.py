import random

from tabulon.llm import simhash


def test_null_and_repeated_ids_lose_no_text(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["a", "b", "c", "d", "e"]) + str(r.randint(0, 999)) for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, d), (8, d)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.text) for x in got) == sorted([(-1, a), (-1, b), (7, c), (7, d)])
