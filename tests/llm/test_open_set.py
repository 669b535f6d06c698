import base64
import random

from tabulon.llm import langid

SF = "/root/testdata/sf0.01"


def test_unlabelled_languages_and_gibberish_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    r = random.Random(1)
    odd = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki",
        "".join(r.choice("bcdfghjklmnpqrstvwxz    ") for _ in range(200)),
        base64.b64encode(r.randbytes(150)).decode(),
    ]
    rows = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(odd)], "doc_id long, text string, source string, lang string")
    assert all(x.rejected and x.language is None for x in langid.document_languages(rows, model).collect())
    held = langid.document_languages(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(x.rejected for x in held) <= 0.01 * len(held)
