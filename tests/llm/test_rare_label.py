from tabulon.llm import langid


def test_a_rare_label_is_in_the_model(spark):
    rows = [(f"the words of text {i}", "en") for i in range(400)] + [(f"sana {i} on talo", "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert langid.fit(docs, sample=5).languages == ["en", "fi"]
