"""The built-in text encoder reads and cuts the texts once."""

from pyspark.sql import functions as F

from talentweave.operators import lexical


def test_texts_are_cut_once(spark):
    met = spark.sparkContext.accumulator(0)

    def seen(text):
        met.add(1)
        return text

    texts = [(i, None if i == 3 else f"red w{i} blue w{i % 4}") for i in range(40)]
    rows = spark.createDataFrame(texts, "id long, text string").select("id", F.udf(seen, "string")("text").alias("text"))
    found = lexical.tfidf_encode(rows.repartition(3), "id", "text", 32).collect()
    assert len(found) == 40 and met.value == 40
    lengths = {r.id: sum(x * x for x in r.vector) for r in found}
    assert lengths[3] == 0 and all(abs(v - 1) < 1e-9 for k, v in lengths.items() if k != 3)
