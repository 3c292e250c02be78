import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark):
    """A few hundred given documents and the odd rows every operator must stand."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").orderBy("doc_id").collect()]
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    copied = rows[5][1]
    odd = [
        None, "", "   \n\t ", "one", "one two three", "One TWO three", copied, copied, copied.upper(), copied + " tail",
        "head " + copied, long, long + " z", "é" * 3000, "x" * 5000, "a b c ßİΣ", "\x00\x01 \x1f", "line\n" * 40, "-- ## $$ %%",
    ]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(2000, copied), (2000, copied), (None, copied), (None, None), (2001, None)]


@pytest.fixture(scope="session")
def docs(spark, documents):
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(5)
    # columns that clash with the operators' own names
    return frame.select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in ("row", "runs", "n_words", "lang", "source", "spans", "bucket")], F.length("text").cast("long").alias("n_chars"))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
