"""From raw documents to token ids in five stages, each written as Parquet before the next one reads it.

Every stage but the last returns the columns of ``documents``. A row without doc_id passes all filters but the first.
Empty tables pass through. The stages' own modules define how they treat nulls, empty, long and repeated texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm import bpe, decontamination, language_id, line_duplicates, near_duplicates
from talentweave.llm.frames import table
from talentweave.session import shared_folder

MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that look like no learned language."""
    # all given columns but the text travel as one, so that none can clash with a prediction
    given = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("given")
    found = language_id.identified(docs.select("text", given), language_id.learned(docs.select("doc_id", "text", "lang")))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col("text") if c == "text" else F.col("given")[c].alias(c) for c in docs.columns])


def drop_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that are at most one edit away from an earlier line; a text left without a line goes."""
    left = line_duplicates.without_duplicate_lines(docs, drop_emptied=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates (five words, similarity 0.8 or more)."""
    gone = near_duplicates.near_duplicate_classes(docs, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ten words of a benchmark item."""
    gone = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), size=10).where("contaminated").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, and what they decode to."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_duplicate_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

# kernel ridge regression and merges by rank have no SQL form; tests/llm/test_pipeline.py holds run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
