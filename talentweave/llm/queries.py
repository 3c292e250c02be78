"""The registered queries of the document operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, decontamination, edit_counts, language_id, line_duplicates, line_labelling, near_duplicates, quality_classifier, sharding, substring_duplicates, token_alignment, token_files
from .frames import held_out, table


def op1_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encoded(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, folder, "documents"), percent=85, size=5)


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every text before and after three edits each: a stretch replaced, a word put in, a line appended."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = edit_counts.trees(docs, path, pattern)
    size = F.length("text").cast("long")
    edit = lambda at, removed, text: F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), text.alias("inserted"))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    edits = F.array(edit(F.floor(size / 3), 7, number), edit(F.floor(2 * size / 3), 0, F.lit(" inserted ")), edit(size + 100, 0, F.concat(F.lit("\n"), number)))
    found = edit_counts.edited(kept.withColumn("edits", edits), path, pattern)
    return found.select("doc_id", F.col("n_tokens_given").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_encoded", F.length("text").cast("long").alias("n_chars_edited"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_duplicates.without_repeats(table(spark, folder, "documents"), size=50).drop("kept_text")


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_duplicates.line_report(table(spark, folder, "documents"))
    return found.withColumn("removed_lines", F.array_join(F.col("removed_lines").cast("array<string>"), ","))


def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = quality_classifier.learned(docs, table(spark, folder, "labels"))
    found = quality_classifier.scored(docs, net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identified(docs.select("doc_id", "text"), language_id.learned(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.document_shards(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return line_labelling.judged(docs, line_labelling.learned(docs, table(spark, folder, "labels")))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    return conversation_repair.repair_report(conversation_repair.damaged(given), given)


def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_file_report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_encode_decode,
        op2_benchmark_decontamination,
        op3_minhash_near_dedup,
        op4_token_counts,
        op5_substring_dedup,
        op6_line_dedup,
        op7_quality_classifier,
        op8_language_id,
        op9_sharding,
        op10_quality_rules,
        op11_conversation_repair,
        op12_token_files,
        op13_token_alignment,
    )
}
