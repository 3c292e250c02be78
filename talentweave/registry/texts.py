"""Queries over texts: tokens, lexical scorers, vocabulary, gate and dictionary matching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import fields, text
from ..operators import lexical, vocabulary
from ..session import cut_lineage, spread, written
from .matching import _ranked

MIN_DOCUMENTS = 5
GATE = vocabulary.SkillGate()


def _tokens(spark, d, name: str, key: str, distinct: bool) -> DataFrame:
    return lexical.tokens_table(b.table(spark, d, name), key, text.tokenize_text(F.col("text"), distinct=distinct))


def document_frequency(spark, d):
    return lexical.term_statistics(_tokens(spark, d, "documents", "doc_id", False))


def corpus_statistics(spark, d):
    stats = lexical.corpus_statistics(_tokens(spark, d, "documents", "doc_id", False))
    return stats.select("documents", F.round("average_length", 6).alias("average_length"))


def bm25_ranking_v1(spark, d):
    queries = _tokens(spark, d, "benchmark", "item_id", True)
    return _ranked(lexical.bm25_rankings(queries, _tokens(spark, d, "documents", "doc_id", True), 1000))


def bm25_ranking_v2(spark, d):
    queries = _tokens(spark, d, "benchmark", "item_id", False)
    return _ranked(lexical.bm25_rankings(queries, _tokens(spark, d, "documents", "doc_id", False), 1000))


def bm25_ranking_top_10(spark, d):
    queries = _tokens(spark, d, "benchmark", "item_id", False)
    return _ranked(lexical.bm25_rankings(queries, _tokens(spark, d, "documents", "doc_id", False), 10))


def bm25_pairs_met(spark, d):
    """Postings of each query's terms and how many of them a ranking of ten places reads."""
    queries = _tokens(spark, d, "benchmark", "item_id", False)
    return lexical.bm25_pairs_met(queries, _tokens(spark, d, "documents", "doc_id", False), 10)


def hashed_ranking(spark, d):
    queries = _tokens(spark, d, "benchmark", "item_id", True)
    return _ranked(lexical.hashed_rankings(queries, _tokens(spark, d, "documents", "doc_id", True), 1000))


def encoded_documents(spark, d):
    """Built-in text vectors, non-zero places only."""
    vectors = lexical.tfidf_encode(b.table(spark, d, "documents"), "doc_id", "text")
    rows = vectors.select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("dim", "value"))
    return rows.where(F.col("value") != 0).select("doc_id", "dim", F.round("value", 6).alias("value"))


def _letter_profile(texts: list[str]) -> np.ndarray:
    return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], dtype=np.float64)


def encoder_hook(spark, d):
    """A supplied encoder run on Arrow batches: characters, blanks and letters e, at unit length."""
    rows = lexical.encode_texts(b.table(spark, d, "documents"), "doc_id", "text", _letter_profile)
    values = [F.round(F.get("vector", F.lit(i)), 6).alias(n) for i, n in enumerate(("chars", "blanks", "letters_e"))]
    return rows.select(F.col("id").alias("doc_id"), *values)


def squeezed_texts(spark, d):
    clean = text.squeeze_whitespace(F.col("text"))
    return spread(b.table(spark, d, "documents"), "doc_id").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).alias("chars"))


def url_values(spark, d):
    """Multi-value, tag and skill splits of page addresses, as sorted joined lists."""
    url = F.col("url")

    def joined(values, name):
        return F.array_join(F.array_sort(values), "|").alias(name)

    return b.table(spark, d, "pages").select(
        "page_id",
        joined(text.split_multi_value(url), "multi_values"),
        joined(text.split_tags(url), "tags"),
        joined(text.extract_skill_tokens(url), "skills"),
    )


def field_parsers(spark, d):
    """Degree ranks and work years of label columns derived from the customers."""
    key = F.col("c_custkey")
    labels = ["初中", "普通高中", "中专/中技", "大专", "本科", "硕士", "mba/emba", "博士", "其他", "-"]
    degree = F.element_at(F.array(*[F.lit(x) for x in labels]), (key % 10 + 1).cast("int"))
    number = F.floor(F.abs("c_acctbal"))
    years = (
        F.when(key % 5 == 0, F.concat(F.lit(" "), number, F.lit("年")))
        .when(key % 5 == 1, F.concat(number % 10, F.lit("-10年")))
        .when(key % 5 == 2, (1950 + key % 100).cast("string"))
        .when(key % 5 == 3, F.lit("-1"))
        .otherwise(F.concat((number % 900 + 101).cast("string"), F.lit("以上")))
    )
    return b.table(spark, d, "customer").select(
        "c_custkey", fields.degree_rank(degree).alias("degree_rank"), F.round(fields.parse_years(years, 2024), 6).alias("years")
    )


def standard_names(spark, d):
    """Standard titles and task phrases built from part names."""
    title = F.concat(F.lit("6-31-01-02-"), "p_name", F.lit("（试行）2019年版"))
    task = F.concat("p_name", F.lit("；"), "p_type", F.lit("。"), "p_brand")
    return b.table(spark, d, "part").select(
        "p_partkey", text.standard_name(title).alias("standard"), F.array_join(text.task_phrases(task), "|").alias("phrases")
    )


# Vocabulary -----------------------------------------------------------------------------------


def _document_tags(spark, d) -> DataFrame:
    tokens = _tokens(spark, d, "documents", "doc_id", True)
    return tokens.select(F.col("id").alias("user_id"), F.posexplode_outer("tokens").alias("pos", "tag")).where("tag is not null")


def _reference(spark, d) -> DataFrame:
    """Conversation roles stand in for occupations, benchmark words for task terms."""
    roles = b.table(spark, d, "conversations").select(F.lit("occupation").alias("kind"), F.lower("role").alias("term"))
    words = _tokens(spark, d, "benchmark", "item_id", True).select(F.lit("task").alias("kind"), F.explode_outer("tokens").alias("term")).where("term is not null")
    return roles.union(words).distinct()


def gate_decisions(spark, d):
    tokens = _document_tags(spark, d).select(F.col("tag").alias("token")).distinct()
    return vocabulary.gate_decisions(tokens, GATE, _reference(spark, d))


def gate_summary(spark, d):
    return vocabulary.gate_summary(GATE, _reference(spark, d)).select("item", F.col("count").alias("n"))


def skill_vocabulary(spark, d):
    return vocabulary.build_vocabulary(_document_tags(spark, d), MIN_DOCUMENTS, GATE, _reference(spark, d))


def _matches(spark, d) -> DataFrame:
    vocab = cut_lineage(vocabulary.weighted_vocabulary(_document_tags(spark, d), MIN_DOCUMENTS, GATE, _reference(spark, d)))
    fields_ = b.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(1.0).alias("field_weight"))
    return vocabulary.match_dictionary(fields_, vocab)


def dictionary_matches(spark, d):
    """Vocabulary of the documents found in the benchmark texts."""
    return _matches(spark, d).select("id", "skill_id", F.round("score", 6).alias("score"))


def top_text_skills(spark, d):
    best = vocabulary.top_skills(_matches(spark, d), 20)
    return best.select("id", F.posexplode(F.arrays_zip("skill_ids", "skill_weights")).alias("place", "_e")).select(
        "id", "place", F.col("_e.skill_ids").alias("skill_id"), F.col("_e.skill_weights").alias("weight")
    )


def tag_ids(spark, d):
    tags = written(_document_tags(spark, d), "tags")
    vocab = vocabulary.weighted_vocabulary(tags, MIN_DOCUMENTS, GATE, _reference(spark, d))
    return vocabulary.ids_of_tags(tags, vocab, None).select("user_id", F.explode("skill_ids").alias("skill_id"))


QUERIES = {
    f.__name__: f
    for f in (
        document_frequency, corpus_statistics, bm25_ranking_v1, bm25_ranking_v2, bm25_ranking_top_10, bm25_pairs_met, hashed_ranking, encoded_documents, encoder_hook,
        squeezed_texts, url_values, field_parsers, standard_names, gate_decisions, gate_summary, skill_vocabulary,
        dictionary_matches, top_text_skills, tag_ids,
    )
}
