"""Lexical scorers: BM25 in two variants, hashed TF-IDF vectors, and the text encoding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize_text
from ..session import broadcast_if_small, cut_lineage, spread, written
from .pruning import pruned_candidates
from .topk import blocked_topk, bucket_product, sparse_product, term_key

# ---- fixed values ---------------------------------------------------------------------------
K1, B = 1.5, 0.75
HASH_DIM = 512
# ---------------------------------------------------------------------------------------------

# A document block carries whole term vectors, so it holds fewer rows than a profile block.
TEXT_BLOCK_ROWS = 4096
# Vectors of more buckets than these meet as sorted lists, not as rows of a matrix.
MATRIX_DIM = 4096


def tokens_table(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, tokens) of a text table."""
    return spread(df, id_col).select(F.col(id_col).alias("id"), tokens.alias("tokens"))


def term_counts(tokens: DataFrame) -> DataFrame:
    """(id, term, tf)."""
    # the outer generator: a plain one makes the optimizer test the array first, which runs the tokenizer once more
    exploded = tokens.select("id", F.explode_outer("tokens").alias("term")).where("term is not null")
    return exploded.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_statistics(tokens: DataFrame) -> DataFrame:
    """One row: number of documents and their average length (an empty one counts as length 1)."""
    return tokens.agg(
        F.count(F.lit(1)).alias("documents"), F.avg(F.greatest(F.lit(1), F.size("tokens"))).alias("average_length")
    )


def term_statistics(tokens: DataFrame) -> DataFrame:
    """(term, df, tf): documents with the term and its occurrences; only sums per term are shuffled."""
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("t")))
    each = F.transform("tokens", lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("t")))
    rows = tokens.select(F.inline_outer(F.concat(once, each))).where("term is not null")
    return rows.groupBy("term").agg(F.sum("d").alias("df"), F.sum("t").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_idf(documents: Column, df: Column) -> Column:
    return F.log(1.0 + (documents - df + 0.5) / (df + 0.5))


def _term_frequencies(tokens: DataFrame, wanted_terms: DataFrame) -> DataFrame:
    """(id, length, term, tf) of the terms in ``wanted_terms``; a document is counted inside one task."""
    rows = tokens.repartition("id").select("id", F.greatest(F.lit(1), F.size("tokens")).alias("length"), F.explode_outer("tokens").alias("term"))
    rows = rows.where("term is not null").join(broadcast_if_small(wanted_terms.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def _saturated(tf: Column, length: Column, average_length: Column, k1: float, b: float) -> Column:
    """What a document's term frequency contributes to a BM25 weight, besides the term's idf."""
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / average_length))


def bm25_postings(tokens: DataFrame, wanted_terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(term, job_id, block, low, high): BM25 weights of the documents' terms that occur in ``wanted_terms``.

    All other terms add nothing to any score; document counts and lengths still cover the whole corpus. ``tokens`` is read
    twice: pass a written table. Blocks hold documents of like length, in which a term's weights differ little.
    """
    counts = written(_term_frequencies(tokens, wanted_terms), "counts")
    stats = corpus_statistics(tokens).select(F.struct("documents", "average_length")).scalar()
    frequency = document_frequency(counts).select("term", bm25_idf(stats["documents"], F.col("df")).alias("idf"))
    weight = F.col("idf") * _saturated(F.col("tf"), F.col("length"), stats["average_length"], k1, b)
    block = F.floor(4 * F.log2("length")).cast("int")
    weighed = counts.join(broadcast_if_small(cut_lineage(frequency)), "term")
    return weighed.select("term", F.col("id").alias("job_id"), block.alias("block"), weight.alias("low"), weight.alias("high"))


def bm25_rankings(
    queries: DataFrame, documents: DataFrame, topn: int, exclude: DataFrame | None = None, k1: float = K1,
    b: float = B,
) -> DataFrame:
    """(user_id, job_id, score, rank) from two token tables (id, tokens): the ``topn`` best with a common term.

    A repeated query term counts as often as it occurs; pass distinct tokens for the variant in which neither side counts
    repeats. Texts are cut into tokens once. Documents keep only the terms that are asked for, in blocks that meet blocks of
    queries (``topk``): no row per query and document is made, and at most ``topn`` places per query leave a block. Scores
    are compared to 9 digits, so that equal texts tie and go by id.
    """
    asked = _asked(queries)
    tokens = written(documents.select("id", "tokens"), "tokens")
    entry = F.struct(term_key(F.col("term")).alias("key"), "length", "tf")
    listed = written(_term_frequencies(tokens, asked).groupBy("id").agg(F.collect_list(entry).alias("_e")), "postings")
    stats = corpus_statistics(tokens).first()
    average = F.lit(stats["average_length"]).cast("double")
    items = listed.select(
        "id", F.col("_e.key").alias("keys"), F.transform("_e", lambda e: _saturated(e["tf"], e["length"], average, k1, b)).alias("weights")
    )
    # one entry of a list is one document with the term
    frequency = listed.select(F.explode("_e.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    idf = frequency.select("key", bm25_idf(F.lit(stats["documents"]), F.col("df")).alias("idf"))
    found = asked.select(F.col("user_id").alias("id"), term_key(F.col("term")).alias("key"), "times").join(idf, "key")
    entry = F.struct("key", (F.col("times") * F.col("idf")).alias("weight"))
    asks = cut_lineage(found.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("_e")))
    asks = asks.select("id", F.col("_e.key").alias("keys"), F.col("_e.weight").alias("weights"))
    return blocked_topk(
        asks, items, topn, sparse_product, exclude, item_block_rows=TEXT_BLOCK_ROWS, min_score=0.0, sizes=(asks.count(), listed.count())
    )


def _asked(queries: DataFrame) -> DataFrame:
    """(user_id, term, times), written because it is read several times."""
    return cut_lineage(term_counts(queries).select(F.col("id").alias("user_id"), "term", F.col("tf").cast("double").alias("times")))


def bm25_pairs_met(queries: DataFrame, documents: DataFrame, topn: int, k1: float = K1, b: float = B) -> DataFrame:
    """(user_id, pairs, read, candidates, looked_up): postings of a query's terms, those its ranking reads in full, the
    documents it completes, and the terms it looks up for them."""
    asked = _asked(queries)
    postings = written(bm25_postings(written(documents.select("id", "tokens"), "tokens"), asked, k1, b), "postings")
    found = pruned_candidates(asked, postings, topn)
    read, left = (F.when(c, F.col("entries")).otherwise(0) for c in (F.col("step") < 3, F.col("step") == 3))
    lists = found.lists.groupBy("user_id").agg(F.sum("entries").alias("pairs"), F.sum(read).alias("read"), F.count(F.when(left > 0, 1)).alias("_left"))
    completed = found.candidates.groupBy("user_id").agg(F.count(F.lit(1)).alias("candidates"))
    both = lists.join(completed, "user_id", "left").fillna(0, ["candidates"])
    return both.select("user_id", "pairs", "read", "candidates", (F.col("candidates") * F.col("_left")).alias("looked_up"))


def job_document(title: Column, text: Column) -> Column:
    """Second-generation document: the title twice, then the text (which starts with the title)."""
    return F.concat(title, F.lit(" "), title, F.lit(" "), text)


def bm25_rankings_v1(users: DataFrame, jobs: DataFrame, topn: int, exclude: DataFrame | None = None,
                     query_tokens: int | None = None, document_tokens: int | None = None) -> DataFrame:
    """First-generation BM25: distinct tokens on both sides, so every term frequency is 1."""
    queries = tokens_table(users, "user_id", tokenize_text(F.col("text"), query_tokens))
    documents = tokens_table(jobs, "job_id", tokenize_text(F.col("text"), document_tokens))
    return bm25_rankings(queries, documents, topn, exclude)


def bm25_rankings_v2(users: DataFrame, jobs: DataFrame, topn: int, exclude: DataFrame | None = None) -> DataFrame:
    """Second-generation BM25: term counts on both sides and a boosted title."""
    queries = tokens_table(users, "user_id", tokenize_text(F.col("text"), distinct=False))
    text = job_document(F.col("title"), F.col("text"))
    documents = tokens_table(jobs, "job_id", tokenize_text(text, distinct=False))
    return bm25_rankings(queries, documents, topn, exclude)


# Hashed TF-IDF --------------------------------------------------------------------------------


def hash_bucket(term: Column, dim: int = HASH_DIM) -> tuple[Column, Column]:
    """Bucket and sign of a term: both come from the first 15 hex digits of its MD5 sum."""
    value = F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long")
    return value % dim, F.when(value % 2 == 0, 1.0).otherwise(-1.0)


def hashed_vectors(tokens: DataFrame, idf: DataFrame, dim: int = HASH_DIM) -> DataFrame:
    """(id, keys, weights): signed TF-IDF sums per bucket, L2-normalized; unseen terms weigh 1.

    ``idf`` (term, bucket, value) holds the signed weight of each known term, so that only unseen ones are hashed here.
    """
    bucket, sign = hash_bucket(F.col("term"), dim)
    # a document stays inside one task from its tokens to its vector, unless the terms are too many to be sent to all
    rows = tokens.repartition("id").select("id", F.posexplode_outer("tokens").alias("_pos", "term"))
    # a text's first token stands for its row; a null token has no bucket
    row = F.when(F.coalesce("_pos", F.lit(0)) == 0, 1).otherwise(0).alias("row")
    entries = rows.join(idf, "term", "left").select(
        "id", F.coalesce("bucket", bucket).alias("key"), F.coalesce("value", sign).alias("value"), row
    ).groupBy("id", "key").agg(F.sum("value").alias("value"), F.sum("row").alias("rows"))
    kept = F.when(F.col("key").isNotNull(), F.struct("key", "value"))
    vectors = entries.groupBy("id").agg(F.collect_list(kept).alias("_e"), F.sum("rows").alias("rows"))
    norm = F.sqrt(F.aggregate("_e.value", F.lit(0.0), lambda s, v: s + v * v))
    vectors = vectors.withColumn("_norm", F.when(F.col("id").isNotNull(), norm)).withColumn("_e", F.when(F.col("_norm") > 0, F.col("_e")))
    # a repeated id has as many rows as texts
    return vectors.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(
        "id",
        F.coalesce("_e.key", F.array().cast("array<bigint>")).alias("keys"),
        F.coalesce(F.transform("_e.value", lambda v: v / F.col("_norm")), F.array().cast("array<double>")).alias("weights"),
    )


def hashed_rankings(queries: DataFrame, documents: DataFrame, topn: int, exclude: DataFrame | None = None,
                    dim: int = HASH_DIM, item_block_rows: int = TEXT_BLOCK_ROWS) -> DataFrame:
    """Cosine of hashed TF-IDF vectors, from two token tables."""
    queries, documents = cut_lineage(queries), written(documents.select("id", "tokens"), "tokens")
    sizes = queries.count(), documents.count()
    frequency = document_frequency(documents.select("id", F.explode(F.array_distinct("tokens")).alias("term")).where("term is not null"))
    bucket, sign = hash_bucket(F.col("term"), dim)
    weight = F.log(1.0 + F.lit(sizes[1]) / (1.0 + F.col("df")))
    idf = broadcast_if_small(cut_lineage(frequency.select("term", bucket.alias("bucket"), (sign * weight).alias("value"))))
    return blocked_topk(
        hashed_vectors(queries, idf, dim),
        hashed_vectors(documents, idf, dim),
        topn,
        bucket_product(dim) if dim <= MATRIX_DIM else sparse_product,
        exclude,
        item_block_rows=item_block_rows,
        sizes=sizes,
    )


# Text encoding --------------------------------------------------------------------------------


def encode_texts(
    df: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], np.ndarray], prefix: str = ""
) -> DataFrame:
    """(id, vector) from any batch encoder, called on Arrow batches and L2-normalized; blanks become one space."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [prefix + (t or " ") for t in batch["_text"]]
            vectors = np.asarray(encoder(texts), dtype=np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.DataFrame({"id": batch["id"], "vector": list(vectors / np.where(norms > 0, norms, 1.0))})

    source = spread(df, id_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInPandas(encode, f"id {id_type}, vector array<double>")


def tfidf_encode(df: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """(id, vector) from the built-in encoder: hashed term counts, inverse document frequency, unit length."""
    tokens = spread(df, id_col).select(
        F.col(id_col).alias("id"), tokenize_text(F.col(text_col), distinct=False).alias("tokens")
    )
    # at most ``dim`` counts a text, written because the fit reads them too: texts are cut into tokens once
    counted = cut_lineage(HashingTF(numFeatures=dim, inputCol="tokens", outputCol="tf").transform(tokens).select("id", "tf"))
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="tfidf", outputCol="unit").transform(weighted)
    return unit.select("id", vector_to_array("unit").alias("vector"))
