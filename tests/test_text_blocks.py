"""Lexical rankings at size: documents in blocks, no row per query and document, few shuffles."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import lexical, pruning
from talentweave.session import cut_lineage

DOCS = {1: ["a", "b", "b", "x"], 2: ["x", "y"], 3: ["b"], 4: [], 5: ["c", None, "a", "c"], 6: ["a", "b", "b", "x"]}
ASKS = {10: ["a", "b", "b"], 11: ["c", "unseen"], 12: ["unseen"]}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, tokens array<string>")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_documents_keep_the_terms_asked_for(spark, monkeypatch):
    """F8, F11, F15: what meets the queries is one row per document with an asked term."""
    met = []
    blocked = lexical.blocked_topk

    def recorded(queries, items, *args, **kwargs):
        met.append({r["id"]: len(r["keys"]) for r in items.collect()})
        return blocked(queries, items, *args, **kwargs)

    monkeypatch.setattr(lexical, "blocked_topk", recorded)
    got = {(r["user_id"], r["job_id"]): (r["rank"], r["score"]) for r in lexical.bm25_rankings(frame(spark, ASKS), frame(spark, DOCS), 2).collect()}
    assert met == [{1: 2, 3: 1, 5: 2, 6: 2}]
    lengths = {k: max(1, len(v)) for k, v in DOCS.items()}
    average = sum(lengths.values()) / len(lengths)
    df = Counter(t for v in DOCS.values() for t in set(v))

    def score(q, d):
        tf = Counter(DOCS[d])
        idf = {t: math.log(1 + (len(DOCS) - df[t] + 0.5) / (df[t] + 0.5)) for t in ASKS[q]}
        return sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * lengths[d] / average)) for t in ASKS[q])

    assert set(got) == {(10, 1), (10, 6), (11, 5)}
    assert got[10, 1][0] == 1 and got[10, 6][0] == 2
    for (q, d), (_, value) in got.items():
        assert value == pytest.approx(score(q, d), abs=1e-8)


def test_bm25_ranks_repeated_ids_and_hides_pairs(spark):
    docs = spark.createDataFrame([(1, ["a"]), (1, ["a", "z", "z"]), (2, ["a"]), (3, ["q"])], "id long, tokens array<string>")
    hidden = spark.createDataFrame([(10, 2)], "user_id long, job_id long")
    rows = lexical.bm25_rankings(frame(spark, {10: ["a"]}), docs, 5, hidden).collect()
    assert [(r["job_id"], r["rank"]) for r in rows] == [(1, 1)]


def test_hashed_vectors_take_one_shuffle(spark):
    """from tokens to vectors inside one task; ids without text, repeated and null."""
    rows = [(1, ["a", "b", "b"]), (2, []), (3, None), (4, ["c", None]), (4, ["d"]), (None, ["a"])]
    tokens = spark.createDataFrame(rows, "id long, tokens array<string>")
    bucket, sign = lexical.hash_bucket(F.col("term"), 8)
    idf = spark.createDataFrame([("a", 2.0), ("b", 3.0)], "term string, idf double")
    idf = F.broadcast(idf.select("term", bucket.alias("bucket"), (sign * F.col("idf")).alias("value")))
    vectors = lexical.hashed_vectors(tokens, idf, 8)
    assert plan_of(vectors).count("Exchange hashpartitioning") == 1

    signed = {t: spark.createDataFrame([(t,)], "term string").select(bucket, sign).first() for t in "abcd"}

    def vector(*terms):
        v = np.zeros(8)
        for t in terms:
            v[signed[t][0]] += signed[t][1] * {"a": 2.0, "b": 3.0}.get(t, 1.0)
        return list(v / np.linalg.norm(v)) if np.linalg.norm(v) else list(v)

    got = []
    for r in vectors.collect():
        v = np.zeros(8)
        v[r["keys"]] = r["weights"]
        got.append((r["id"], [pytest.approx(x) for x in v]))
    expected = [(1, vector("a", "b", "b")), (2, vector()), (3, vector()), (4, vector("c", "d")), (4, vector("c", "d")), (None, vector())]
    key = lambda e: (e[0] is None, e[0] or 0)
    assert [e for e in sorted(expected, key=key)] == [(i, v) for i, v in sorted(got, key=key)]


def test_postings_stay_where_they_are(spark):
    """few asked terms are sent to the postings, which are not shuffled for each read."""
    asked = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "user_id long, term string, times double")
    postings = spark.createDataFrame([("a", 5, 0, 1.0, 1.0), ("b", 5, 0, 1.0, 1.5)], "term string, job_id long, block int, low double, high double")
    sums = pruning._sums(cut_lineage(asked), cut_lineage(postings), None)
    assert "BroadcastHashJoin" in plan_of(sums) and "SortMergeJoin" not in plan_of(sums)
    assert {(r["user_id"], r["job_id"], r["low"], r["high"]) for r in sums.collect()} == {(1, 5, 1.0, 1.0), (2, 5, 2.0, 3.0)}
