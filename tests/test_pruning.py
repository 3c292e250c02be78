"""Pruned top-N against plain sums."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.operators import lexical
from talentweave.operators.pruning import pruned_candidates


def made(seed):
    rng = random.Random(seed)
    # list t0 is the shortest, t14 holds nearly every item and adds little
    lists = {f"t{n}": {j: round(rng.random() * (15 - n), 3) for j in range(300) if rng.random() < (n + 1) ** 2 / 240} for n in range(15)}
    asked = {u: {t: float(rng.randint(1, 2)) for t in rng.sample([*lists, "unseen"], rng.randint(1, 12))} for u in range(25)}
    hidden = {(u, j) for u in range(25) for j in range(300) if rng.random() < 0.1}
    return lists, asked, hidden


@pytest.mark.parametrize(("seed", "topn"), [(1, 3), (2, 10), (3, 400)])
def test_candidates_hold_the_best(spark, seed, topn):
    lists, asked, hidden = made(seed)
    postings = spark.createDataFrame([(t, j, j % 7, w, w * 1.1) for t, own in lists.items() for j, w in own.items()], "term string, job_id long, block int, low double, high double")
    asks = spark.createDataFrame([(u, t, n) for u, own in asked.items() for t, n in own.items()], "user_id long, term string, times double")
    exclude = spark.createDataFrame(list(hidden), "user_id long, job_id long")
    found = pruned_candidates(asks, postings, topn, exclude, base=0.5)
    got, left = {}, {}
    for r in found.candidates.collect():
        got.setdefault(r.user_id, {})[r.job_id] = r.low
    for r in found.left_out.collect():
        left.setdefault(r.user_id, set()).add(r.term)
    skipped = 0
    for u, terms in asked.items():
        sums = {}
        for t, n in terms.items():
            for j, w in lists.get(t, {}).items():
                if (u, j) not in hidden:
                    sums[j] = sums.get(j, 0) + n * w
        best = sorted(sums.values(), reverse=True)[:topn]
        # whatever ``low`` to ``high`` and the base make of an item, none outside the candidates can reach the threshold
        may = {j for j, s in sums.items() if len(best) < topn or s * 1.1 + 0.5 >= best[-1]}
        assert {j for j, s in sums.items() if len(best) < topn or s >= best[-1]} <= got.get(u, {}).keys() <= sums.keys()
        skipped += len(left.get(u, ()))
        for j, low in got.get(u, {}).items():
            read = sum(n * lists[t][j] for t, n in terms.items() if j in lists.get(t, {}) and t not in left.get(u, ()))
            assert low == pytest.approx(read)
        assert len(may) >= len(best)
    assert skipped > 20 if topn == 3 else skipped == 0 if topn == 400 else True
    steps = {(r.user_id, r.term): r.step for r in found.lists.collect()}
    assert set(steps) == {(u, t) for u, own in asked.items() for t in own if lists.get(t)}
    assert {k for k, s in steps.items() if s == 3} == {(u, t) for u, own in left.items() for t in own}


def test_ranking_is_the_same_however_short(spark, small_dir):
    """A cut ranking is the head of the whole one, and reads fewer postings."""
    read = spark.read.parquet
    queries = lexical.tokens_table(read(f"{small_dir}/benchmark.parquet"), "item_id", F.split(F.lower("text"), r"\W+"))
    documents = lexical.tokens_table(read(f"{small_dir}/documents.parquet"), "doc_id", F.split(F.lower("text"), r"\W+"))
    whole = {(r.user_id, r.job_id): (r.rank, r.score) for r in lexical.bm25_rankings(queries, documents, 10_000).collect()}
    cut = {(r.user_id, r.job_id): (r.rank, r.score) for r in lexical.bm25_rankings(queries, documents, 3).collect()}
    assert cut == {k: v for k, v in whole.items() if v[0] <= 3}
    met = lexical.bm25_pairs_met(queries, documents, 3).agg(F.sum("pairs"), F.sum("read")).first()
    assert met[1] < 0.8 * met[0]


def test_texts_are_cut_once(spark):
    """One tokenizer in the plan of a term count: the outer generator tests no array."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    tokens = docs.select("id", F.split("text", "MARK").alias("tokens"))
    plan = lexical.term_counts(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MARK") == 1
    assert lexical.term_statistics(tokens)._jdf.queryExecution().executedPlan().toString().count("MARK") == 1
