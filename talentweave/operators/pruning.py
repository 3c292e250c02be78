"""Best ``topn`` items per query by sums over common terms, term at a time: long lists are met only where they can matter.

Queries ask for terms, and a term's postings say how much it adds to an item. Summing all of them pairs every query with
every item that shares any frequent term. Instead:

1. Each query first reads its shortest lists, until they hold a few times ``topn`` entries, and looks up the best items
   found there in its other lists. The ``topn``-th best of their sums is a score that the result reaches (the threshold).
2. The query's longest lists are left out, as long as what they can add together stays below the threshold: an item met in
   none of the other lists cannot get into the result. The lists in between are read in full.
3. Items carry a block number, and each list knows its greatest value in each block. An item stays a candidate only if its
   sum and the left-out lists' greatest values in its block can still reach the threshold.

What is left is small: the caller completes the candidates' scores exactly. Every step is a join on terms, a sum with
map-side combine or a limit per query; a frequent term's postings are split by the engine's skew join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, cut_lineage
from .ordering import top_per_group

FIRST_READ = 4
SLACK = 1e-7


@dataclass
class Pruned:
    """``candidates`` (user_id, job_id, low, high: sums over the lists read), ``left_out`` (user_id, term, times), and
    ``lists`` (user_id, term, entries, step): 1 or 2 for the round that read a list, 3 for one that was left out."""

    candidates: DataFrame
    left_out: DataFrame
    lists: DataFrame


def list_bounds(postings: DataFrame) -> DataFrame:
    """(term, block, entries, greatest): length and greatest value of each list in each block."""
    return postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("entries"), F.max("high").alias("greatest"))


def _threshold(sums: DataFrame, topn: int) -> DataFrame:
    """(user_id, threshold): the ``topn``-th best sum; users with fewer items have no row."""
    best = top_per_group(sums.select("user_id", "low"), ["user_id"], [F.desc("low")], topn, "_place")
    return best.where(F.col("_place") == topn).select("user_id", F.col("low").alias("threshold"))


def _sums(asked: DataFrame, postings: DataFrame, exclude: DataFrame | None) -> DataFrame:
    # the terms asked for are few, the postings many: those stay where they are
    met = postings.join(broadcast_if_small(asked.select("user_id", "term", "times")), "term")
    sums = met.groupBy("user_id", "job_id", "block").agg(F.sum(F.col("times") * F.col("low")).alias("low"), F.sum(F.col("times") * F.col("high")).alias("high"))
    return sums if exclude is None else sums.join(exclude.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


def pruned_candidates(
    asked: DataFrame, postings: DataFrame, topn: int, exclude: DataFrame | None = None, base: float = 0.0
) -> Pruned:
    """Every item of each query's ``topn`` best, and few others.

    ``asked`` (user_id, term, times), one row per term; ``postings`` (term, job_id, block, low, high): a term adds at least
    ``low`` and at most ``high`` (neither negative) per time it is asked for; an item is in one block. ``base`` is the most
    an item can score besides. ``exclude`` (user_id, job_id) pairs are no items of a query. Items that share no term with a
    query are never candidates, and one that only shares left-out terms cannot score more than the threshold.

    Both inputs are read several times: pass written tables.
    """
    bounds = cut_lineage(list_bounds(postings))
    lists = bounds.groupBy("term").agg(F.sum("entries").alias("entries"), F.max("greatest").alias("greatest"))
    # a query's terms are as many as its text or profile names, so these windows are bounded
    short_first = W.partitionBy("user_id").orderBy("entries", "term").rowsBetween(W.unboundedPreceding, -1)
    planned = asked.join(lists, "term").withColumn("_before", F.coalesce(F.sum("entries").over(short_first), F.lit(0)))
    planned = cut_lineage(planned.withColumn("first", F.col("_before") < FIRST_READ * topn).drop("_before"))

    first = cut_lineage(_sums(planned.where("first"), postings, exclude))
    long_first = W.partitionBy("user_id").orderBy(F.desc("entries"), "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = planned.where("not first")
    # the best items so far, looked up in the other lists: their whole sums are a far better threshold than the first part
    heads = top_per_group(first.select("user_id", "job_id", "low"), ["user_id"], [F.desc("low"), F.asc("job_id")], FIRST_READ * topn, "_place")
    heads = cut_lineage(heads.drop("_place"))
    asked_of = rest.select("user_id", "term", "times")
    if heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        seen = postings.join(F.broadcast(heads.select("user_id", "job_id")), "job_id").join(asked_of, ["user_id", "term"])
    else:
        seen = heads.select("user_id", "job_id").join(asked_of, "user_id").join(postings, ["term", "job_id"])
    whole = heads.union(seen.select("user_id", "job_id", F.col("times") * F.col("low"))).groupBy("user_id", "job_id").agg(F.sum("low").alias("low"))
    reached = cut_lineage(_threshold(whole, topn))
    rest = rest.join(reached, "user_id", "left")
    together = F.sum(F.col("times") * F.col("greatest")).over(long_first)
    skip = F.coalesce(together + F.lit(base + SLACK) < F.col("threshold"), F.lit(False))
    rest = cut_lineage(rest.withColumn("skip", skip).drop("threshold", "first"))

    second = _sums(rest.where("not skip"), postings, exclude)
    both = first.unionByName(second).groupBy("user_id", "job_id", "block").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    both = cut_lineage(both)
    left_out = rest.where("skip").select("user_id", "term", "times")
    more = left_out.join(bounds, "term").groupBy("user_id", "block").agg(F.sum(F.col("times") * F.col("greatest")).alias("_more"))
    reach = F.col("high") + F.coalesce("_more", F.lit(0.0)) + F.lit(base + SLACK)
    reached = reached.union(_threshold(both, topn)).groupBy("user_id").agg(F.max("threshold").alias("threshold"))
    found = both.join(more, ["user_id", "block"], "left").join(reached, "user_id", "left")
    candidates = found.where(F.col("threshold").isNull() | (reach >= F.col("threshold"))).select("user_id", "job_id", "low", "high")
    steps = planned.where("first").select("user_id", "term", "entries", F.lit(1).alias("step"))
    steps = steps.union(rest.select("user_id", "term", "entries", F.when(F.col("skip"), 3).otherwise(2)))
    return Pruned(cut_lineage(candidates), left_out, steps)
