"""Rankings by popularity and by rules over the whole catalogue."""

from __future__ import annotations

from collections.abc import Callable
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import RULE_V1_WEIGHTS, RULE_V2_WEIGHTS
from ..session import cut_lineage
from .ordering import exploded_range, global_position, position_in_group, top_per_group
from .pruning import pruned_candidates
from .topk import SCORE_DIGITS, _flat, sparse_product

TOPN = 1000
HEAD_SLACK = 1000
DENSE_TERMS = 512  # up to so many terms, counts come from a product of matrices


def popularity_counts(jobs: DataFrame, train_pairs: DataFrame) -> DataFrame:
    """(job_id, score): users with a train positive on the job; unseen jobs score 0."""
    counts = train_pairs.select("user_id", "job_id").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("_n"))
    return jobs.select("job_id").join(counts, "job_id", "left").select(
        "job_id", F.coalesce("_n", F.lit(0)).cast("double").alias("score")
    )


def popularity_rankings(
    users: DataFrame, jobs: DataFrame, train_pairs: DataFrame, exclude: DataFrame, topn: int = TOPN,
    slack: int = HEAD_SLACK,
) -> DataFrame:
    """(user_id, job_id, score, rank): the most popular jobs a user has not already taken.

    A user with ``e`` excluded jobs finds its ``topn`` inside the first ``topn + e`` places of the one
    global list. Users with at most ``slack`` exclusions read a list head of fixed length and need no
    join with the catalogue; the others meet the full list by place, which is an equi-join on a unique key.
    """
    counts = popularity_counts(jobs, train_pairs)
    place = [F.desc("score"), F.asc("job_id")]
    hidden = exclude.select("user_id", "job_id").join(users.select("user_id"), "user_id", "left_semi")
    sizes = hidden.groupBy("user_id").agg(F.count(F.lit(1)).alias("_hidden"))
    asked = users.select("user_id").join(sizes, "user_id", "left").fillna(0, ["_hidden"])

    few = asked.where(F.col("_hidden") <= slack)
    head = counts.orderBy(*place).limit(topn + slack)
    head_list = head.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "job_id"))).alias("_head")
    )
    few_hidden = (
        hidden.join(few.where(F.col("_hidden") > 0).select("user_id"), "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.collect_set("job_id").alias("_jobs"))
    )
    light = few.join(few_hidden, "user_id", "left").withColumn("_head", head_list.scalar())
    open_jobs = F.filter(
        F.slice("_head", 1, F.lit(topn) + F.col("_hidden").cast("int")),
        lambda e: F.col("_jobs").isNull() | ~F.array_contains("_jobs", e["job_id"]),
    )
    light = light.select("user_id", F.posexplode(F.slice(open_jobs, 1, topn)).alias("_pos", "_e")).select(
        "user_id", F.col("_e.job_id").alias("job_id"), (-F.col("_e._s")).alias("score"), (F.col("_pos") + 1).alias("rank")
    )

    many = asked.where(F.col("_hidden") > slack)
    if many.limit(1).count() == 0:
        return light
    places = global_position(counts, place, "_place")
    wanted = exploded_range(many, topn + F.col("_hidden"), "_place").select("user_id", "_place")
    left_over = wanted.join(places, "_place").join(hidden, ["user_id", "job_id"], "left_anti")
    heavy = position_in_group(left_over, ["user_id"], ["_place"], "_pos").where(F.col("_pos") < topn)
    return light.unionByName(
        heavy.select("user_id", "job_id", "score", (F.col("_pos") + 1).cast("int").alias("rank"))
    )


def _rule_topn(people: DataFrame, posts: DataFrame, exclude: DataFrame | None, topn: int, gains: dict[str, Column | float], score: Column) -> DataFrame:
    """Best ``topn`` posts of every person by a sum of rules, without meeting every pair.

    ``people`` (user_id, skills, cities, types, degree, years) and ``posts`` (job_id, skills, cities, types, need_degree,
    need_years, n_skills, extra) hold distinct values. ``gains``: what a shared skill adds at least and at most (``skill_low``,
    ``skill_high``, of a post), a shared city and type, a reached degree and years; none is negative. ``score`` is the exact
    value of a pair, over ``shared`` (number of common skills), ``same_city``, ``same_type`` and both sides' columns.

    * Every skill, city and type has an inverted list of its posts. The lists' greatest gains bound what a list that is not
      read can add, so long lists are only met where they can lift a post into the result (``pruning``).
    * A post that shares nothing is worth what its degree, years and ``extra`` give. Such posts are read in order of that
      worth from lists by requirement steps, for people whose result may hold any.
    * Pairs that are left are scored exactly.
    """
    people, posts = cut_lineage(people), cut_lineage(posts)
    if any(not isinstance(g, Column) and g < 0 for g in gains.values()):
        raise ValueError("rule weights must not be negative")

    def named(prefix: str, values: str) -> Column:
        return F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.concat(F.lit(prefix), x.cast("string")))

    terms = [named(prefix, values) for prefix, values in (("s:", "skills"), ("c:", "cities"), ("t:", "types"))]
    asked = people.select("user_id", F.explode_outer(F.concat(*terms)).alias("term")).where("term is not null").withColumn("times", F.lit(1.0))
    worth = ((gains["skill_low"], gains["skill_high"]), (gains["city"], gains["city"]), (gains["type"], gains["type"]))
    as_column = lambda g: g if isinstance(g, Column) else F.lit(float(g))
    entries = []
    for values, (low, high) in zip(terms, worth, strict=True):
        pair = F.array(F.struct(as_column(low).cast("double").alias("low"), as_column(high).cast("double").alias("high")))
        entries.append(F.zip_with(values, F.array_repeat(pair[0], F.size(values)), lambda t, g: F.struct(t.alias("term"), g["low"].alias("low"), g["high"].alias("high"))))
    postings = posts.select("job_id", F.least(F.lit(64), F.col("n_skills")).cast("int").alias("block"), F.inline_outer(F.concat(*entries))).where("term is not null")
    most = posts.agg(F.coalesce(F.max("extra"), F.lit(0.0))).first()[0]
    base = float(gains["degree"]) + float(gains["years"]) + float(most)
    found = pruned_candidates(cut_lineage(asked), cut_lineage(postings), topn, exclude, base)
    pairs = found.candidates.select("user_id", "job_id").unionByName(_sharing_nothing(people, posts, found.candidates, exclude, topn, gains, base))
    own = [F.col(c).alias(f"_{c}") for c in ("skills", "cities", "types")]
    both = pairs.join(people.select("user_id", "skills", "cities", "types", "degree", "years"), "user_id")
    both = both.join(posts.select("job_id", *own, "need_degree", "need_years", "n_skills", "extra"), "job_id")
    overlap = lambda c: F.coalesce(F.arrays_overlap(c, f"_{c}"), F.lit(False)).cast("double")
    both = both.withColumns({"shared": F.size(F.array_intersect("skills", "_skills")).cast("double"), "same_city": overlap("cities"), "same_type": overlap("types")})
    scored = both.select("user_id", "job_id", F.round(score, SCORE_DIGITS).alias("score"))
    return top_per_group(scored, ["user_id"], [F.desc("score"), F.asc("job_id")], topn)


def _steps(value: float | Column, have: str, need: str) -> Column:
    return F.when(F.col(have) >= F.col(need), F.lit(float(value))).otherwise(0.0)


def _sharing_nothing(people, posts, candidates, exclude, topn: int, gains, base: float) -> DataFrame:
    """(user_id, job_id): the best posts that are no candidates, for people whose result may hold some."""
    best = top_per_group(candidates.select("user_id", "low"), ["user_id"], [F.desc("low")], topn, "_place")
    full = best.where((F.col("_place") == topn) & (F.col("low") > base + 1e-7)).select("user_id")
    # a person's degree and years count as the highest step of the posts that they reach
    steps_of = posts.agg(F.collect_set("need_degree").alias("_degrees"), F.collect_set("need_years").alias("_years"))  # one row
    reached = [
        F.coalesce(F.array_max(F.filter(steps, lambda step: step <= F.col(have))), F.lit(float("-inf"))).alias(have)  # noqa: B023
        for have, steps in (("degree", "_degrees"), ("years", "_years"))
    ]
    left = people.select("user_id", "degree", "years").join(full, "user_id", "left_anti")
    left = left.withColumns({c: steps_of.select(c).scalar() for c in steps_of.columns})
    open_people = cut_lineage(left.select("user_id", *reached))
    # places to read: those of a full result, of all candidates and of all hidden posts
    taken = candidates.join(open_people.select("user_id"), "user_id", "left_semi").select("user_id", "job_id")
    if exclude is not None:
        taken = taken.union(exclude.join(open_people.select("user_id"), "user_id", "left_semi").select("user_id", "job_id")).distinct()
    taken = cut_lineage(taken)
    counts = taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = open_people.join(counts, "user_id", "left").select("user_id", "degree", "years", (F.coalesce("_n", F.lit(0)) + topn).alias("_wanted"))
    longest = wanted.agg(F.max("_wanted")).first()[0]
    if longest is None:
        return taken.limit(0)
    # requirement steps of the posts, and classes of people who reach the same steps: both as few as the steps are
    steps = ["need_degree", "need_years", "extra"]
    listed = cut_lineage(top_per_group(posts.select("job_id", *steps), steps, [F.asc("job_id")], longest, "_place").drop("_place"))
    kinds = listed.agg(F.collect_set(F.struct(*steps)).alias("_kinds"))  # one row
    classes = wanted.select("degree", "years").distinct().withColumn("_kinds", kinds.scalar())
    value = _steps(gains["degree"], "degree", "need_degree") + _steps(gains["years"], "years", "need_years") + F.col("extra")
    worth = cut_lineage(classes.select("degree", "years", F.inline("_kinds")).withColumn("_worth", F.round(value, SCORE_DIGITS)))
    ranked = worth.join(listed, steps)
    ranked = top_per_group(ranked, ["degree", "years"], [F.desc("_worth"), F.asc("job_id")], longest, "_place")
    read = wanted.join(ranked.select("degree", "years", "job_id", "_place"), ["degree", "years"]).where(F.col("_place") <= F.col("_wanted"))
    return read.select("user_id", "job_id").join(taken, ["user_id", "job_id"], "left_anti")


def rule_rankings(
    users: DataFrame,
    jobs: DataFrame,
    exclude: DataFrame | None,
    topn: int = TOPN,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Second-generation rule ranking of the whole catalogue.

    coverage, city, type, degree and years terms with overridable weights (none negative). An empty home city counts as
    a city of the user, and a user without desired types gets no type term.
    """
    w = {**RULE_V2_WEIGHTS, **(weights or {})}
    people = users.select(
        "user_id",
        F.array_distinct("skills").alias("skills"),
        F.array_distinct(F.concat("desired_cities", F.array("live_city"))).alias("cities"),
        F.array_distinct("desired_types").alias("types"),
        F.col("degree_rank").cast("double").alias("degree"),
        F.col("years").cast("double").alias("years"),
    )
    posts = jobs.select(
        "job_id",
        F.array_distinct("skills").alias("skills"),
        F.array("city").alias("cities"),
        F.array("job_type").alias("types"),
        F.col("min_degree_rank").cast("double").alias("need_degree"),
        F.col("min_years").cast("double").alias("need_years"),
        F.size(F.array_distinct("skills")).cast("double").alias("n_skills"),
        F.lit(0.0).alias("extra"),
    )
    each = F.lit(float(w["coverage"])) / F.greatest(F.lit(1.0), F.col("n_skills"))
    gains = {"skill_low": each, "skill_high": each, "city": w["city"], "type": w["type"], "degree": w["degree"], "years": w["years"]}
    score = (
        w["coverage"] * (F.col("shared") / F.greatest(F.lit(1.0), F.col("n_skills")))
        + w["city"] * F.col("same_city")
        + w["type"] * F.col("same_type")
        + _steps(w["degree"], "degree", "need_degree")
        + _steps(w["years"], "years", "need_years")
    )
    return _rule_topn(people, posts, exclude, topn, gains, score)


def rule_rankings_v1(users: DataFrame, jobs: DataFrame, exclude: DataFrame | None, topn: int = TOPN) -> DataFrame:
    """First-generation rule ranking: unstated requirements score 0, shared skills add a log term."""
    w = RULE_V1_WEIGHTS
    people = users.select(
        "user_id",
        F.array_distinct("skills").alias("skills"),
        F.array_distinct(F.concat("city_ids", "desired_city_ids")).alias("cities"),
        F.array_distinct("desired_types").alias("types"),
        F.col("degree_rank").cast("double").alias("degree"),
        F.col("years").cast("double").alias("years"),
    )
    never = F.lit(float("inf"))
    n_skills = F.size(F.array_distinct("skills")).cast("double")
    posts = jobs.select(
        "job_id",
        F.array_distinct("skills").alias("skills"),
        F.array("city").alias("cities"),
        F.filter(F.array("job_type"), lambda t: t != "").alias("types"),
        F.when(F.col("min_degree") == "", never).otherwise(F.col("min_degree_rank").cast("double")).alias("need_degree"),
        F.when(F.col("min_years") == 0, never).otherwise(F.col("min_years").cast("double")).alias("need_years"),
        n_skills.alias("n_skills"),
        # nothing is missing where no skill is asked for
        F.when(n_skills == 0, F.lit(w["missing"])).otherwise(0.0).alias("extra"),
    )
    at_least_one = F.greatest(F.lit(1.0), F.col("n_skills"))
    each = F.lit(w["coverage"] + w["missing"]) / at_least_one
    gains = {
        "skill_low": each, "skill_high": each + w["paths"] * log1p(1.0), "city": w["city"], "type": w["type"],
        "degree": w["education"], "years": w["experience"],
    }
    score = (
        w["coverage"] * (F.col("shared") / at_least_one)
        + w["missing"] * (1.0 - (F.col("n_skills") - F.col("shared")) / at_least_one)
        + w["city"] * F.col("same_city")
        + _steps(w["education"], "degree", "need_degree")
        + _steps(w["experience"], "years", "need_years")
        + w["type"] * F.col("same_type")
        + w["paths"] * F.log1p("shared")
    )
    return _rule_topn(people, posts, exclude, topn, gains, score)


def full_ranking(scored: DataFrame) -> DataFrame:
    """Rank every scored pair of a user, best first, ties by job id; a user may own any number of pairs."""
    ranked = position_in_group(scored, ["user_id"], [F.desc("score"), F.asc("job_id")], "_pos")
    return ranked.withColumn("rank", (F.col("_pos") + 1).cast("int")).drop("_pos")


def two_stage(first: DataFrame, second_scores: DataFrame, recall_k: int) -> DataFrame:
    """Head of a ranking re-ordered by second scores; the tail keeps its places.

    ``second_scores`` holds (user_id, job_id, score) for the first ``recall_k`` places. The head of a
    user is at most ``recall_k`` rows, so the window is bounded.
    """
    head = first.where(F.col("rank") <= recall_k).select("user_id", "job_id")
    order = W.partitionBy("user_id").orderBy(F.desc("score"), F.asc("job_id"))
    # a pair without a second score stays behind those with one
    rescored = head.join(second_scores.select("user_id", "job_id", "score"), ["user_id", "job_id"], "left")
    return rescored.withColumn("rank", F.row_number().over(order)).unionByName(
        first.where(F.col("rank") > recall_k).select("user_id", "job_id", "score", "rank")
    )


def mask_pairs(scored: DataFrame, hidden: DataFrame) -> DataFrame:
    """Scored pairs without the hidden ones."""
    return scored.join(hidden.select("user_id", "job_id"), ["user_id", "job_id"], "left_anti")


def _met_once(q: pa.Table, i: pa.Table, keys: str) -> Callable[[int, int], np.ndarray]:
    """Function giving, for a slice of ``q``, whether a row of ``i`` has a key of it."""
    q_keys, q_row = _flat(q, keys)
    names = np.unique(q_keys)
    if len(q_keys) > len(np.unique(q_row)) or len(names) > DENSE_TERMS:
        cells = sparse_product(q, i, keys, None)
        return lambda start, stop: cells(start, stop) > 0
    i_keys, i_row = _flat(i, keys)
    holds = np.zeros((len(names) + 1, i.num_rows), np.bool_)  # the last one for rows of ``q`` without a key
    at = np.minimum(np.searchsorted(names, i_keys), max(0, len(names) - 1))
    known = names[at] == i_keys if len(names) else np.zeros(len(i_keys), np.bool_)
    holds[at[known], i_row[known]] = True
    own = np.full(q.num_rows, len(names))
    own[q_row] = np.searchsorted(names, q_keys)
    return lambda start, stop: holds[own[start:stop]]


def _shared_terms(q: pa.Table, i: pa.Table, keys: str) -> Callable[[int, int], np.ndarray]:
    """Function giving, for a slice of ``q``, how many distinct keys it shares with the rows of ``i``."""
    (q_keys, q_row), (i_keys, i_row) = _flat(q, keys), _flat(i, keys)
    names = np.intersect1d(q_keys, i_keys)
    if len(names) > DENSE_TERMS:
        return sparse_product(q, i, keys, None)

    def marks(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        cells = np.zeros((n, len(names)), np.float32)  # counts are exact up to 2^24
        if len(names):
            at = np.minimum(np.searchsorted(names, values), len(names) - 1)
            known = names[at] == values
            cells[row[known], at[known]] = 1
        return cells

    left, right = marks(q_keys, q_row, q.num_rows), marks(i_keys, i_row, i.num_rows).T
    return lambda start, stop: left[start:stop] @ right


def rule_levels_v1_block(q: pa.Table, i: pa.Table) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """``rule_score_v1`` of two blocks as (codes, table): the score of the ``r``-th job of a slice and a user is
    ``table[r, codes[r, user]]``, NaN where the job's skills are unknown.

    A code holds the number of shared skills and the four conditions that a pair meets or not. Jobs carry ``skill_keys``, ``city_keys``, ``type_keys`` (``term_keys`` of distinct values, without unknown ones),
    ``n_skills``, ``degree_stated``, ``job_min_degree_rank`` and ``job_min_years``; users the same keys, ``degree_rank`` and ``years``.
    """
    shared, city, kind = _shared_terms(q, i, "skill_keys"), _met_once(q, i, "city_keys"), _met_once(q, i, "type_keys")

    def numbers(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)  # unknown: NaN, which compares as no

    n_job, stated, degree, least = (numbers(q, c)[:, None] for c in ("n_skills", "degree_stated", "job_min_degree_rank", "job_min_years"))
    degree, least = np.where(stated == 1, degree, np.nan), np.where(least != 0, least, np.nan)
    rank, years = numbers(i, "degree_rank"), numbers(i, "years")
    most = int(np.bincount(_flat(q, "skill_keys")[1], minlength=1).max())
    kinds = most + 1  # numbers of shared skills
    small = np.uint8 if kinds * 16 <= 256 else np.uint16 if kinds * 16 <= 65_536 else np.int64
    w = RULE_V1_WEIGHTS
    code = np.arange(kinds * 16)
    n, met = code % kinds, [code // kinds & bit > 0 for bit in (1, 2, 4, 8)]

    def levels(start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(start, stop)
        codes = shared(start, stop).astype(small)
        for bit, cells in ((1, city(start, stop)), (2, rank >= degree[own]), (4, years >= least[own]), (8, kind(start, stop))):
            codes += cells.view(np.uint8) * small(bit * kinds)
        all_ = n_job[own]
        each = np.maximum(1, all_)
        table = (
            w["coverage"] * (n / each) + w["missing"] * (1.0 - (all_ - n) / each) + w["city"] * met[0] + w["education"] * met[1]
            + w["experience"] * met[2] + w["type"] * met[3] + w["paths"] * np.log1p(n)
        )
        return codes, table

    return levels


def rule_scores_v1_block(q: pa.Table, i: pa.Table) -> Callable[[int, int], np.ndarray]:
    """``rule_score_v1`` of two blocks, see ``rule_levels_v1_block``: jobs ``q`` and users ``i``, NaN where the job's skills are unknown."""
    levels = rule_levels_v1_block(q, i)

    def rows(start: int, stop: int) -> np.ndarray:
        codes, table = levels(start, stop)
        return np.take_along_axis(table, codes.astype(np.intp), axis=1)

    return rows
