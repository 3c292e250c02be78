"""Popularity and rule rankings, two stages, full rankings."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.functions import features as fx
from talentweave.operators import pairs, scoring
from talentweave.plans.experiments import FEATURES

USER = "user_id string, skills array<string>, live_city string, desired_cities array<string>, desired_types array<string>, degree_rank int, years double"
JOB = "job_id string, skills array<string>, city string, job_type string, min_degree_rank int, min_years double"


def test_popularity_paths_agree(spark):
    users = spark.createDataFrame([(f"u{i}",) for i in range(6)], "user_id string")
    jobs = spark.createDataFrame([(f"j{i:02d}",) for i in range(30)], "job_id string")
    train = spark.createDataFrame([(f"u{i % 6}", f"j{(i * i) % 30:02d}") for i in range(60)], "user_id string, job_id string").distinct()
    light = scoring.popularity_rankings(users, jobs, train, train, 8)
    heavy = scoring.popularity_rankings(users, jobs, train, train, 8, slack=0)
    mixed = scoring.popularity_rankings(users, jobs, train, train, 8, slack=5)
    rows = {tuple(r) for r in light.collect()}
    assert len(rows) == 48 and rows == {tuple(r) for r in heavy.collect()} == {tuple(r) for r in mixed.collect()}
    assert light.join(train, ["user_id", "job_id"]).count() == 0


def test_popularity_counts_users_once(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    train = spark.createDataFrame([("u", "a"), ("u", "a"), ("v", "a")], "user_id string, job_id string")
    assert {r["job_id"]: r["score"] for r in scoring.popularity_counts(jobs, train).collect()} == {"a": 2.0, "b": 0.0}


def test_rule_edge_cases(spark):
    users = spark.createDataFrame([("u", ["x"], "", [], [], 0, 0.0)], USER)
    jobs = spark.createDataFrame([("a", ["x", "y"], "", "", 0, 0.0), ("b", [], "5", "t", 3, 1.0)], JOB)
    got = {r["job_id"]: r["score"] for r in scoring.rule_rankings(users, jobs, None).collect()}
    # an empty home city matches an empty job city; no desired types means no type term
    assert got["a"] == pytest.approx(3 * 0.5 + 1.0 + 0.3 + 0.3)
    assert got["b"] == 0.0


@pytest.mark.parametrize("topn", [2, 9, 500])
def test_rule_rankings_equal_all_pairs(spark, topn):
    """Rankings cut short, with hidden posts, people who share nothing with most posts, and posts that ask for nothing."""
    rng = random.Random(topn)
    skills = [f"k{i}" for i in range(12)]
    people = [(f"u{i:02d}", [s for n, s in enumerate(skills) if rng.random() < 0.5 / (n + 1)], rng.choice(["", "1", "2"]), rng.sample(["2", "3", "4"], rng.randint(0, 2)),
               rng.sample(["x", "y"], rng.randint(0, 1)), rng.randint(0, 6), rng.choice([0.0, 0.5, 3.0, 9.0])) for i in range(25)]
    posts = [(f"j{i:03d}", [s for n, s in enumerate(skills) if rng.random() < 0.6 / (n + 1)], rng.choice(["1", "2", "3", "9"]), rng.choice(["", "x", "y", "z"]),
              rng.randint(0, 5), rng.choice([0.0, 1.0, 3.0, 5.0])) for i in range(120)]
    users, jobs = spark.createDataFrame(people, USER), spark.createDataFrame(posts, JOB)
    hidden = {(u[0], j[0]) for u in people for j in posts if rng.random() < 0.15}
    exclude = spark.createDataFrame(sorted(hidden), "user_id string, job_id string")
    pairs_ = pairs.attach_profiles(users.select("user_id").crossJoin(jobs.select("job_id")), users, jobs).withColumns(dict(zip(FEATURES, fx.pair_features_v2(), strict=True)))
    w = fx.RULE_V2_WEIGHTS
    want = {}
    for r in pairs_.collect():
        if (r.user_id, r.job_id) not in hidden:
            value = w["coverage"] * r.coverage + w["city"] * r.city + w["type"] * r.type + w["degree"] * r.degree + w["years"] * r.experience
            want.setdefault(r.user_id, []).append((-round(value, 9), r.job_id))
    got = {}
    for r in scoring.rule_rankings(users, jobs, exclude, topn).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.job_id, r.score))
    assert got.keys() == want.keys()
    for u, rows in got.items():
        best = sorted(want[u])[:topn]
        assert [(j, pytest.approx(-s)) for s, j in best] == [(j, s) for _, j, s in sorted(rows)]
    with pytest.raises(ValueError):
        scoring.rule_rankings(users, jobs, exclude, topn, {"city": -1.0})


def test_rule_v1_ignores_unstated_requirements(spark):
    users = spark.createDataFrame([("u", ["x", "y"], ["c"], ["c"], ["t"], 5, 2.0)],
                                  "user_id string, skills array<string>, city_ids array<string>, desired_city_ids array<string>, desired_types array<string>, degree_rank int, years double")
    jobs = spark.createDataFrame(
        [("a", ["x", "z"], "c", "t", "", 0, 0.0), ("b", ["x", "z"], "c", "t", "本科", 5, 2.0), ("n", [], "", "", "", 0, 0.0)],
        "job_id string, skills array<string>, city string, job_type string, min_degree string, min_degree_rank int, min_years double",
    )
    ranked = {r["job_id"]: r["score"] for r in scoring.rule_rankings_v1(users, jobs, None).collect()}
    rows = pairs.attach_profiles(users.select("user_id").crossJoin(jobs.select("job_id")), users, jobs)
    rows = rows.select("job_id", *fx.pair_features_v1()).withColumn("score", fx.rule_score_v1())
    for r in rows.collect():
        assert ranked[r["job_id"]] == pytest.approx(r["score"])
    assert ranked["b"] - ranked["a"] == pytest.approx(0.2)
    assert ranked["n"] == pytest.approx(0.1)


def test_three_comparison_styles_for_unstated_requirements(spark):
    users = spark.createDataFrame([("u", [], "", [], [], 0, 0.0)], USER).withColumn("city_ids", F.array().cast("array<string>")).withColumn(
        "desired_city_ids", F.array().cast("array<string>"))
    jobs = spark.createDataFrame([("j", [], "c", "t", 0, 0.0)], JOB).withColumn("min_degree", F.lit(""))
    row = pairs.attach_profiles(spark.createDataFrame([("u", "j")], "user_id string, job_id string"), users, jobs)
    first = row.select(*fx.pair_features_v1()).first()
    second = row.select(*fx.pair_features_v2()).first()
    assert first["education_match"] == 0.0 and first["experience_match"] == 0.0
    assert second["degree"] == 1.0 and second["experience"] == 1.0


def test_two_stage_keeps_the_tail(spark):
    first = spark.createDataFrame([("u", f"j{i}", 1.0 / i, i) for i in range(1, 6)], "user_id string, job_id string, score double, rank int")
    second = spark.createDataFrame([("u", "j1", 0.1), ("u", "j2", 0.9), ("u", "j3", 0.5)], "user_id string, job_id string, score double")
    got = [r["job_id"] for r in scoring.two_stage(first, second, 3).orderBy("rank").collect()]
    assert got == ["j2", "j3", "j1", "j4", "j5"]


def test_requirement_features(spark):
    row = spark.createDataFrame(
        [(["a", "b"], "c", "m", 3.0, ["a", "x"], ["b"], "c", "m", None)],
        "skills array<string>, expected_city string, education string, experience_years double, job_required_skills array<string>,"
        " job_preferred_skills array<string>, job_city string, job_education_requirement string, job_experience_requirement double",
    )
    got = row.select("*", *fx.requirement_features()).withColumn("score", fx.requirement_score()).first()
    assert (got["required_skill_coverage"], got["preferred_skill_coverage"], got["experience_match"]) == (0.5, 1.0, 0.0)
    assert got["score"] == pytest.approx(0.5 * (0.8 * 0.5 + 0.2) + 0.2 + 0.1)
    counts = row.select(*fx.requirement_path_counts()).first()
    assert tuple(counts) == (1.0, 1.0, 1.0, 2.0)


def test_alias_normalization(spark):
    df = spark.createDataFrame([("u", [" JS ", "javascript", "", "sql"]), ("v", [])], "user_id string, skills array<string>")
    aliases = spark.createDataFrame([("js", "javascript")], "alias string, canonical string")
    got = {r["user_id"]: r["skills"] for r in pairs.normalize_skill_list(df, "user_id", "skills", aliases).collect()}
    assert got == {"u": ["javascript", "sql"], "v": []}
