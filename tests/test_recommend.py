"""Batch recommendation on one candidate and two jobs, and the paging extras."""

import pytest
from pyspark.sql import functions as F

from talentweave.plans import recommend as rec


@pytest.fixture(scope="module")
def tables(spark):
    candidates = spark.createDataFrame(
        [("u1", "python pytorch 推荐系统", ["python", "pytorch", "推荐"], ["530"], ["530"], ["互联网"], ["算法工程师"], "本科", 5, 5.0)],
        "user_id string, text string, skills array<string>, city_ids array<string>, desired_city_ids array<string>, industries array<string>,"
        " desired_types array<string>, degree string, degree_rank int, years double",
    )
    jobs = spark.createDataFrame(
        [("j1", "算法工程师", "python pytorch 推荐系统", ["python", "pytorch", "推荐"], "530", "算法工程师", "本科", 5, 3.0),
         ("j2", "司机", "驾驶 货车", ["驾驶"], "1", "司机", "", 0, 0.0)],
        "job_id string, title string, text string, skills array<string>, city string, job_type string, min_degree string, min_degree_rank int, min_years double",
    )
    return candidates, jobs


def ask(spark, *rows):
    full = [(r.get("id", f"r{i}"), r.get("who"), r.get("profile"), r.get("model"), r.get("top_k"), r.get("explain")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, rec.REQUEST_SCHEMA)


def test_rule_request_carries_evidence(spark, tables):
    row = rec.recommend(ask(spark, {"who": "u1", "model": "rule", "top_k": 1}), *tables)["items"].first()
    assert row["job_id"] == "j1" and row["rank"] == 1 and "python" in row["matched_skills"]
    assert row["feature_evidence"]["city_match"] == 1.0 and row["warnings"] == []
    assert row["reasons"] == ["技能覆盖度 1.00", "城市匹配", "学历满足岗位要求", "经验满足岗位要求", "岗位类型符合期望"]
    assert row["score"] == pytest.approx(0.5 + 0.1 + 0.15 + 0.1 + 0.1 + 0.05 + 0.03 * 1.3862943611, rel=1e-6)


def test_missing_stored_ranking_falls_back_with_a_warning(spark, tables):
    row = rec.recommend(ask(spark, {"who": "u1", "model": "graph", "top_k": 1}), *tables)["items"].first()
    assert row["model"] == "rule" and row["warnings"] == [rec.FALLBACK_WARNING]


def test_stored_ranking_is_filtered_and_scored_by_rank(spark, tables):
    stored = spark.createDataFrame([("u1", "gone", 1), ("u1", "j2", 2), ("u1", "j1", 3)], "user_id string, job_id string, rank int")
    rows = rec.recommend(ask(spark, {"who": "u1", "model": " GRAPH ", "top_k": 500}), *tables, stored)["items"].orderBy("rank").collect()
    assert [(r["job_id"], r["score"], r["model"]) for r in rows] == [("j2", 1.0, "graph"), ("j1", 0.5, "graph")]


@pytest.mark.parametrize("model", ["bm25", "semantic_hash"])
def test_lexical_requests(spark, tables, model):
    rows = rec.recommend(ask(spark, {"who": "u1", "model": model, "top_k": 2, "explain": False}), *tables)["items"].orderBy("rank").collect()
    assert rows[0]["job_id"] == "j1" and all(r["score"] < rows[0]["score"] for r in rows[1:]) and rows[0]["matched_skills"] == [] and rows[0]["model"] == model


def test_bad_requests_become_rejects(spark, tables):
    asked = ask(spark, {"who": "u1", "model": "magic"}, {"model": "rule"}, {"who": "nobody", "model": "rule"}, {"who": "u1", "model": "rule", "top_k": 0})
    out = rec.recommend(asked, *tables)
    codes = {r["request_id"]: r["error_code"] for r in out["rejects"].collect()}
    assert codes == {"r0": "UNSUPPORTED_MODEL", "r1": "MISSING_CANDIDATE", "r2": "CANDIDATE_NOT_FOUND"}
    assert [(r["request_id"], r["top_k"]) for r in out["items"].collect()] == [("r3", 1)]


def test_profiles_take_precedence_and_keep_skill_order(spark, tables):
    profile = {"candidate_id": "", "skills": ["Go/SQL"], "experience_text": "sql 推荐", "desired_city_ids": ["530"], "current_city_ids": None,
               "industries": None, "desired_job_types": ["算法工程师"], "degree": "硕士", "years_experience": 1.0}
    asked = ask(spark, {"who": "nobody", "profile": profile, "model": "rule", "top_k": 1})
    accepted, _ = rec.resolve_requests(asked, tables[0])
    row = accepted.first()
    assert row["user_id"] == "anonymous" and row["skills"] == ["go", "sql", "推荐"] and row["degree_rank"] == 6 and row["city_ids"] == []
    assert rec.recommend(asked, *tables)["items"].first()["candidate_id"] == "anonymous"


def test_pages_and_percentages(spark):
    rows = spark.createDataFrame([("j", f"u{i:02d}", float(i)) for i in range(25)], "job_id string, user_id string, score double")
    got = rec.paged(rows, "job_id", F.col("score"), "user_id", 3, 10).collect()
    assert sorted(r["user_id"] for r in got) == ["u00", "u01", "u02", "u03", "u04"] and got[0]["total"] == 25 and got[0]["total_pages"] == 3
    assert rows.where("user_id = 'u03'").select(rec.match_percent(F.col("score"), F.lit(4.0))).first()[0] == 75


def test_invalid_profiles(spark):
    rows = spark.createDataFrame([("", "t"), ("j", None), ("j", "t")], "job_id string, job_title string")
    assert [r["reason"] for r in rec.invalid_profiles(rows, ["job_id", "job_title"]).collect()] == ["job_id is required", "job_title is required"]


def test_health(tables):
    assert {r["item"]: r["count"] for r in rec.health(*tables).collect()} == {"candidates": 1, "jobs": 2}


def test_registered_requests_are_answered_from_whole_stored_rankings(spark, small_dir):
    from talentweave.registry import knowledge

    stored = [tuple(r) for r in knowledge._stored_whole(spark, small_dir).collect()]
    places = {}
    for user, _, rank in stored:
        places[user] = max(places.get(user, 0), rank)
    assert any(int(u) % 2 for u in places) and max(places.values()) > 20
    served = {}
    for r in knowledge.recommendations(spark, small_dir).where("model = 'graph'").collect():
        served.setdefault(int(r.request_id[1:]), []).append(r.rank)
    wanted = {int(u): min(n, max(int(u) % 7 * 20, 1), 100) for u, n in places.items() if int(u) % 5 == 1 and int(u) % 11 != 10}
    assert {k: len(v) for k, v in served.items()} == wanted and max(wanted.values()) > 20 and any(k % 2 for k in wanted)
