"""Explanations: template, audit, escaping, provenance, payload, evidence cuts."""

import json

import pytest
from pyspark.sql import functions as F

from talentweave.operators import evidence as ev
from talentweave.operators import pairs

SCHEMA = (
    "user_id string, job_id string, job_title string, score double, matched_skills array<struct<skill: string, weight: double>>,"
    " missing_skills array<string>, graph_paths array<string>, reasons array<string>, live_city string, desired_cities array<string>,"
    " desired_types array<string>, degree_rank int, years double, job_city string, job_job_type string, job_min_degree_rank int, job_min_years double"
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("u1", "j1", "python 后端工程师", 1.0, [("python", 0.6), ("mysql", 0.4)], ["redis", "docker"],
          ["Candidate:u1 -HAS_SKILL(0.6)-> Skill:python <-REQUIRES_SKILL- Job:j1"], ["技能覆盖率 50%"], "北京", ["上海", "北京"], ["后端"], 5, 2.0, "上海", "后端", 5, 1.0)],
        SCHEMA,
    )


def skills(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "skill string")


def texts(spark, text):
    return spark.createDataFrame([("u1", "j1", text)], "user_id string, job_id string, text string")


def explained(spark, rows, text, *names):
    return ev.grounded_explanations(rows, texts(spark, text) if text is not None else None, skills(spark, *names)).first()


ALL = ("python", "mysql", "redis", "docker", "kafka", "spark")


def test_template_names_matched_and_missing_skills(spark, rows):
    row = explained(spark, rows, None, *ALL)
    assert row["text"] == "推荐岗位「python 后端工程师」:你的技能 python、mysql 与该岗位要求匹配。匹配依据:技能覆盖率 50%。建议补充技能:redis、docker。"
    assert row["source"] == "template" and row["faithful"] and row["html"].startswith('<div class="llm-explanation"><p>')


def test_allowed_skills_pass(spark, rows):
    row = explained(spark, rows, "你的 Python 和 mysql 很匹配,建议学习 redis 和 docker。", *ALL)
    assert row["source"] == "llm" and row["text"].startswith("你的") and row["rejected_text"] is None


def test_foreign_skills_are_rejected(spark, rows):
    row = explained(spark, rows, "这个岗位还需要 kafka 和 spark 经验。", *ALL)
    assert row["source"] == "template_fallback_unfaithful" and "kafka" not in row["text"] and "kafka" in row["rejected_text"]


def test_plain_prose_and_unknown_words_pass(spark, rows):
    assert explained(spark, rows, "这是一个很适合你的岗位,匹配度高。", *ALL)["source"] == "llm"
    assert explained(spark, rows, "a nice position", *ALL)["source"] == "llm"
    assert explained(spark, rows, "", *ALL)["source"] == "template"


def test_html_is_escaped(spark):
    html = spark.createDataFrame([("<script>alert(1)</script> python\n\n b ",)], "t string").select(ev.html_fragment(F.col("t"))).first()[0]
    assert html == '<div class="llm-explanation"><p>&lt;script&gt;alert(1)&lt;/script&gt; python</p><p>b</p></div>'


def test_subgraph_and_payload(rows):
    row = ev.local_subgraph(rows).withColumn("payload", ev.evidence_payload()).first()
    graph = json.loads(row["payload"])["local_subgraph"]
    assert graph["schema_version"] == "local_kg_v1" and json.loads(row["payload"])["matched_skills"][0] == {"skill": "python", "weight": 0.6}
    edges = {(e["source"], e["relation"], e["target"]) for e in graph["edges"]}
    assert {("candidate:u1", "MATCHED_TO", "job:j1"), ("candidate:u1", "HAS_SKILL", "skill:python"), ("job:j1", "REQUIRES_SKILL", "skill:redis"),
            ("candidate:u1", "LIVES_IN", "city:北京"), ("candidate:u1", "DESIRES_CITY", "city:上海"), ("job:j1", "LOCATED_IN", "city:上海"),
            ("candidate:u1", "DESIRES_TYPE", "job_type:后端"), ("job:j1", "OF_TYPE", "job_type:后端")} <= edges
    nodes = {n["id"]: n for n in graph["nodes"]}
    assert nodes["skill:redis"]["role"] == "missing_required_skill" and nodes["skill:python"]["attributes"] == {"attention": "0.6"}
    assert len(graph["structured_paths"]) == 2


def test_allowed_terms(rows):
    assert rows.select(ev.allowed_terms()).first()[0] == ["python", "mysql", "redis", "docker"]


def test_whole_skill_lists_are_shown(spark):
    many = [f"s{i:02d}" for i in range(12)]
    users = spark.createDataFrame([("u", many, "", [], [], 1, 0.0)], "user_id string, skills array<string>, live_city string, desired_cities array<string>, desired_types array<string>, degree_rank int, years double")
    jobs = spark.createDataFrame([("j", "t", many, "c", "x", 0, 0.0)], "job_id string, title string, skills array<string>, city string, job_type string, min_degree_rank int, min_years double")
    joined = pairs.attach_profiles(spark.createDataFrame([("u", "j", 0.5)], "user_id string, job_id string, score double"), users, jobs)
    logits = spark.createDataFrame([("j", "s03", 5.0)], "job_id string, skill string, logit double")
    row = ev.second_generation_evidence(joined, logits).first()
    assert row["reasons"] == ["技能覆盖率 100%(12/12 项要求技能匹配)"]
    assert len(row["matched_skills"]) == 12 and row["matched_skills"][0]["skill"] == "s03" and len(row["graph_paths"]) == 12
    assert row["graph_paths"][0].startswith("Candidate:u -HAS_SKILL(0.9") and row["missing_skills"] == []


def test_requirement_explanation(spark):
    row = spark.createDataFrame(
        [("u", "j", ["b", "a"], "c", ["a", "z"], ["b"], "c")],
        "user_id string, job_id string, skills array<string>, expected_city string, job_required_skills array<string>, job_preferred_skills array<string>, job_city string",
    )
    got = ev.requirement_explanation(row).first()
    assert got["matched_skills"] == ["a", "b"] and got["missing_skills"] == ["z"] and got["reasons"] == ["技能覆盖度较高", "城市匹配"]
    assert got["graph_paths"][0] == "Candidate:u -> Skill:a <- Job:j"
