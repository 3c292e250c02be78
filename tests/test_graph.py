"""Knowledge-graph build, message graph, propagation and attention on small graphs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.operators import graph, propagation, rerank


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame(
        [("u1", "北京", "北京,上海", "Python|团队|Java", "本科", 0), ("u1", "x", "", "", "", 1), (" u2 ", "-", "(-1)", "python", "", 2), ("", "y", "", "z", "", 3)],
        "user_id string, live_city_id string, desire_jd_city_id string, experience string, cur_degree_id string, row_index long",
    )
    jobs = spark.createDataFrame(
        [("j1", "工程师", "Acme ", "北京", "Python，熟练", 0), ("j2", "", "(Acme)", "", "rare", 1)],
        "jd_no string, jd_title string, company_name string, city string, job_description string, row_index long",
    )
    actions = spark.createDataFrame(
        [("u1", "j1", "1", "1", "0"), ("u1", "j1", "1", "0", "0"), ("u2", "j9", "0", "0", "true"), ("", "j1", "1", "1", "1")],
        "user_id string, jd_no string, browsed string, delivered string, satisfied string",
    )
    return users, jobs, actions


def test_nodes(spark, tables):
    nodes = {r["node_id"]: r for r in graph.build_graph(*tables)["nodes"].collect()}
    assert {"USER::u1", "USER::u2", "JOB::j1", "JOB::j2", "CITY::北京", "CITY::上海", "DEGREE::本科", "COMPANY::Acme", "SKILL::python", "SKILL::java"} <= set(nodes)
    assert "SKILL::团队" not in nodes and "CITY::-1" not in nodes
    assert nodes["JOB::j2"]["node_name"] == "j2" and nodes["JOB::j1"]["node_name"] == "工程师"
    attributes = json.loads(nodes["USER::u1"]["attributes_json"])
    assert list(attributes) == sorted(attributes) and attributes["live_city_id"] == "北京" and attributes["birthday"] == ""


def test_edges_and_weights(tables):
    rows = graph.build_graph(*tables)["edges"].collect()
    edges = {(r["source_id"], r["relation"], r["target_id"]): r["weight"] for r in rows}
    assert len(edges) == len(rows)
    assert edges[("USER::u1", "BROWSED_JOB", "JOB::j1")] == 1.0
    assert edges[("USER::u1", "DELIVERED_JOB", "JOB::j1")] == 5.0
    assert edges[("USER::u2", "SATISFIED_JOB", "JOB::j9")] == 10.0
    assert ("USER::u1", "LIVES_IN_CITY", "CITY::x") in edges
    assert ("JOB::j1", "REQUIRES_SKILL", "SKILL::python") in edges


def test_statistics_count_entities_before_deduplication(tables):
    stats = {r["item"]: r["count"] for r in graph.build_graph(*tables)["stats"].collect()}
    # "(-1)" is a city value that only vanishes when its node is made; both company spellings count
    assert stats == {"users": 3, "jobs": 2, "cities": 4, "industries": 0, "job_types": 0, "degrees": 1, "companies": 2, "skills": 4, "edges": stats["edges"]}


def test_rare_skills_leave_dangling_edges_unless_pruned(tables):
    kept = graph.build_graph(*tables, min_skill_freq=2)
    assert kept["nodes"].where("node_id = 'SKILL::rare'").count() == 0
    assert kept["edges"].where("target_id = 'SKILL::rare'").count() == 1
    # python occurs twice among users and once among jobs: the sides are tested apart
    assert kept["nodes"].where("node_type = 'skill'").count() == 1
    pruned = graph.build_graph(*tables, min_skill_freq=2, prune_dangling=True)["edges"]
    assert pruned.where("target_id = 'SKILL::rare' or target_id = 'JOB::j9'").count() == 0


def test_message_graph_uses_train_positives_only(spark):
    users = spark.createDataFrame([("u", ["a"])], "user_id string, skills array<string>")
    jobs = spark.createDataFrame([("j", ["a"]), ("k", ["b"]), ("l", [])], "job_id string, skills array<string>")
    rows = spark.createDataFrame([("u", "j", 2, "train"), ("u", "k", 3, "test"), ("u", "l", 1, "train")], "user_id string, job_id string, level int, split string")
    plain = {tuple(r) for r in graph.message_graph(users, jobs, rows).collect()}
    assert plain == {("cs", "u", "a"), ("sc", "a", "u"), ("js", "j", "a"), ("sj", "a", "j"), ("js", "k", "b"), ("sj", "b", "k"), ("cj", "u", "j"), ("jc", "j", "u")}
    assert graph.message_graph(users, jobs, rows, include_browsed=True).where("relation = 'cj'").count() == 2


# Propagation ----------------------------------------------------------------------------------


def test_propagation_equals_matrices(spark):
    rng = np.random.default_rng(1)
    edges = {(0, 0), (0, 1), (1, 1), (2, 1), (2, 3)}
    vectors = {f"c:{u}": rng.normal(size=3) for u in range(4)} | {f"j:{j}": rng.normal(size=3) for j in range(5)}
    nodes = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in vectors.items()], "node string, vector array<double>")
    pairs = spark.createDataFrame(sorted(edges) + [(0, 0)], "user_id long, job_id long")
    names = list(vectors)
    a = np.zeros((9, 9))
    for u, j in edges:
        a[names.index(f"c:{u}"), names.index(f"j:{j}")] = a[names.index(f"j:{j}"), names.index(f"c:{u}")] = 1
    degree = np.maximum(a.sum(1), 1)
    a = a / np.sqrt(np.outer(degree, degree))
    x = np.array([vectors[n] for n in names])
    want = (x + a @ x + a @ a @ x) / 3
    got = {r["node"]: r["vector"] for r in propagation.propagate(nodes, pairs, 2, 3).collect()}
    for n, w in zip(names, want):
        assert got[n] == pytest.approx(list(w))
    # isolated nodes shrink, and without any edge the raw vectors can be kept
    assert got["c:3"] == pytest.approx(list(vectors["c:3"] / 3))
    assert propagation.propagate(nodes, pairs.limit(0), 2, 3, keep_raw_without_edges=True).where("node = 'c:3'").first()["vector"] == pytest.approx(list(vectors["c:3"]))


def test_softmax_sums_to_one(spark):
    row = spark.createDataFrame([([1.0, 2.0, 1000.0],), ([],)], "l array<double>").select(propagation.softmax(F.col("l")).alias("s")).collect()
    assert sum(row[0]["s"]) == pytest.approx(1.0) and row[0]["s"][2] == pytest.approx(1.0) and row[1]["s"] == []


def test_attention_and_pooling(spark):
    pairs = spark.createDataFrame([("u", "j", ["a", "b"], ["c", "d"]), ("u", "k", [], [])], "user_id string, job_id string, path_skills array<string>, gap_skills array<string>")
    logits = spark.createDataFrame([("j", "a", 0.0), ("j", "b", math.log(3.0))], "job_id string, skill string, logit double")
    attended = propagation.path_attention(pairs, logits)
    got = {r["job_id"]: {e["skill"]: e["weight"] for e in r["attention"]} for r in attended.collect()}
    assert got == {"j": {"a": pytest.approx(0.25), "b": pytest.approx(0.75)}, "k": {}}
    vectors = spark.createDataFrame([("a", [4.0, 0.0]), ("b", [0.0, 4.0]), ("c", [1.0, 1.0]), ("d", [3.0, 5.0])], "skill string, vector array<double>")
    pooled = {r["job_id"]: (r["path_vector"], r["gap_vector"]) for r in propagation.pooled_paths(attended, vectors, 2).collect()}
    assert pooled["j"] == (pytest.approx([1.0, 3.0]), pytest.approx([2.0, 3.0])) and pooled["k"] == ([0.0, 0.0], [0.0, 0.0])


def test_layer_norm(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(propagation.layer_norm(F.col("v"), 3).alias("n")).first()["n"]
    assert sum(row) == pytest.approx(0.0, abs=1e-9) and row[2] == pytest.approx(1.2247, rel=1e-3)


def test_category_codes_leave_zero_for_unknown(spark):
    values = spark.createDataFrame([("b",), ("a",), ("",), ("b",)], "value string")
    assert {r["value"]: r["code"] for r in rerank.category_codes(values, "value").collect()} == {"a": 1, "b": 2}


def test_pair_model_learns_and_levels_default(spark):
    rows = spark.createDataFrame([(f"u{i}", "j", float(i % 2), float(i % 2) + (i % 5) * 0.01) for i in range(60)], "user_id string, job_id string, label double, x double")
    model = rerank.train_pair_model(rows, ["x"])
    scores = {r["user_id"]: r["score"] for r in rerank.score_pairs(model, rows).collect()}
    assert min(scores[f"u{i}"] for i in range(1, 60, 2)) > max(scores[f"u{i}"] for i in range(0, 60, 2))
    train = spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, job_id string")
    seen = spark.createDataFrame([("u", "a", 3, 1, "train"), ("u", "a", 2, 2, "train"), ("u", "b", 3, 3, "test")], "user_id string, job_id string, level int, row_index long, split string")
    assert {r["job_id"]: r["level"] for r in rerank.pair_levels(train, seen).collect()} == {"a": 2, "b": 2}


def test_pooled_query_takes_all_gaps(spark, monkeypatch):
    from talentweave.registry import knowledge

    skills = [f"s{i:02d}" for i in range(12)]
    rows = spark.createDataFrame([(1, 2, [], skills)], "user_id long, job_id long, attention array<struct<skill:string,weight:double>>, missing_skills array<string>")
    vectors = spark.createDataFrame([(i, [float(i)] * knowledge.DIM) for i in range(12)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(knowledge, "_evidence_v2", lambda spark, d: rows)
    monkeypatch.setattr(knowledge.b, "all_jobs", lambda spark, d: spark.createDataFrame([(skills,)], "skills array<string>"))
    monkeypatch.setattr(knowledge.b, "table", lambda spark, d, name: vectors)
    found = knowledge.pooled_paths(spark, "").where(f"dim >= {knowledge.DIM}").collect()
    assert len(found) == knowledge.DIM and {r.value for r in found} == {5.5}
