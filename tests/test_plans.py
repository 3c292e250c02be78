"""Whole runs on small data, sinks, the registry, and the shape of physical plans."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from talentweave import bindings, registry
from talentweave.operators import taxonomy
from talentweave.operators.vocabulary import SkillGate
from talentweave.plans import experiments, records
from talentweave.sources import bundle, sinks


def test_queries_and_sql_fit_together():
    queries, statements = registry.all_queries(), registry.all_sql()
    assert set(statements) <= set(queries) and len(queries) > 100
    assert entry_module.queries().keys() >= queries.keys() and entry_module.oracle_sql().keys() >= statements.keys()


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["user_id", "job_id", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", ["leave_last_out", "match_evidence_v2", "graph_edges", "pair_features_v2", "dictionary_matches", "rule_ranking"])
def test_no_cross_products(spark, small_dir, name):
    plan = registry.all_queries()[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark, small_dir):
    plan = registry.all_queries()["behaviour_levels"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in plan
    top = registry.all_queries()["leave_last_out"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top


def test_preprocess_and_round_trip(spark, tmp_path):
    users = spark.createDataFrame(
        [("u1", "530", "530,531", "算法", "python|sql|沟通|or", "本科", "2020", 0), ("u2", "1", "", "", "python|sql", "", "", 1)],
        "user_id string, live_city_id string, desire_jd_city_id string, desire_jd_type_id string, experience string, cur_degree_id string, start_work_date string, row_index long",
    )
    jobs = spark.createDataFrame(
        [("j1", "python 工程师", "530", "算法", "熟悉 python 与 sql", "本科", "3", 0), ("j2", "司机", "", "", "mysql", "", "", 1), ("j3", "无人问津", "", "", "", "", "", 2)],
        "jd_no string, jd_title string, city string, jd_sub_type string, job_description string, min_edu_level string, min_years string, row_index long",
    )
    actions = spark.createDataFrame(
        [("u1", "j1", "1", "1", "0", 0), ("u1", "j2", "1", "0", "1", 1), ("u1", "j1", "0", "1", "0", 2), ("u2", "j2", "1.0", "0", "0", 3), ("u9", "j1", "1", "0", "0", 4), ("u2", "j1", "1", "0", "0", 5)],
        "user_id string, jd_no string, browsed string, delivered string, satisfied string, row_index long",
    )
    tables = records.preprocess(users, jobs, actions, 2024, SkillGate(), min_count=2)
    sinks.write_processed(tables, str(tmp_path))
    back = bundle.read_processed(spark, str(tmp_path))
    assert {r["skill"]: r["skill_id"] for r in back["skill_vocab"].collect()} == {"python": 0, "sql": 1}
    first = back["users"].where("user_id = 'u1'").first()
    assert first["skill_ids"] == [0, 1] and first["years"] == 4.0 and first["degree_rank"] == 5 and first["text"] == "python sql 沟通 算法 本科"
    job = {r["job_id"]: r for r in back["jobs"].collect()}
    assert set(job) == {"j1", "j2"} and job["j1"]["skill_ids"] == [0, 1] and job["j1"]["skill_weights"] == pytest.approx([4.8, 1.3])
    assert job["j2"]["skill_ids"] == []  # sql inside mysql does not count
    split = {r["row_index"]: r["split"] for r in back["interactions"].collect()}
    assert split == {0: "train", 1: "valid", 2: "test", 5: "train"}
    meta = {r["item"]: r["value"] for r in tables["meta"].collect()}
    assert meta["positives"] == 3 and meta["avg_job_skills"] == 1.0
    documents = [json.loads(line) for f in (tmp_path / "meta").glob("*.json") for line in f.read_text().splitlines()]
    assert {d["item"] for d in documents} == set(meta)


def test_first_generation_records(spark):
    raw = spark.createDataFrame([(" u1 ", "AI|数据", "算法", "互联网", "互联网", "工程", "1990")], "user_id string, experience string, desire_jd_type_id string, desire_jd_industry_id string, cur_industry_id string, cur_jd_type string, start_work_date string")
    row = records.candidates_v1(raw, 2024).first()
    assert row["industries"] == ["互联网", "互联网"] and row["text"] == "AI|数据 算法 互联网 互联网 工程" and row["skills"] == ["ai", "数据"] and row["years"] == 34.0


def test_unknown_model(spark, small_dir):
    with pytest.raises(ValueError, match="unknown model"):
        experiments.run_model("magic", bindings.bundle(spark, small_dir))


def test_excluded_pairs_never_rank(spark, small_dir):
    data = bindings.bundle(spark, small_dir)
    for name in ("popularity", "rule", "bm25"):
        ranked = experiments.run_model(name, data, topn=30)
        assert ranked.join(data.hidden(), ["user_id", "job_id"]).count() == 0
        assert ranked.groupBy("user_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).where("m <> n").count() == 0


def test_graph_models_rank_every_test_user(spark, small_dir):
    data = bindings.bundle(spark, small_dir)
    ranked = experiments.run_model("two_stage", data, topn=20, recall_k=10, dim=8)
    assert ranked.select("user_id").distinct().count() == data.test_users().count()
    assert ranked.join(data.hidden(), ["user_id", "job_id"]).count() == 0


def test_graph_model_ranks_every_job(spark, small_dir):
    data = bindings.bundle(spark, small_dir)
    ranked = experiments.run_model("graph", data, dim=8)
    jobs = data.jobs.count()
    hidden = data.hidden().join(data.jobs, "job_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("h"))
    places = ranked.groupBy("user_id").agg(F.count("*").alias("n")).join(hidden, "user_id", "left").fillna(0)
    assert places.where(F.col("n") + F.col("h") != jobs).count() == 0


def test_a_cycle_in_the_taxonomy_raises(spark):
    rows = [("r", None, "root"), ("a", "r", "A"), ("x", "y", "X"), ("y", "x", "Y")]
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.flatten_tree(spark.createDataFrame(rows, "career_code string, parent_code string, name string"))


def test_metrics_table_unites_columns(spark, tmp_path):
    a, b = spark.createDataFrame([("x", 1.0)], "model string, z double"), spark.createDataFrame([("y", 2.0)], "model string, a double")
    table = sinks.metrics_table(a, b)
    assert table.columns == ["a", "model", "z"]
    sinks.write_metrics(table, str(tmp_path))
    rows = spark.read.option("header", True).csv(str(tmp_path / "metrics_csv")).collect()
    assert {(r["model"], r["a"], r["z"]) for r in rows} == {("x", None, "1.0"), ("y", "2.0", None)}


def test_samples_and_user_ndcg(spark, tmp_path):
    ranked = spark.createDataFrame([(f"u{u}", f"j{r}", r) for u in range(7) for r in range(1, 13)], "user_id string, job_id string, rank int")
    sample = {r["user_id"]: r["job_ids"] for r in sinks.prediction_sample(ranked).collect()}
    assert sorted(sample) == [f"u{i}" for i in range(5)] and sample["u0"] == [f"j{i}" for i in range(1, 11)]
    sinks.write_prediction_sample(ranked, str(tmp_path / "sample"))
    ndcg = spark.createDataFrame([("m", 1, "b", 0.5), ("m", 1, "a", 0.25)], "model string, seed int, user_id string, ndcg double")
    sinks.write_user_ndcg(ndcg, str(tmp_path / "ndcg"))
    assert spark.read.parquet(str(tmp_path / "ndcg")).where("model = 'm' and seed = 1").count() == 2


def test_taxonomy(spark):
    nodes = spark.createDataFrame([("1", None, "root"), ("1-1", "1", "mid"), ("1-1-1", "1-1", "leaf"), ("9", "8", "stray")], "career_code string, parent_code string, name string")
    got = {r["career_code"]: (r["path"], r["has_children"]) for r in taxonomy.flatten_tree(nodes).collect()}
    assert got == {"1": (["root"], True), "1-1": (["root", "mid"], True), "1-1-1": (["root", "mid", "leaf"], False), "9": (["stray"], False)}
    rows = spark.createDataFrame([("a", 1, "old", 0), ("a", 1, "new", 1), ("", 1, "x", 2), ("b", None, "y", 3)], "career_code string, version_id int, name string, row_index long")
    assert [r["name"] for r in taxonomy.latest_occupations(rows).collect()] == ["new"]


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """Rounds grow with the logarithm of the depth; a cycle below a chain raises."""
    from talentweave.operators import taxonomy

    written = []
    cut = taxonomy.cut_lineage
    monkeypatch.setattr(taxonomy, "cut_lineage", lambda df: written.append(1) or cut(df))
    n = 300
    chain = [(f"c{i}", f"c{i - 1}" if i else None, f"n{i}") for i in range(n)] + [("other", "gone", "o"), ("leaf", "c7", "l")]
    frame = spark.createDataFrame(chain, "career_code string, parent_code string, name string")
    got = {r.career_code: (r.path, r.has_children) for r in taxonomy.flatten_tree(frame).collect()}
    assert len(got) == len(chain) and got["other"] == (["o"], False) and got["leaf"] == ([*[f"n{i}" for i in range(8)], "l"], False)
    assert got[f"c{n - 1}"] == ([f"n{i}" for i in range(n)], False) and got["c0"][1]
    assert len(written) <= 3 + 2 * 9  # 9 doublings for the pointers and as many for the paths
    loop = [("x", "y", "x"), ("y", "x", "y"), ("under", "x", "u")]
    with pytest.raises(ValueError):
        taxonomy.flatten_tree(spark.createDataFrame(chain[:5] + loop, "career_code string, parent_code string, name string"))
