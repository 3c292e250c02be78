"""Whole runs compute each of their tables once (F10, F16, F19, F20)."""

import gzip

from pyspark.sql import functions as F

from talentweave import bindings
from talentweave.operators import graph, negatives
from talentweave.plans import records
from talentweave.sources import sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def raw(spark):
    users = spark.createDataFrame([("u1", "a,b", "x|yy", 0), ("u2", "", "yy|zz", 1), ("u1", "c", "zz", 2)], "user_id string, desire_jd_city_id string, experience string, row_index long")
    jobs = spark.createDataFrame([("j1", "yy dev", "a", 0), ("j2", "zz", "", 1)], "jd_no string, jd_title string, city string, row_index long")
    actions = spark.createDataFrame([("u1", "j1", "1", "0", "0", 0), ("u2", "j2", "0", "1", "0", 1)], "user_id string, jd_no string, browsed string, delivered string, satisfied string, row_index long")
    return users, jobs, actions


def counted(df, spark, column):
    """The table with a counter of how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.coalesce(1).mapInArrow(count, df.schema), seen


def test_graph_reads_its_tables_once(spark, tmp_path):
    users, jobs, actions = raw(spark)
    jobs = jobs.withColumn("job_description", F.lit(""))
    users, seen = counted(users, spark, "user_id")
    built = graph.build_graph(users, jobs, actions)
    sinks.write_graph(built, str(tmp_path / "g"))
    assert seen.value == 3
    stats = {r["item"]: int(r["count"]) for r in spark.read.option("header", True).csv(str(tmp_path / "g" / "stats_csv")).collect()}
    assert stats["users"] == 3 and stats["jobs"] == 2 and stats["cities"] == 3
    edges = spark.read.parquet(str(tmp_path / "g" / "edges"))
    assert edges.count() == stats["edges"] == spark.read.option("header", True).csv(str(tmp_path / "g" / "edges_csv")).count()
    assert edges.where("relation = 'DESIRES_CITY'").count() == 3


def test_processed_tables_read_theirs_once(spark, tmp_path):
    users, jobs, actions = raw(spark)
    users, seen = counted(users, spark, "user_id")
    names = ["live_city_id", "desire_jd_type_id", "desire_jd_industry_id", "cur_industry_id", "cur_degree_id", "start_work_date", "cur_jd_type"]
    users = users.withColumns({c: F.lit("") for c in names})
    jobs = jobs.withColumns({c: F.lit("") for c in ("jd_sub_type", "job_description", "min_edu_level", "min_years")})
    tables = records.preprocess(users, jobs, actions, 2024, min_count=1)
    sinks.write_processed(tables, str(tmp_path / "p"))
    assert seen.value == 3
    assert spark.read.parquet(str(tmp_path / "p" / "users")).count() == 2


def test_explanations_are_compressed(spark, tmp_path):
    rows = spark.createDataFrame([(i, "same words " * 50) for i in range(100)], "user_id long, text string")
    sinks.write_explanations(rows, str(tmp_path / "e"))
    files = list((tmp_path / "e").glob("part-*"))
    assert sum(len(gzip.open(f).readlines()) for f in files) == 100
    assert sum(f.stat().st_size for f in files) < 100 * 550 / 4
    assert spark.read.text(str(tmp_path / "e")).where("value like '%same words%'").count() == 100


def test_a_search_is_run_once(spark):
    """Semantic negatives are met twice by a draw; the search behind them runs once."""
    pairs = spark.createDataFrame([(1, 10)], "user_id long, job_id long")
    uniform = spark.createDataFrame([(1, 10, 0, 20)], "user_id long, job_id long, draw int, negative_id long")
    semantic, seen = counted(spark.createDataFrame([(1, 30, 0.5, 1), (1, 31, 0.4, 2)], "user_id long, job_id long, score double, rank int"), spark, "user_id")
    structural = spark.createDataFrame([(1, 10, 40)], "user_id long, job_id long, negative_id long")
    got = negatives.mixed_negatives(pairs, uniform, semantic, structural, 5, 3, 7).collect()
    assert len(got) == 1 and got[0]["source"] in ("semantic", "structural", "uniform")
    assert seen.value == 2


def test_bundle_parses_actions_once(spark, small_dir, monkeypatch):
    """the profiles, the catalogue and the split share the written behaviour."""
    calls = []
    levels = bindings.levels
    monkeypatch.setattr(bindings, "levels", lambda *a: calls.append(a) or levels(*a))
    found = bindings.bundle(spark, small_dir)
    bindings.node_vectors(spark, small_dir, found)
    assert len(calls) == 1
