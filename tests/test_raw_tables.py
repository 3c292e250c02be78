"""Raw scans, row caps and restricted scans on hand-made files."""

import pytest

from talentweave.operators.interactions import interactions_from_actions
from talentweave.operators.ordering import first_rows
from talentweave.sources import bundle, raw


@pytest.fixture
def table(spark, tmp_path):
    path = tmp_path / "table.txt"
    path.write_bytes(b"\xef\xbb\xbfid\tname\tnote\r\n1\ta\tx\ty\r\n2\tb\r\n\n3\t\xff\xfe\t\\N\n")
    return raw.read_table(spark, str(path))


def test_rows_are_repaired(table):
    rows = {r["row_index"]: r for r in table.collect()}
    assert table.columns == ["id", "name", "note", "row_index"]
    assert rows[0]["note"] == "x\ty"
    assert (rows[1]["name"], rows[1]["note"]) == ("b", "")
    assert rows[2]["id"] == "" and rows[2]["note"] == ""
    assert "�" in rows[3]["name"] and rows[3]["note"] == r"\N"


def test_row_cap_is_a_prefix(table):
    assert sorted(r["id"] for r in first_rows(table, 2).collect()) == ["1", "2"]
    assert first_rows(table, 0).count() == 4


def test_index_follows_file_order_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("id\tv\n" + "".join(f"{i}\tx{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = raw.read_table(spark, str(path))
        assert rows.where("cast(id as long) = row_index").count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_preview(table):
    assert {r["column"]: r["sample"] for r in raw.preview(table).collect()} == {"id": "1", "name": "a", "note": "x\ty"}


def test_scans_restricted_to_actions(spark):
    actions = spark.createDataFrame(
        [("u2", "j9", "1", "0", "0", 0), ("u1", "j2", "0", "1", "0", 1), ("", "j1", "1", "0", "0", 2), ("u3", "j1", "0", "0", "0", 3)],
        "user_id string, jd_no string, browsed string, delivered string, satisfied string, row_index long",
    )
    seen = interactions_from_actions(actions, strict=False, keep_zero=True)
    assert {(r["user_id"], r["level"]) for r in seen.collect()} == {("u2", 1), ("u1", 2), ("u3", 0)}
    users = spark.createDataFrame(
        [("u1", "first", 0), ("u4", "x", 1), ("u2", "y", 2), ("u1", "last", 3), ("u3", "z", 4)], "user_id string, live_city_id string, row_index long"
    )
    found = {r["user_id"]: r["live_city_id"] for r in raw.users_in_actions(users, seen, 2).collect()}
    assert found == {"u1": "last", "u2": "y"}
    jobs = spark.createDataFrame([(f"j{i}", i) for i in range(12)], "jd_no string, row_index long")
    assert {r["jd_no"] for r in raw.jobs_for_actions(jobs, seen, None).collect()} == {"j1", "j2", "j9"}
    assert {r["jd_no"] for r in raw.jobs_for_actions(jobs, seen, 4).collect()} == {"j0", "j1", "j2", "j3"}


def test_filler_stops_where_demand_goes_on(spark, monkeypatch):
    monkeypatch.setattr(raw, "FILLER_JOBS", 2)
    seen = spark.createDataFrame([("u", "j7")], "user_id string, job_id string")
    jobs = spark.createDataFrame([(f"j{i}", i) for i in range(10)], "jd_no string, row_index long")
    assert {r["jd_no"] for r in raw.jobs_for_actions(jobs, seen, 5).collect()} == {"j0", "j1", "j7"}


def test_occupation_reference(spark, tmp_path):
    path = tmp_path / "reference.json"
    path.write_text(
        '{"career_categories": ["工程技术人员", ""], "occupation_terms": ["厨师"],\n "occupations": [{"name": "计算机程序设计员", "careerName": null,'
        ' "works": [{"name": "低代码开发员"}], "task": "编写代码；测试"}, "电工"],\n "standards": [{"name": "4-04-05-01-焊工（试行）"}, "钳工2019年版"]}',
        encoding="utf-8",
    )
    terms = {(r["kind"], r["term"]) for r in bundle.read_reference(spark, str(path)).collect()}
    assert terms == {
        ("category", "工程技术人员"), ("occupation", "厨师"), ("occupation", "计算机程序设计员"), ("occupation", "电工"),
        ("work_type", "低代码开发员"), ("task", "编写代码"), ("task", "测试"), ("standard", "焊工"), ("standard", "钳工"),
    }


def test_missing_or_malformed_rankings_are_empty(spark, tmp_path):
    assert bundle.read_rankings(spark, str(tmp_path / "none")).count() == 0
    spark.range(2).write.parquet(str(tmp_path / "other"))
    assert bundle.read_rankings(spark, str(tmp_path / "other")).count() == 0


def test_graph_stats_file(spark, tmp_path):
    path = tmp_path / "stats.csv"
    path.write_text("﻿item,count\nusers,4.0\njobs,\n", encoding="utf-8")
    assert {r["item"]: r["count"] for r in bundle.read_graph_stats(spark, str(path)).collect()} == {"users": 4, "jobs": 0}


def test_vectors_are_keyed_by_id(spark, tmp_path):
    for name in ("user", "job", "skill"):
        spark.createDataFrame([(name, [1.0, 2.0])], "id string, vector array<double>").write.parquet(str(tmp_path / f"emb_{name}"))
    vectors = bundle.read_vectors(spark, str(tmp_path))
    assert {k: v.first()["id"] for k, v in vectors.items()} == {"user": "user", "job": "job", "skill": "skill"}
