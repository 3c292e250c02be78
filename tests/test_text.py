"""Text and field expressions against expected values."""

import pytest
from pyspark.sql import functions as F

from talentweave.functions import fields, text


def evaluate(spark, build, value):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("  a b　", "a b"), ("-", ""), ("-1", ""), ("NULL", ""), ("None", ""), ("NaN", ""), (r"\N", ""), (None, ""), ("\x1cx\x85", "x"), ("nano", "nano")],
)
def test_normalize_value(spark, value, expected):
    assert evaluate(spark, text.normalize_value, value) == expected


def test_null_marker_can_be_kept(spark):
    assert evaluate(spark, lambda c: text.normalize_value(c, keep_null_marker=True), r"\N") == r"\N"


def test_clean_token_variants(spark):
    assert evaluate(spark, text.clean_token, " 【C++】　") == "c++"
    assert evaluate(spark, lambda c: text.clean_token(c, lower_ascii=False), "（Java EE）。") == "JavaEE"
    assert evaluate(spark, text.clean_token, "Java 开发") == "Java开发"


def test_multi_values_are_distinct_in_order(spark):
    assert evaluate(spark, text.split_multi_value, "B|a，A、；b/-1") == ["b", "a"]
    assert evaluate(spark, lambda c: text.split_multi_value(c, lower_ascii=False), "B|b|B") == ["B", "b"]
    assert evaluate(spark, text.split_multi_value, "null") == []


def test_tags_need_two_characters(spark):
    assert evaluate(spark, text.split_tags, "c|Go|go|沟通|—") == ["go", "沟通"]


def test_skill_tokens(spark):
    value = "熟练|Python/Java，职责;中|9|" + "长" * 33 + "|PYTHON"
    assert evaluate(spark, text.extract_skill_tokens, value) == ["python", "java", "9"]
    assert evaluate(spark, lambda c: text.extract_skill_tokens(c, 1), value) == ["python"]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Python 3.11 开发", ["python", "3.11", "开发"]),
        ("一二三四五六", ["一二三四五六"]),
        ("一二三四五六七", ["一二", "二三", "三四", "四五", "五六", "六七", "一二三", "二三四", "三四五", "四五六", "五六七"]),
        ("熟悉Spark大数据", ["spark", "熟悉", "大数据"]),
        ("für é", ["für"]),
        ("a　b,cd cd", ["cd"]),
        ("（C#）", ["c#"]),
        ("nan", []),
        ("", []),
    ],
)
def test_tokenize(spark, value, expected):
    assert evaluate(spark, text.tokenize_text, value) == expected


def test_tokenize_keeps_repeats_on_request(spark):
    assert evaluate(spark, lambda c: text.tokenize_text(c, distinct=False), "ab ab cd") == ["ab", "ab", "cd"]
    assert evaluate(spark, lambda c: text.tokenize_text(c, 1), "ab ab cd") == ["ab"]


@pytest.mark.parametrize(("value", "rank"), [("本科及以上", 5), ("mba", 7), ("博士", 8), ("高中/中专", 2), ("", 0), ("其他", 0)])
def test_degree_rank(spark, value, rank):
    assert evaluate(spark, fields.degree_rank, value) == rank


@pytest.mark.parametrize(
    ("value", "years"), [("5-10年", 5.0), ("305", 3.05), ("199801", 1998.01), ("2015", 9.0), ("2030", 0.0), ("-1", 0.0), ("无", 0.0), ("100", 100.0), ("１２年", 12.0)]
)
def test_parse_years(spark, value, years):
    assert evaluate(spark, lambda c: fields.parse_years(c, 2024), value) == pytest.approx(years)


def test_behaviour_level_flags(spark):
    rows = spark.createDataFrame([("1", "0", "0"), ("1", "true", ""), ("1", "1", "1.0"), ("0", None, "x")], "b string, d string, s string")
    loose = [r[0] for r in rows.select(fields.behaviour_level(F.col("b"), F.col("d"), F.col("s"))).collect()]
    strict = [r[0] for r in rows.select(fields.behaviour_level(F.col("b"), F.col("d"), F.col("s"), strict=True)).collect()]
    assert loose == [1, 2, 3, 0] and strict == [1, 1, 2, 0]


def test_standard_names_and_phrases(spark):
    assert evaluate(spark, text.standard_name, "4-04-05-01-计算机程序设计员（试行）2019年版") == "计算机程序设计员"
    assert evaluate(spark, text.standard_name, "电工_201901.pdf") == "电工_201901"
    assert evaluate(spark, text.task_phrases, "编写代码；测 试，a。Deploy") == ["编写代码", "测试", "deploy"]


def test_html_and_whitespace(spark):
    assert evaluate(spark, text.escape_html, "<a & 'b' \"c\">") == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"
    assert evaluate(spark, text.squeeze_whitespace, "  a 　 b\n\tc ") == "a b c"
    assert evaluate(spark, text.squeeze_whitespace, None) == ""
