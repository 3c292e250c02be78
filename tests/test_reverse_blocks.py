"""Pages found with matrices of values, and pages of an order that all requests share, against a plain sort."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentweave.functions.features import pair_features_v1, rule_score_v1
from talentweave.operators import reverse, scoring
from talentweave.operators.topk import term_keys

PEOPLE = 700


def _age(user: int):
    return None if user % 11 == 0 else float("nan") if user % 13 == 0 else float(user * 7 % 40)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i * 3, _age(i), i % 10) for i in range(PEOPLE)]
    return spark.createDataFrame(rows, "user_id long, age double, level long").repartition(3)


@pytest.mark.parametrize("values", [True, False])
def test_pages_equal_a_plain_sort(spark, people, values):
    calls = spark.sparkContext.accumulator(0)
    asked = [(f"{by}:{wish}:{page}", by, wish, page, 30) for by in ("age", "near") for wish in (2, 9) for page in (1, 9, 24)]
    requests = spark.createDataFrame(asked, "request_id string, sort_by string, wish long, page int, page_size int")
    near = -F.abs(F.col("level") - F.col("wish")).cast("double")

    def score(rows):
        value = F.when(F.col("sort_by") == "age", F.col("age")).otherwise(near)
        return rows.select("request_id", "user_id", "place", near.alias("near"), value.alias("value"))

    def block(q, i):
        calls.add(q.num_rows)
        wish, level = (t.column(c).to_numpy().astype(float) for t, c in ((q, "wish"), (i, "level")))
        return lambda a, b: -np.abs(level[None, :] - wish[a:b, None])

    found: dict[str, list] = {}
    options = {"values": block} if values else {}
    for r in reverse.candidate_pages(requests, people, score, block=4, bins=8, few=20, own_order={"age": "age"}, **options).collect():
        assert r.near == -abs(r.user_id // 3 % 10 - r.wish) and (r.total, r.total_pages) == (PEOPLE, 24)
        found.setdefault(r.request_id, []).append((r.place, r.user_id))

    def key(by, wish, i):
        a = _age(i)
        return (a is None or a != a, -a if a and a == a else 0.0, i) if by == "age" else (abs(i % 10 - wish), i)

    for name, by, wish, page, size in asked:
        order = sorted(range(PEOPLE), key=lambda i, by=by, wish=wish: key(by, wish, i))[(page - 1) * size : page * size]
        wanted = [((page - 1) * size + 1 + at, i * 3) for at, i in enumerate(order)]
        assert sorted(found.get(name, [])) == wanted, name
    assert (calls.value > 0) == values


def test_only_pages_are_scored_where_the_order_is_shared(spark, people):
    met = spark.sparkContext.accumulator(0)

    def seen(x):
        met.add(1)
        return x

    requests = spark.createDataFrame([(str(i), "age", 3, 20) for i in range(5)], "request_id string, sort_by string, page int, page_size int")
    mark = F.udf(seen, "double")
    pages = reverse.candidate_pages(requests, people, lambda r: r.select("request_id", "user_id", "place", mark("age").alias("value")), own_order={"age": "age"})
    assert pages.count() == 100
    pages.collect()
    assert met.value <= 1000  # not 5 * 700 in each pass


def test_block_score_equals_the_expression(spark):
    draw = random.Random(3)
    words, cities = [f"w{i}" for i in range(12)], ["a", "b", "c"]
    some = lambda xs, n: draw.sample(xs, draw.randint(0, n))
    users = [(i, some(words, 6), some(cities, 1), some(cities, 2), some(words[:4], 3), draw.choice([None, 1, 4]), draw.choice([None, 0.0, 3.0])) for i in range(60)]
    jobs = [(f"j{i}", None if i == 5 else some(words, 5), draw.choice([None, *cities]), draw.choice([None, "", "1", "3"]), draw.choice([1, 3, None]), draw.choice([0.0, 2.0, None]), draw.choice([None, "", *words[:4]])) for i in range(30)]
    i = spark.createDataFrame(users, "place long, skills array<string>, city_ids array<string>, desired_city_ids array<string>, desired_types array<string>, degree_rank int, years double")
    q = spark.createDataFrame(jobs, "request_id string, job_skills array<string>, job_city string, job_min_degree string, job_min_degree_rank int, job_min_years double, job_job_type string")
    wanted = {(r.request_id, r.place): r.s for r in q.crossJoin(i).select("*", *pair_features_v1()).select("request_id", "place", rule_score_v1().alias("s")).collect()}

    def keys(values):
        return term_keys(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())))

    right = i.withColumns({"skill_keys": keys(F.col("skills")), "city_keys": keys(F.concat("city_ids", "desired_city_ids")), "type_keys": keys(F.col("desired_types"))}).toArrow()
    left = q.withColumns({
        "skill_keys": keys(F.col("job_skills")), "city_keys": keys(F.array("job_city")), "type_keys": keys(F.array(F.nullif("job_job_type", F.lit("")))),
        "n_skills": F.size(F.array_distinct("job_skills")), "degree_stated": F.coalesce((F.col("job_min_degree") != "").cast("int"), F.lit(0)),
    }).toArrow()
    rows = scoring.rule_scores_v1_block(left, right)
    got = np.vstack([rows(0, 7), rows(7, 30)])
    for a, name in enumerate(left.column("request_id").to_pylist()):
        for b, place in enumerate(right.column("place").to_pylist()):
            expected = wanted[name, place]
            assert np.isnan(got[a, b]) if expected is None else got[a, b] == pytest.approx(expected, abs=1e-12)
