"""Pages from codes of values: equal a plain sort, one count for both ends, and few users met once a range is cut by place."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talentweave.operators import reverse, scoring

PEOPLE = 900


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i * 5, i * 7 % 10, f"x{i}") for i in range(PEOPLE)], "user_id long, level long, name string").repartition(6)


def _score(rows):
    near = F.when(F.col("wish") == 5, 3.0).otherwise(-F.abs(F.col("level") - F.col("wish"))).cast("double")
    return rows.select("request_id", "user_id", "place", "name", near.alias("value"))


def _near(user, wish):
    return 3.0 if wish == 5 else -float(abs(user * 7 % 10 - wish))


def _block(cells):
    def block(q, i):
        assert i.column_names == ["place", "level"]
        cells.add(q.num_rows * i.num_rows)
        wish, level = (t.column(c).to_numpy() for t, c in ((q, "wish"), (i, "level")))

        def rows(a, b):
            table = np.where(wish[a:b, None] == 5, 3.0, -np.abs(np.arange(10.0) - wish[a:b, None]))
            return np.repeat(level[None, :].astype(np.uint8), b - a, axis=0), table

        return rows

    return block


@pytest.mark.parametrize("limits", [None, (-9, 3)])
def test_codes_give_the_same_pages(spark, people, limits):
    asked = [(f"{wish}:{page}:{size}", wish, page, size) for wish in (0, 4, 5) for page, size in ((1, 7), (13, 20), (2, 299), (45, 20), (46, 20), (1, 2000))]
    requests = spark.createDataFrame(asked, "request_id string, wish long, page int, page_size int")
    found: dict[str, list] = {}
    pages = reverse.candidate_pages(requests, people, _score, block=7, bins=8, few=20, values=_block(spark.sparkContext.accumulator(0)), reads=["level"], limits=limits)
    for r in pages.collect():
        assert (r.value, r.name, r.total) == (_near(r.user_id // 5, r.wish) if "wish" in r else r.value, f"x{r.user_id // 5}", PEOPLE)
        found.setdefault(r.request_id, []).append((r.place, r.user_id, r.value))
    for name, wish, page, size in asked:
        order = sorted(range(PEOPLE), key=lambda i, wish=wish: (-_near(i, wish), i))[(page - 1) * size : page * size]
        assert sorted(found.get(name, [])) == [((page - 1) * size + 1 + at, i * 5, _near(i, wish)) for at, i in enumerate(order)], name


def test_a_range_of_places_meets_only_its_users(spark, people):
    cells = spark.sparkContext.accumulator(0)
    requests = spark.createDataFrame([(str(page), 5, page, 10) for page in (1, 30, 77)], "request_id string, wish long, page int, page_size int")
    pages = reverse.candidate_pages(requests, people, _score, bins=8, few=4, values=_block(cells), reads=["level"], limits=(-9, 3))
    assert pages.count() == 30
    # one pass by value and one by place in full, the others over one or two of the four tasks' users
    assert cells.value < 3.6 * 3 * PEOPLE


@pytest.mark.parametrize("most", [0, 512])
def test_conditions_and_counts_without_dense_terms(monkeypatch, most):
    monkeypatch.setattr(scoring, "DENSE_TERMS", most)
    rng = np.random.default_rng(4)
    some = lambda n, top: [sorted(rng.choice(top, rng.integers(0, n + 1), replace=False).tolist()) for _ in range(40)]
    kinds = pa.list_(pa.int64())
    skills, asked, cities, city = some(9, 12), some(6, 12), some(3, 5), some(1, 5)
    rank, years, need, least = (rng.integers(0, 5, 40) for _ in range(4))
    users = pa.table({"skill_keys": pa.array(skills, kinds), "city_keys": pa.array(cities, kinds), "type_keys": pa.array(skills, kinds), "degree_rank": rank, "years": years.astype(float)})
    jobs = pa.table({
        "skill_keys": pa.array(asked, kinds), "city_keys": pa.array(city, kinds), "type_keys": pa.array(asked, kinds), "n_skills": [len(x) for x in asked],
        "degree_stated": [1] * 40, "job_min_degree_rank": need, "job_min_years": least.astype(float),
    })
    w = scoring.RULE_V1_WEIGHTS
    got = scoring.rule_scores_v1_block(jobs, users)(10, 30)
    for a in range(10, 30):
        for b in range(40):
            n, all_ = len(set(asked[a]) & set(skills[b])), len(asked[a])
            wanted = (
                w["coverage"] * n / max(1, all_) + w["missing"] * (1 - (all_ - n) / max(1, all_)) + w["city"] * bool(set(city[a]) & set(cities[b]))
                + w["education"] * (rank[b] >= need[a]) + w["experience"] * (least[a] != 0 and years[b] >= least[a]) + w["type"] * (n > 0) + w["paths"] * np.log1p(n)
            )
            assert got[a - 10, b] == pytest.approx(wanted, abs=1e-12)
