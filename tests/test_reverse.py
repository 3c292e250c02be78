"""Pages of a job's users against a plain sort: ties, unknown values, deep pages, several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from talentweave.operators import reverse

PEOPLE = 3000


def _value(user: int, shape: str):
    drawn = random.Random(f"{user}:{shape}").random()
    if shape == "ties":  # a third of all users share one value
        return 5.0 if drawn < 0.34 else float(int(drawn * 10))
    if shape == "uneven":  # a few values are far away from all others
        return 1e12 if user % 997 == 0 else drawn**8
    if shape == "unknown":
        return None if drawn < 0.5 else float("nan") if drawn < 0.6 else drawn
    return 1.0


SHAPES = ["ties", "uneven", "unknown", "one"]


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i * 7, *[_value(i, s) for s in SHAPES]) for i in range(PEOPLE)]
    return spark.createDataFrame(rows, "user_id long, " + ", ".join(f"{s} double" for s in SHAPES)).repartition(5)


def _score(rows):
    value = F.lit(None).cast("double")
    for s in SHAPES:
        value = F.when(F.col("shape") == s, F.col(s)).otherwise(value)
    return rows.select("request_id", "user_id", "place", value.alias("value"))


def _wanted(shape: str, page: int, size: int) -> list[int]:
    def key(i):
        v = _value(i, shape)
        return (v is None or v != v, -(v or 0.0) if v == v else 0.0, i)

    return [i * 7 for i in sorted(range(PEOPLE), key=key)][(page - 1) * size : page * size]


def test_pages_equal_a_plain_sort(spark, people):
    asked = [(f"{s}:{page}", s, page, size) for s in SHAPES for page, size in ((1, 10), (60, 25), (150, 20), (1, PEOPLE + 5), (151, 20), (7, 399))]
    asked = [(f"{r}:{z}", s, p, z) for r, s, p, z in asked]
    requests = spark.createDataFrame(asked, "request_id string, shape string, page int, page_size int")
    got: dict[str, list] = {}
    for r in reverse.candidate_pages(requests, people, _score, block=10, bins=8, few=20).collect():
        got.setdefault(r.request_id, []).append((r.place, r.user_id, r.total, r.total_pages))
    for request, shape, page, size in asked:
        wanted = _wanted(shape, page, size)
        found = sorted(got.get(request, []))
        assert [f[1] for f in found] == wanted, request
        assert [f[0] for f in found] == list(range((page - 1) * size + 1, (page - 1) * size + 1 + len(wanted)))
        assert {f[2:] for f in found} <= {(PEOPLE, -(-PEOPLE // size))}


def test_nothing_asked_or_nobody_there(spark, people):
    requests = spark.createDataFrame([("a", "one", 1, 10)], "request_id string, shape string, page int, page_size int")
    assert reverse.candidate_pages(requests.limit(0), people, _score).count() == 0
    assert reverse.candidate_pages(requests, people.limit(0), _score).count() == 0
    with pytest.raises(ValueError, match="two parts"):
        reverse.candidate_pages(requests, people, _score, bins=1)
