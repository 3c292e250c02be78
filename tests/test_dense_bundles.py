"""Groups of items in bundles: few winners leave a task, and the result stays exact."""

import numpy as np
import pyarrow as pa
import pytest

from talentweave.operators import dense


@pytest.mark.parametrize("reached", [None, 0.5])
def test_a_query_gives_its_best_of_a_bundle_not_of_each_group(reached):
    rng = np.random.default_rng(5)
    items = np.round(rng.normal(size=(300, 4)), 2)
    items[20:40] = items[20]
    group = np.repeat(np.arange(30), 10).astype(np.int32)
    rng.shuffle(group)
    ids = rng.permutation(300)
    asks = np.round(rng.normal(size=(25, 4)), 2)
    visits = [sorted(rng.choice(31, size=rng.integers(1, 32), replace=False).tolist()) for _ in asks]
    hidden = [rng.choice(300, size=rng.integers(0, 9), replace=False).tolist() for _ in asks]
    q = pa.table({"id": range(25), "vector": pa.array(asks.tolist()), "threshold": pa.array([reached] * 25, pa.float64()), "groups": pa.array(visits, pa.list_(pa.int32())), "_hidden": pa.array(hidden, pa.list_(pa.int64()))})
    i = pa.table({"id": ids, "vector": pa.array(items.tolist()), "group": group})
    found = dense._bundle_winners(q, i, 5).to_pylist()
    assert len(found) <= 25 * 5
    for a in range(25):
        scored = [(-round(float(asks[a] @ items[b]), 9), int(ids[b])) for b in range(300) if group[b] in visits[a] and ids[b] not in hidden[a]]
        wanted = [s for s in sorted(scored)[:5] if reached is None or -s[0] >= reached]
        got = sorted((-r["score"], r["job_id"]) for r in found if r["user_id"] == a)
        assert [j for _, j in got if reached is None or -_ >= reached] == [j for _, j in wanted]


def test_small_groups_share_a_bundle(spark):
    vectors = np.random.default_rng(1).normal(size=(400, 3))
    frame = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "id long, vector array<double>")
    groups = dense.Groups(dense.grouped_items(frame, 10, 400), 10)
    assert len(groups.names) > 30 and len(set(groups.bundle.tolist())) == 1
    groups.rows = 0
    visits = dense._visits(frame.selectExpr("*", "cast(null as double) threshold"), groups, 5, 0)
    assert visits.count() == visits.select("id").distinct().count() == 400
