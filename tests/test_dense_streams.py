"""Dense search in tasks that read all items block by block: no vector is copied, rounds and merges stay exact."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talentweave.operators import dense, streams


def _frame(spark, vectors, ids=None):
    rows = [(int(n), [float(x) for x in v]) for n, v in zip(range(len(vectors)) if ids is None else ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def test_every_task_reads_all_blocks_in_each_pass(spark, monkeypatch):
    monkeypatch.setattr(streams, "BLOCK_BYTES", 200)
    left = streams.packed(spark.range(0, 500, 1, 3), "left")
    right = streams.packed(spark.range(500, 530, 1, 2).withColumnRenamed("id", "other"), "right")

    def task(number, passes):
        for at, blocks in passes:
            if number == 2 and at == 1:  # ends early
                break
            met = [(name, x) for name, block in blocks for x in block.column(0).to_pylist()]
            yield pa.table({"task": [number], "at": [at], "left": [sum(x for name, x in met if name == "left")], "right": [sum(x for name, x in met if name == "right")]})

    got = streams.unpacked(spark, streams.streamed([left, right], 3, 2, task), "task long, at long, left long, right long").collect()
    wanted = (sum(range(500)), sum(range(500, 530)))
    assert sorted((r.task, r.at) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert {(r.left, r.right) for r in got} == {wanted}


@pytest.mark.parametrize("query_rows", [5, 1000])
def test_items_are_written_once_whatever_the_tasks(spark, monkeypatch, query_rows):
    sent = Counter()

    def counted(rows, source):
        sent[source] += rows.count()
        return streams.packed(rows, source)

    monkeypatch.setattr(dense, "packed", counted)
    vectors = np.random.default_rng(2).normal(size=(150, 4))
    rows = _frame(spark, vectors)
    own = rows.select(F.col("id").alias("user_id"), F.col("id").alias("job_id"))
    got = dense.dense_rankings(rows, rows, 6, own, query_block_rows=query_rows, item_block_rows=20).collect()
    assert sent == {"items": 150, "hidden": 150}  # before, once for each slice of the queries and each round
    cells = vectors @ vectors.T
    np.fill_diagonal(cells, -np.inf)
    wanted = np.argsort(-cells, axis=1)[:, :6]
    assert {(r.user_id, r.rank): r.job_id for r in got} == {(u, k + 1): wanted[u, k] for u in range(150) for k in range(6)}


@pytest.mark.parametrize("kept", [1, 10**6])
def test_a_task_merges_its_winners(monkeypatch, kept):
    monkeypatch.setattr(dense, "KEPT", kept)
    rng = np.random.default_rng(8)
    items, asks = np.round(rng.normal(size=(90, 3)), 1), np.round(rng.normal(size=(12, 3)), 1)
    group = np.sort(rng.integers(0, 9, 90)).astype(np.int32)
    groups = dense.Groups.__new__(dense.Groups)
    groups.names, groups.sizes = np.unique(group, return_counts=True)
    groups.centres = np.array([items[group == g].mean(axis=0) for g in groups.names])
    groups.radius = np.array([np.linalg.norm(items[group == g] - c, axis=1).max() for g, c in zip(groups.names, groups.centres, strict=True)])
    groups.length = np.array([np.linalg.norm(items[group == g], axis=1).max() for g in groups.names])
    ids = [f"j{n:02}" for n in range(90)]
    blocks = [pa.table({"id": ids[a : a + 13], "vector": items[a : a + 13].tolist(), "group": group[a : a + 13]}) for a in range(0, 90, 13)]
    asked = [pa.table({"id": list(range(5)), "vector": asks[:5].tolist()}), pa.table({"id": list(range(5, 12)), "vector": asks[5:].tolist()})]
    hidden = [pa.table({"id": [3, 3, 77], "_j": ["j04", "gone", "j05"]})]
    task = dense._Task(asked, hidden, pa.string(), groups, 4)
    for round_ in range(groups.rounds):
        if not task.begin(round_):
            break
        for block in blocks:
            task.see(block)
    got = {(r["user_id"], r["rank"]): (r["job_id"], r["score"]) for r in task.ranking().to_pylist()}
    for a in range(12):
        order = sorted((-round(float(asks[a] @ items[b]), 9) + 0.0, ids[b]) for b in range(90) if (a, ids[b]) != (3, "j04"))
        assert [got[a, k] for k in (1, 2, 3, 4)] == [(j, -s) for s, j in order[:4]]
    assert all(1 <= r["visited"] <= 9 and r["rounds"] <= groups.rounds for r in task.visited().to_pylist())


def test_rows_of_one_id_share_a_ranking(spark):
    asks = _frame(spark, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]], [7, 7, 8])
    items = _frame(spark, [[3.0, 1.0], [2.0, 5.0], [1.0, 2.0]], [1, 2, 3])
    got = sorted((r.user_id, r.rank, r.job_id) for r in dense.dense_rankings(asks, items, 3).collect())
    assert got == [(7, 1, 1), (7, 2, 1), (7, 3, 1), (8, 1, 2), (8, 2, 3), (8, 3, 1)]
