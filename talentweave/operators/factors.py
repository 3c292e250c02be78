"""Factors of users and jobs learnt from pairwise preferences: a taken job should score above one that was not taken.

Stratified stochastic gradients: users and jobs are dealt to ``blocks`` blocks each by a hash. In sub-round ``s`` user block
``b`` meets job block ``(b + s) mod blocks``, so no two tasks share a factor and all blocks are trained side by side; then the
factors are handed on. ``blocks`` sub-rounds meet every pair once: one epoch. A task holds one block of each side and the
pairs between them. Choose ``blocks`` so that these fit; the result depends on it and on the seed, but on no partitioning.

The loss of a pair (user, taken job, other job) is ``-log sigmoid(user . (taken - other))``. The other job is drawn from the
block by the seed, the epoch and the pair; jobs the user has taken are passed over, which the task can tell because all the
user's pairs in this job block are there.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BATCH = 64
_USER, _JOB, _PAIR, _LOSS = range(4)


@dataclass
class Factors:
    """``users`` and ``jobs`` (id, vector); ``losses``: the mean loss of each epoch, measured while it is trained."""

    users: DataFrame
    jobs: DataFrame
    losses: list[float]


def _start(ids: DataFrame, kind: int, dim: int, blocks: int, seed: int) -> DataFrame:
    """(kind, block, id, other, vector): small seeded numbers for every id."""
    noise = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64("id", F.lit(seed + kind), i), F.lit(1_000_003)) / 1_000_003.0 - 0.5) / dim**0.5)
    return ids.select(F.lit(kind).alias("kind"), _block("id", kind, blocks, seed), F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("other"), noise.alias("vector"))


def _block(column: str, kind: int, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string"), F.lit(seed * 7 + kind)), F.lit(blocks)).cast("int").alias("block")


def free_job(start: int, taken: set[int], n: int) -> int:
    """The first of ``n`` jobs from ``start`` on, in a ring, that is not taken; -1 if all are."""
    for step in range(min(len(taken) + 1, n)):
        if (j := (start + step) % n) not in taken:
            return j
    return -1


def gradients(user: np.ndarray, good: np.ndarray, bad: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slopes of the three factors) of rows of pairs; the slopes are those of loss + decay / 2 * squares."""
    margin = ((good - bad) * user).sum(axis=1)
    push = 1 / (1 + np.exp(np.clip(margin, -60, 60)))[:, None]
    return np.logaddexp(0, -margin), -push * (good - bad) + decay * user, -push * user + decay * good, push * user + decay * bad


def _trained(table: pa.Table, epoch: int, seed: int, rate: float, decay: float) -> pa.Table:
    """One block of users, one of jobs and their pairs, trained once."""
    frame = table.select(["kind", "id", "other"]).to_pandas()
    vectors = table.column("vector").combine_chunks()
    sides = []
    for kind in (_USER, _JOB):
        rows = frame.index[frame["kind"] == kind]
        names = pd.Index(frame.loc[rows, "id"])
        order = np.argsort(names.to_numpy().astype(object), kind="stable")
        own = vectors.take(pa.array(rows.to_numpy()[order]))
        sides.append((names[order], own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1).copy()))
    (users, u), (jobs, v) = sides
    pairs = frame.loc[frame["kind"] == _PAIR, ["id", "other"]].drop_duplicates()
    total, n = 0.0, 0
    if len(pairs) and len(users) and len(jobs):
        pairs["draw"] = [zlib.crc32(f"{seed}:{epoch}:{a}:{b}".encode()) for a, b in zip(pairs["id"], pairs["other"], strict=True)]
        pairs = pairs.sort_values(["draw", "id", "other"])
        left, right = users.get_indexer(pairs["id"]), jobs.get_indexer(pairs["other"])
        known = (left >= 0) & (right >= 0)
        left, right, draw = left[known], right[known], pairs["draw"].to_numpy()[known]
        taken: dict[int, set[int]] = {}
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            taken.setdefault(a, set()).add(b)
        other = np.array([free_job(d % len(jobs), taken[a], len(jobs)) for a, d in zip(left.tolist(), draw.tolist(), strict=True)], np.int64)
        use = other >= 0
        left, right, other = left[use], right[use], other[use]
        for at in range(0, len(left), BATCH):
            a, b, c = left[at : at + BATCH], right[at : at + BATCH], other[at : at + BATCH]
            loss, to_user, to_good, to_bad = gradients(u[a], v[b], v[c], decay)
            total, n = total + float(loss.sum()), n + len(a)
            for matrix, rows, slope in ((u, a, to_user), (v, b, to_good), (v, c, to_bad)):
                np.add.at(matrix, rows, -rate * slope)
    kinds = [_USER] * len(users) + [_JOB] * len(jobs) + [_LOSS]
    values = [*u.tolist(), *v.tolist(), [total, float(n)]]
    return pa.table({"kind": pa.array(kinds, pa.int32()), "id": pa.array([*users, *jobs, None], pa.string()), "vector": pa.array(values, pa.list_(pa.float64()))})


def _training(epoch: int, seed: int, rate: float, decay: float) -> Callable[[pa.Table], pa.Table]:
    def train(table: pa.Table) -> pa.Table:
        return _trained(table, epoch, seed, rate, decay)

    return train


def pairwise_factors(
    pairs: DataFrame, users: DataFrame, jobs: DataFrame, dim: int = 32, epochs: int = 20, blocks: int = 4, rate: float = 0.1,
    decay: float = 0.01, seed: int = 7,
) -> Factors:
    """Factors of all ``users`` (user_id) and ``jobs`` (job_id) from ``pairs`` (user_id, job_id); repeated pairs count once."""
    kinds = [frame.schema[c].dataType.simpleString() for frame, c in ((users, "user_id"), (jobs, "job_id"))]
    own = _start(users.select(F.col("user_id").alias("id")).distinct(), _USER, dim, blocks, seed)
    state = cut_lineage(own.unionByName(_start(jobs.select(F.col("job_id").alias("id")).distinct(), _JOB, dim, blocks, seed)))
    met = pairs.select(F.col("user_id").cast("string").alias("id"), F.col("job_id").cast("string").alias("other")).distinct()
    none = F.lit(None).cast("array<double>")
    met = cut_lineage(met.select(F.lit(_PAIR).alias("kind"), _block("id", _USER, blocks, seed), "id", "other", none.alias("vector"), _block("other", _JOB, blocks, seed).alias("theirs")))
    losses = []
    for epoch in range(epochs):
        total = n = 0.0
        for s in range(blocks):
            # a job block works where the user block is that it meets now
            task_of = F.when(F.col("kind") == _JOB, F.pmod(F.col("block") - s, F.lit(blocks))).otherwise(F.col("block"))
            now = met.where(F.pmod(F.col("theirs") - F.col("block"), F.lit(blocks)) == s).drop("theirs")
            rows = state.unionByName(now).withColumn("task", task_of.cast("int"))
            done = cut_lineage(rows.groupBy("task").applyInArrow(_training(epoch, seed, rate, decay), "kind int, id string, vector array<double>"))
            for r in done.where(F.col("kind") == _LOSS).select("vector").collect():  # one row a block
                total, n = total + r.vector[0], n + r.vector[1]
            block = F.when(F.col("kind") == _USER, _block("id", _USER, blocks, seed)).otherwise(_block("id", _JOB, blocks, seed))
            state = done.where(F.col("kind") != _LOSS).select("kind", block.alias("block"), "id", F.lit(None).cast("string").alias("other"), "vector")
        losses.append(total / n if n else 0.0)
    found = [state.where(F.col("kind") == kind).select(F.col("id").cast(t).alias("id"), "vector") for kind, t in zip((_USER, _JOB), kinds, strict=True)]
    return Factors(*found, losses)
