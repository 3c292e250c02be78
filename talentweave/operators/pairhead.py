"""Logistic head over [u, j, |u - j|, u * j] of user and job vectors, on cells of pairs that hold each vector once.

A pair's features are four times as long as its vectors, so they are never written: users and jobs are dealt to blocks, a
cell holds the pairs of one user block and one job block with the vectors they read (``vector_cells``), and a task makes the
features of a few pairs at a time. Training is full-batch: every evaluation is one pass over the written cells, whose sums of
loss and slopes reach the driver. Features are scaled to unit deviation, the penalty is on the scaled coefficients, the
intercept is free: the same head, with the same coefficients at its end, as Spark ML's scaler and logistic regression fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .pathmodel import CHUNK, quasi_newton
from .vectorsums import vector_sums

BLOCK_ROWS = 8192
CELL_PAIRS = 1_048_576
# numbers of a run of pairs: few enough that its matrices stay in a core's cache
_RUN_NUMBERS = 32_768


def numbered_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vector, row) with a number per row, written."""
    return cut_lineage(vectors.select("id", "vector", F.monotonically_increasing_id().alias("row")))


def vector_cells(pairs: DataFrame, users: DataFrame, jobs: DataFrame, block_rows: int = BLOCK_ROWS, cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(pairs, users, jobs): pairs of known users and jobs in cells, written.

    ``users`` and ``jobs`` come from ``numbered_vectors``; a pair meets every row with its ids. A cell holds at most
    about ``block_rows`` users, as many jobs and ``cell_pairs`` pairs; ``label`` is kept where there is one.
    """
    keep = ["label"] if "label" in pairs.columns else []
    known = pairs.select("user_id", "job_id", *keep)
    known = known.join(users.select(F.col("id").alias("user_id"), F.col("row").alias("user_row")), "user_id")
    known = cut_lineage(known.join(jobs.select(F.col("id").alias("job_id"), F.col("row").alias("job_row")), "job_id").select("user_row", "job_row", *keep))
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    job_blocks = max(1, ceil(jobs.count() / block_rows))
    n = known.count()
    wanted = max(min(2 * cores, ceil(n / 4096)), ceil(n / cell_pairs))
    user_blocks = max(1, ceil(users.count() / block_rows), ceil(wanted / job_blocks))
    blocks = [F.pmod(F.xxhash64(f"{side}_row"), F.lit(many)).cast("int").alias(f"{side}_block") for side, many in (("user", user_blocks), ("job", job_blocks))]
    dealt = known.select("*", *blocks)
    # a cell can hold as many pairs as the product of its sides; beyond the limit it is dealt to slices
    sizes = dealt.groupBy("user_block", "job_block").agg(F.ceil(F.count(F.lit(1)) / cell_pairs).cast("int").alias("_slices"))
    sliced = dealt.join(F.broadcast(sizes), ["user_block", "job_block"])
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("user_row", "job_row"), F.col("_slices")).cast("int"))
    cell = ["user_block", "job_block", "slice"]

    def listed(side: str, vectors: DataFrame) -> DataFrame:
        met = sliced.select(*cell, F.col(f"{side}_row").alias("row")).distinct().join(vectors, "row")
        return met.groupBy(*cell).agg(F.collect_list(F.struct("row", "id", "vector")).alias(f"{side}s"))

    rows = sliced.groupBy(*cell).agg(F.collect_list(F.struct("user_row", "job_row", *keep)).alias("pairs"))
    whole = rows.join(listed("user", users), cell).join(listed("job", jobs), cell).drop(*cell)
    n_cells = user_blocks * job_blocks
    return written(whole.repartition(max(1, min(n_cells, max(4 * cores, n_cells // 4)))), "cells")


@dataclass
class Cell:
    """Vectors of users and jobs as rows, and the rows that each pair reads."""

    users: np.ndarray
    jobs: np.ndarray
    user_at: np.ndarray
    job_at: np.ndarray

    def runs(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """|u - j| and u * j of some pairs at a time."""
        step = max(1, _RUN_NUMBERS // max(1, self.users.shape[1]))
        for at in range(0, len(self.user_at), step):
            some = slice(at, at + step)
            u, j = self.users[self.user_at[some]], self.jobs[self.job_at[some]]
            yield some, np.abs(u - j), u * j

    def by_side(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the values of each user's and each job's pairs."""
        return np.bincount(self.user_at, values, len(self.users)), np.bincount(self.job_at, values, len(self.jobs))


def _margins(cell: Cell, coefficients: np.ndarray, intercept: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Margins of some pairs at a time, with their differences and products."""
    of_user, of_job, of_difference, of_product = np.split(coefficients, 4)
    user_part, job_part = cell.users @ of_user + intercept, cell.jobs @ of_job
    for some, difference, product in cell.runs():
        margin = user_part[cell.user_at[some]] + job_part[cell.job_at[some]] + difference @ of_difference + product @ of_product
        yield some, margin, difference, product


def moments(cell: Cell, label: np.ndarray) -> np.ndarray:
    """[pairs, sum of labels, sums of the features, sums of their squares]."""
    dim = cell.users.shape[1]
    user_pairs, job_pairs = cell.by_side(np.ones(len(label)))
    sums, squares = np.zeros((2, dim)), np.zeros((2, dim))
    for _, difference, product in cell.runs():
        sums += [difference.sum(axis=0), product.sum(axis=0)]
        squares += [np.einsum("ij,ij->j", difference, difference), np.einsum("ij,ij->j", product, product)]
    return np.concatenate([
        [len(label), label.sum()], user_pairs @ cell.users, job_pairs @ cell.jobs, *sums,
        user_pairs @ cell.users**2, job_pairs @ cell.jobs**2, *squares,
    ])


def loss_and_slopes(cell: Cell, label: np.ndarray, coefficients: np.ndarray, intercept: float) -> np.ndarray:
    """[summed logistic loss, slope of the intercept, slopes of the coefficients]."""
    dim = cell.users.shape[1]
    loss, pushes = 0.0, np.zeros(len(label))
    by_difference, by_product = np.zeros(dim), np.zeros(dim)
    for some, margin, difference, product in _margins(cell, coefficients, intercept):
        loss += float((np.logaddexp(0, margin) - label[some] * margin).sum())
        push = 0.5 * (1 + np.tanh(margin / 2)) - label[some]
        by_difference += push @ difference
        by_product += push @ product
        pushes[some] = push
    by_user, by_job = cell.by_side(pushes)
    return np.concatenate([[loss, pushes.sum()], by_user @ cell.users, by_job @ cell.jobs, by_difference, by_product])


def _side(found: pa.StructArray, rows: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids and vectors of one side of a cell, and the place of each pair's row among them."""
    number = found.field("row").to_numpy(zero_copy_only=False)
    order = np.argsort(number)
    vectors = found.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(number), -1)
    at = np.searchsorted(number[order], rows.to_numpy(zero_copy_only=False))
    return found.field("id"), vectors, order[at]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, Cell, pa.Array, pa.Array]]:
    """The pairs, matrices, user ids and job ids of every cell."""
    for batch in batches:
        for place in range(batch.num_rows):
            rows = batch.column("pairs")[place].values
            user_ids, users, user_at = _side(batch.column("users")[place].values, rows.field("user_row"))
            job_ids, jobs, job_at = _side(batch.column("jobs")[place].values, rows.field("job_row"))
            yield rows, Cell(users, jobs, user_at, job_at), user_ids, job_ids


def _summed(cells: DataFrame, part: Callable[[Cell, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(cell, label)`` over all cells."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for rows, cell, _, _ in _cells(batches):
            found = part(cell, rows.field("label").to_numpy(zero_copy_only=False))
            sums = found if sums is None else sums + found
        if sums is not None:
            cut = [sums[at : at + CHUNK].tolist() for at in range(0, len(sums), CHUNK)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(cut)), pa.int32()), "vector": pa.array(cut, pa.list_(pa.float64()))})

    found = {r.chunk: r.vector for r in vector_sums(cells.mapInArrow(total, "chunk int, vector array<double>"), ["chunk"]).collect()}
    return np.concatenate([found[i] for i in sorted(found)]) if found else np.zeros(0)


@dataclass
class InteractionHead:
    """Coefficients of the unscaled features [u, j, |u - j|, u * j], the intercept, and the mean loss after every step."""

    coefficients: np.ndarray
    intercept: float
    losses: list[float]


def train_interaction_head(cells: DataFrame, regularization: float = 0.01, steps: int = 50, tolerance: float = 1e-8) -> InteractionHead:
    """Fit the head to ``vector_cells`` with a ``label`` of 0 or 1. A feature that never changes gets the coefficient 0."""
    sums = _summed(cells, moments)
    if not len(sums):
        raise ValueError("no labelled pairs of known users and jobs")
    n, positive = sums[:2]
    mean, square = np.split(sums[2:] / n, 2)
    if positive in (0, n):
        return InteractionHead(np.zeros(len(mean)), np.inf if positive else -np.inf, [])
    variance = np.maximum(0.0, square - mean**2)
    varies = variance > 1e-12 * square
    scale = np.where(varies, np.sqrt((n - 1) / n) / np.sqrt(np.where(varies, variance, 1.0)), 0.0)

    def unscaled(theta: np.ndarray) -> tuple[np.ndarray, float]:
        # steps are taken on centred features, which only moves the intercept
        coefficients = theta[1:] * scale
        return coefficients, float(theta[0] - coefficients @ mean)

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        coefficients, intercept = unscaled(theta)
        found = _summed(cells, lambda cell, label: loss_and_slopes(cell, label, coefficients, intercept)) / n
        slope = np.concatenate([[found[1]], (found[2:] - mean * found[1]) * scale + regularization * theta[1:]])
        return found[0] + 0.5 * regularization * float(theta[1:] @ theta[1:]), slope

    start = np.zeros(len(mean) + 1)
    start[0] = np.log(positive / (n - positive))
    theta, losses = quasi_newton(evaluate, start, steps, tolerance=tolerance)
    return InteractionHead(*unscaled(theta), losses)


def score_interactions(head: InteractionHead, cells: DataFrame) -> DataFrame:
    """(user_id, job_id, score) of the pairs in ``vector_cells``: margin of the head plus the dot product of the vectors."""
    coefficients, intercept = head.coefficients, head.intercept
    id_types = [cells.schema[side].dataType.elementType["id"].dataType.simpleString() for side in ("users", "jobs")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell, user_ids, job_ids in _cells(batches):
            for some, margin, _, product in _margins(cell, coefficients, intercept):
                yield pa.RecordBatch.from_pydict({
                    "user_id": user_ids.take(pa.array(cell.user_at[some])), "job_id": job_ids.take(pa.array(cell.job_at[some])),
                    "score": pa.array(margin + product.sum(axis=1), pa.float64()),
                })

    return cells.mapInArrow(apply, f"user_id {id_types[0]}, job_id {id_types[1]}, score double")
