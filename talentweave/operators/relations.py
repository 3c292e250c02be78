"""Relation layers with learned matrices: every relation's message is a linear map of its neighbours' mean vector.

The map of a relation is the ridge solution that predicts a node's own vector from the mean of its neighbours under that
relation: ``(X'X + decay) W = X'Y`` with a column of ones for the intercept. Only Gram sums leave the tasks: each task adds up
its own rows block by block, and the sums are added by (relation, place), so that no task holds more than one matrix of a
relation. Layers are learnt one after the other, each on the vectors the layer before gave.

What reaches the driver is one matrix a relation, (dim + 1) x dim numbers, however many nodes there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import erf, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .propagation import relation_means
from .vectorsums import HUB, vector_sums

EPSILON = 1e-5
# beyond TAIL a share is 0 or 1; GRID points to the unit
TAIL, GRID = 9, 256


def _share_terms() -> np.ndarray:
    """Taylor terms of P(N <= x) at every grid point, one column per point."""
    x = np.arange(-TAIL * GRID, TAIL * GRID + 1) / GRID
    bell = np.exp(-0.5 * x * x) / sqrt(2.0 * pi)
    share = np.array([0.5 * (1.0 + erf(v / sqrt(2.0))) for v in x.tolist()])
    return np.stack([share, bell, -x * bell / 2, (x * x - 1) * bell / 6, (3 * x - x**3) * bell / 24, (x**4 - 6 * x * x + 3) * bell / 120])


SHARE_TERMS = _share_terms()


def normal_share(x: np.ndarray) -> np.ndarray:
    """P(N <= x) of a standard normal N, for every entry, from the nearest grid point; off by rounding only."""
    near = np.clip(x, -TAIL, TAIL)
    at = np.rint(np.nan_to_num(near) * GRID)
    step, place = near - at / GRID, at.astype(np.int64) + TAIL * GRID
    out = SHARE_TERMS[-1][place]
    for terms in SHARE_TERMS[-2::-1]:
        out = out * step + terms[place]
    return out


def gelu(x: np.ndarray) -> np.ndarray:
    """The exact activation x * P(N <= x)."""
    return x * normal_share(x)


def layer_norm(x: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and variance 1."""
    mean = x.mean(axis=1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(axis=1, keepdims=True) + EPSILON)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _adding(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (relation, x, y) to the rows of this task's Gram matrices, one matrix for each relation met."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column("relation").to_pylist(), object)
            x, y = _matrix(batch.column("x"), dim), _matrix(batch.column("y"), dim)
            for name in sorted(set(names.tolist())):
                own = names == name
                left = np.hstack([x[own], np.ones((int(own.sum()), 1))])
                sums[name] = sums.get(name, 0) + left.T @ np.hstack([left, y[own]])
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "relation": pa.array([name] * len(total), pa.string()),
                    "place": pa.array(range(len(total)), pa.int32()),
                    "vector": pa.array(total.tolist(), pa.list_(pa.float64())),
                }
            )

    return add


def gram_sums(means: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(relation, place, vector): the rows of [X'X | X'Y] of each relation.

    ``means`` (relation, dst, vector) are the inputs and the vectors of ``nodes`` (node, vector) the targets; place ``dim`` is
    the intercept. Nodes without a vector do not count.
    """
    targets = nodes.where(F.col("vector").isNotNull()).select(F.col("node").alias("dst"), F.col("vector").alias("y"))
    rows = means.select("relation", "dst", F.col("vector").alias("x")).join(targets, "dst").select("relation", "x", "y")
    return vector_sums(rows.mapInArrow(_adding(dim), "relation string, place int, vector array<double>"), ["relation", "place"])


def solved(gram: np.ndarray, dim: int, decay: float) -> np.ndarray:
    """The (dim + 1) x dim ridge solution of one relation; the intercept is not shrunk."""
    left = gram[:, : dim + 1] + np.diag([decay] * dim + [0.0])
    return np.linalg.solve(left, gram[:, dim + 1 :])


def relation_matrices(sums: DataFrame, dim: int, decay: float = 1.0) -> DataFrame:
    """(relation, place, vector): the learned matrix of each relation by rows, place ``dim`` the intercept.

    Each relation is solved in a task of its own, which holds one matrix of (dim + 1) x (2 dim + 1) numbers.
    """

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        found = solved(_matrix(table.column("vector").combine_chunks(), 2 * dim + 1), dim, decay)
        return pa.table({"relation": table.column("relation"), "place": table.column("place"), "vector": pa.array(found.tolist(), pa.list_(pa.float64()))})

    return sums.groupBy("relation").applyInArrow(solve, "relation string, place int, vector array<double>")


@dataclass
class LearnedEncoding:
    """``nodes`` (node, vector) after the last layer; for each layer its ``matrices`` by relation and its mean squared ``errors``."""

    nodes: DataFrame
    matrices: list[dict[str, np.ndarray]]
    errors: list[dict[str, float]]


def squared_error(gram: np.ndarray, weights: np.ndarray, targets: float, dim: int) -> float:
    """Sum of squares that a solution leaves, from the Gram sums and the targets' own sum of squares."""
    left, right = gram[:, : dim + 1], gram[:, dim + 1 :]
    return float(targets - 2 * (weights * right).sum() + (weights * (left @ weights)).sum())


def _messages(weights: dict[str, np.ndarray], dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, x = np.asarray(batch.column("relation").to_pylist(), object), _matrix(batch.column("vector"), dim)
            out = np.zeros_like(x)
            for name in set(names.tolist()) & set(weights):
                own = names == name
                out[own] = x[own] @ weights[name][:dim] + weights[name][dim]
            yield pa.RecordBatch.from_pydict({"dst": batch.column("dst"), "vector": pa.array(out.tolist(), pa.list_(pa.float64()))})

    return apply


def _mixed(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = layer_norm(_matrix(batch.column("vector"), dim) + gelu(_matrix(batch.column("incoming"), dim)))
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "vector": pa.array(state.tolist(), pa.list_(pa.float64()))})

    return mix


def learned_relational_encode(nodes: DataFrame, edges: DataFrame, dim: int, layers: int = 2, decay: float = 1.0, hub: int = HUB) -> LearnedEncoding:
    """Vectors of all ``nodes`` (node, vector) after ``layers`` layers over ``edges`` (relation, src, dst).

    A layer adds the relations' messages up per node, passes the sum through the activation, adds it to the node's own vector
    and normalises. A node without edges gets no message; nodes without a vector are left out, and edges from them say
    nothing. Repeated edges count as often as they come. Node names must be unique and tagged by type.
    """
    spark = nodes.sparkSession
    state = cut_lineage(nodes.where(F.col("vector").isNotNull()).select("node", F.transform("vector", lambda x: x.cast("double")).alias("vector")))
    matrices: list[dict[str, np.ndarray]] = []
    errors: list[dict[str, float]] = []
    for _ in range(layers):
        means = cut_lineage(relation_means(state, edges, hub))
        sums = cut_lineage(gram_sums(means, state, dim))
        weights: dict[str, np.ndarray] = {}
        grams: dict[str, np.ndarray] = {}
        for found, source in ((weights, relation_matrices(sums, dim, decay)), (grams, sums)):
            by_relation: dict[str, dict[int, list[float]]] = {}
            for r in source.collect():  # dim + 1 rows a relation
                by_relation.setdefault(r.relation, {})[r.place] = r.vector
            found |= {name: np.array([rows[i] for i in sorted(rows)]) for name, rows in by_relation.items()}
        square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x).alias("square")
        asked = means.select("relation", F.col("dst").alias("node")).join(state.select("node", square), "node")
        squares = {r.relation: (r.square, r.n) for r in asked.groupBy("relation").agg(F.sum("square").alias("square"), F.count(F.lit(1)).alias("n")).collect()}
        matrices.append(weights)
        errors.append({k: squared_error(grams[k], w, squares[k][0], dim) / (squares[k][1] * dim) for k, w in weights.items()})
        # one matrix a relation, whatever the number of nodes
        shared = spark.sparkContext.broadcast(weights)
        sent = means.mapInArrow(lambda batches, shared=shared: _messages(shared.value, dim)(batches), "dst string, vector array<double>")
        incoming = vector_sums(sent, ["dst"]).select(F.col("dst").alias("node"), F.col("vector").alias("incoming"))
        joined = state.join(incoming, "node", "left").withColumn("incoming", F.coalesce("incoming", F.array_repeat(F.lit(0.0), dim)))
        state = cut_lineage(joined.select("node", "vector", "incoming").mapInArrow(_mixed(dim), "node string, vector array<double>"))
    return LearnedEncoding(state, matrices, errors)
