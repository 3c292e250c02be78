"""Exact top-k of every query over a whole catalogue, block against block.

Queries and items are hashed into blocks of a bounded number of rows. Each task scores one query
block against one item block with NumPy and emits at most ``k`` items per query, so no pair table is
ever built and no key (a skill, a term, a city) can become a hot group. Per-block winners are then
merged by rank. Exclusions travel with the block they belong to and are masked before the cut.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import top_per_group

QUERY_BLOCK_ROWS = 16_384
ITEM_BLOCK_ROWS = 32_768
SCORE_DIGITS = 9
_CELLS = 4_000_000


def term_key(term: Column) -> Column:
    """64-bit key of a term; both sides of a block are matched on it."""
    return F.xxhash64(term)


def term_keys(terms: Column) -> Column:
    return F.transform(terms, term_key)


def block_counts(n_queries: int, n_items: int, query_block_rows: int, item_block_rows: int, cores: int) -> tuple[int, int]:
    """Number of query and item blocks: bounded rows per block, and enough block pairs to keep the cores busy."""
    item_blocks = max(1, ceil(n_items / item_block_rows))
    query_blocks = max(1, ceil(n_queries / query_block_rows))
    busy = min(cores, ceil(n_queries * n_items / _CELLS)) if n_queries * n_items > _CELLS // 4 else 1
    return max(query_blocks, min(n_queries or 1, ceil(busy / item_blocks))), item_blocks


def _block_of(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")


def blocked_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    score: Callable[[pa.Table, pa.Table], Callable[[int, int], np.ndarray]],
    exclude: DataFrame | None = None,
    query_block_rows: int = QUERY_BLOCK_ROWS,
    item_block_rows: int = ITEM_BLOCK_ROWS,
    min_score: float | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """(user_id, job_id, score, rank) with the ``k`` best items per query.

    ``queries`` and ``items`` carry a unique ``id`` and the payload ``score`` reads; ``exclude`` holds
    (user_id, job_id) pairs never to return. Ties go to the smaller item id. ``score(q, i)`` prepares
    two blocks and returns a function giving the score rows of a slice of the queries. ``sizes`` gives the
    numbers of queries and items where counting the prepared tables would be costly.
    """
    n_queries, n_items = sizes or (queries.count(), items.count())
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_query_blocks, n_item_blocks = block_counts(n_queries, n_items, query_block_rows, item_block_rows, cores)
    id_type = items.schema["id"].dataType

    q = queries.withColumn("_qb", _block_of(F.col("id"), n_query_blocks)).withColumn(
        "_ib", F.explode(F.sequence(F.lit(0), F.lit(n_item_blocks - 1)))
    )
    if exclude is not None:
        hidden = exclude.select(F.col("user_id").alias("id"), F.col("job_id").cast(id_type).alias("_j"))
        hidden = (
            hidden.withColumn("_ib", _block_of(F.col("_j"), n_item_blocks))
            .groupBy("id", "_ib")
            .agg(F.collect_set("_j").alias("_hidden"))
        )
        q = q.join(hidden, ["id", "_ib"], "left")
    else:
        q = q.withColumn("_hidden", F.lit(None).cast(T.ArrayType(id_type)))
    # fresh column ids: both sides may come from one table
    i = items.select(*[F.col(c).alias(c) for c in items.columns]).withColumn("_ib", _block_of(F.col("id"), n_item_blocks)).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))
    )
    schema = T.StructType(
        [
            T.StructField("user_id", queries.schema["id"].dataType),
            T.StructField("job_id", id_type),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_winners(left, right, score, k, min_score)

    winners = q.groupBy("_qb", "_ib").cogroup(i.groupBy("_qb", "_ib")).applyInArrow(task, schema)
    return top_per_group(winners, ["user_id"], [F.desc("score"), F.asc("job_id")], k)


def _block_winners(q: pa.Table, i: pa.Table, score, k: int, min_score: float | None) -> pa.Table:
    """Best ``k`` items of one item block for every query of one query block."""
    i = i.take(pc.sort_indices(i, sort_keys=[("id", "ascending")], null_placement="at_start"))
    item_ids = i.column("id").combine_chunks()
    out_q, out_i, out_s = [], [], []
    if q.num_rows and i.num_rows:
        rows_of = score(q, i)
        step = max(1, _CELLS // i.num_rows)
        hidden_row, hidden_item = _hidden_cells(q.column("_hidden").combine_chunks(), item_ids)
        for start in range(0, q.num_rows, step):
            stop = min(q.num_rows, start + step)
            cells = np.round(rows_of(start, stop), SCORE_DIGITS) + 0.0
            mine = (hidden_row >= start) & (hidden_row < stop)
            cells[hidden_row[mine] - start, hidden_item[mine]] = -np.inf
            r, c, s = _best_cells(cells, k, min_score)
            out_q.append(r + start)
            out_i.append(c)
            out_s.append(s)
    rows = np.concatenate(out_q) if out_q else np.empty(0, np.int64)
    cols = np.concatenate(out_i) if out_i else np.empty(0, np.int64)
    vals = np.concatenate(out_s) if out_s else np.empty(0)
    return pa.table(
        {"user_id": q.column("id").take(pa.array(rows)), "job_id": item_ids.take(pa.array(cols)), "score": vals}
    )


def _hidden_cells(hidden: pa.Array, item_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(query row, item position) of every excluded pair."""
    lengths = pc.fill_null(pc.list_value_length(hidden), 0).to_numpy(zero_copy_only=False)
    at = pc.index_in(hidden.flatten(), value_set=item_ids)
    row = np.repeat(np.arange(len(hidden)), lengths)
    known = at.is_valid().to_numpy(zero_copy_only=False)
    return row[known], at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def _best_cells(cells: np.ndarray, k: int, min_score: float | None):
    """Row, column and value of the ``k`` best cells per row; ties go to the smaller column."""
    n = cells.shape[1]
    keep = np.isfinite(cells)
    if min_score is not None:
        keep &= cells > min_score
    if k < n:
        keep &= cells >= np.partition(cells, n - k, axis=1)[:, n - k][:, None]
    row, col = np.nonzero(keep)
    val = cells[row, col]
    order = np.lexsort((col, -val, row))
    row, col, val = row[order], col[order], val[order]
    first = np.searchsorted(row, np.arange(cells.shape[0]))
    within = np.arange(len(row)) - first[row]
    return row[within < k], col[within < k], val[within < k]


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row each belongs to."""
    column = table.column(name).combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def sparse_product(q: pa.Table, i: pa.Table, keys: str = "keys", weights: str | None = "weights"):
    """Function giving slices of the sparse dot product of two blocks (1.0 per match without weights)."""
    i_keys, i_row = _flat(i, keys)
    order = np.argsort(i_keys, kind="stable")
    i_keys, i_row = i_keys[order], i_row[order]
    q_keys, q_row = _flat(q, keys)
    i_weights = _flat(i, weights)[0][order] if weights else np.ones(len(i_keys))
    q_weights = _flat(q, weights)[0] if weights else np.ones(len(q_keys))
    low, high = np.searchsorted(i_keys, q_keys, "left"), np.searchsorted(i_keys, q_keys, "right")
    n_items = i.num_rows

    def rows(start: int, stop: int) -> np.ndarray:
        a, b = np.searchsorted(q_row, [start, stop])
        cells = np.zeros((stop - start) * n_items)
        # a bounded number of postings at a time, whatever the block holds
        matches = np.cumsum(high[a:b] - low[a:b])
        cuts = np.searchsorted(matches, np.arange(_CELLS, matches[-1] if b > a else 0, _CELLS))
        for part in np.split(np.arange(a, b), np.unique(cuts)):
            n = high[part] - low[part]
            total = int(n.sum())
            if not total:
                continue
            owner = np.repeat(part, n)
            at = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(total)
            cells += np.bincount(
                (q_row[owner] - start) * n_items + i_row[at],
                weights=q_weights[owner] * i_weights[at],
                minlength=len(cells),
            )
        return cells.reshape(stop - start, n_items)

    return rows


def bucket_product(dim: int, keys: str = "keys", weights: str = "weights"):
    """Scorer: dot product of sparse vectors with unique keys below ``dim``, as rows of a matrix."""

    def matrix(t: pa.Table) -> np.ndarray:
        at, row = _flat(t, keys)
        cells = np.zeros((t.num_rows, dim))
        cells[row, at] = _flat(t, weights)[0]
        return cells

    def prepare(q: pa.Table, i: pa.Table):
        left, right = matrix(q), matrix(i).T
        return lambda start, stop: left[start:stop] @ right

    return prepare


def dense_scores(vector: str = "vector"):
    """Scorer: dot product of dense vectors of one length."""

    def matrix(t: pa.Table) -> np.ndarray:
        values, _ = _flat(t, vector)
        return values.astype(np.float64).reshape(t.num_rows, -1)

    def prepare(q: pa.Table, i: pa.Table):
        left, right = matrix(q), matrix(i).T
        return lambda start, stop: left[start:stop] @ right

    return prepare
