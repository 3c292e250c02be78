"""Dense retrieval over precomputed vectors: exact, with bounds that skip groups of items.

Items are grouped around pivots. What an item of a group can score is bounded by the query's product with the group's centre
plus the query's length times the group's radius (and by the two lengths). A query first visits the groups of highest bound
that hold enough items; the ``topn``-th best score found so far then rules out every group whose bound is below it, and the
remaining ones are visited in rounds that grow fourfold.

A task holds a bounded number of queries and reads the items block by block, once for each round (``operators/streams.py``), so
neither side is copied through a shuffle, and only a query's ``topn`` best items leave the task. Blocks hold the items in the
order of their groups; a block is scored against the queries that visit any of its groups, with NumPy and in slices of bounded
size, so a group that holds most items, or that most queries ask for, costs further blocks and no larger ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .streams import Passes, packed, streamed, unpacked
from .topk import _CELLS, SCORE_DIGITS, _hidden_cells

QUERY_BLOCK_ROWS = 16_384
ITEM_BLOCK_ROWS = 8_192
MOST_GROUPS = 1024  # so that all centres fit into a task: 1024 vectors
BUNDLE_NUMBERS = 4_000_000  # of the items of a bundle: 32 MB in a task
BOUNDS = 1_000_000  # of a run of queries at a time
KEPT = 2_000_000  # items of all queries of a task
SLACK = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def unit(vector: Column) -> Column:
    """Vector of length 1; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(
        F.arrays_zip(wide.alias("x"), F.array_repeat(norm, F.size(vector)).alias("n")),
        lambda e: F.when(e["n"] > 0, e["x"] / e["n"]).otherwise(e["x"]),
    )


def unit_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), unit(F.col(vector)).alias("vector"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def grouped_items(items: DataFrame, rows: int, n: int) -> DataFrame:
    """(id, vector, group): items by their nearest pivot. Pivots are the first items by a hash of the id, one per ``rows``
    items and at most ``MOST_GROUPS``."""
    count = min(MOST_GROUPS, ceil(n / rows))
    if count <= 1:
        return items.select("id", "vector", F.lit(0).alias("group"))
    chosen = items.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").collect()  # at most MOST_GROUPS rows
    pivots = np.array([r.vector for r in chosen], np.float64)
    half = (pivots * pivots).sum(axis=1) / 2

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                group = np.argmax(_matrix(batch.column("vector")) @ pivots.T - half, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(group.astype(np.int32))], ["id", "vector", "group"])

    kinds = [items.schema[c].dataType.simpleString() for c in ("id", "vector")]
    return items.select("id", "vector").mapInArrow(nearest, f"id {kinds[0]}, vector {kinds[1]}, group int")


class Groups:
    """Centre, radius, greatest length, size and bundle of each group; bounds of a matrix of queries."""

    def __init__(self, grouped: DataFrame, item_rows: int):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                values, group = _matrix(batch.column("vector")), batch.column("group").to_numpy()
                kinds, at = np.unique(group, return_inverse=True)
                sums = np.zeros((len(kinds), values.shape[1]))
                np.add.at(sums, at, values)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(at)), pa.array(list(sums))], ["group", "rows", "sums"])

        # one row for each group and batch, then for each group: at most MOST_GROUPS rows here
        parts = grouped.select("vector", "group").mapInArrow(partial, "group int, rows bigint, sums array<double>")
        added = F.aggregate(F.collect_list("sums"), F.transform(F.first("sums"), lambda _: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        found = parts.groupBy("group").agg(F.sum("rows").alias("rows"), added.alias("sums")).orderBy("group").collect()
        self.names = np.array([r.group for r in found], np.int32)
        self.sizes = np.array([r.rows for r in found], np.int64)
        self.centres = np.array([r.sums for r in found]) / self.sizes[:, None]
        names, centres = self.names, self.centres

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                values, group = _matrix(batch.column("vector")), batch.column("group").to_numpy()
                far = np.linalg.norm(values - centres[np.searchsorted(names, group)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(far), pa.array(np.linalg.norm(values, axis=1))], ["group", "far", "length"])

        extent = grouped.select("vector", "group").mapInArrow(spread, "group int, far double, length double")
        found = extent.groupBy("group").agg(F.max("far").alias("radius"), F.max("length").alias("length")).orderBy("group").collect()
        self.radius, self.length = (np.array([r[c] for r in found]) for c in ("radius", "length"))
        #: most items of a slice of a bundle
        self.rows = max(item_rows, min(MOST_GROUPS * item_rows, BUNDLE_NUMBERS // max(1, self.centres.shape[1])))
        self.bundle, held, at = np.zeros(len(self.names), np.int32), 0, 0
        for i, size in enumerate(self.sizes.tolist()):
            if held and held + size > self.rows:
                held, at = 0, at + 1
            self.bundle[i], held = at, held + size

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        own = np.linalg.norm(queries, axis=1)[:, None]
        return np.minimum(queries @ self.centres.T + own * self.radius, own * self.length)

    def visited(self, queries: np.ndarray, reached: np.ndarray, topn: int, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place of a group) of the visits of a round, in this order; ``reached`` holds the queries' thresholds.

        The first round takes the groups of highest bound until they hold ``topn`` items, each later one four times as many.
        """
        before, after = (4**round_ - 1) // 3, (4 ** (round_ + 1) - 1) // 3
        step, rows, places = max(1, BOUNDS // len(self.names)), [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for start in range(0, len(queries), step):
            bound = self.bounds(queries[start : start + step])
            order = np.argsort(-bound, axis=1, kind="stable")
            first = 1 + np.argmax(np.cumsum(self.sizes[order], axis=1) >= min(topn, self.sizes.sum()), axis=1)[:, None]
            place = np.arange(bound.shape[1])[None, :]
            high = np.take_along_axis(bound, order, axis=1) >= reached[start : start + step, None] - SLACK
            row, at = np.nonzero((place >= before * first) & (place < after * first) & high)
            at = order[row, at]
            sorted_ = np.lexsort((at, row))  # bundles hold runs of groups
            rows.append((row[sorted_] + start).astype(np.int32))
            places.append(at[sorted_].astype(np.int32))
        return np.concatenate(rows), np.concatenate(places)

    @property
    def rounds(self) -> int:
        """Most rounds in which a query can visit all groups."""
        return next(r for r in range(1, 99) if (4**r - 1) // 3 >= len(self.names))


def _visits(queries: DataFrame, groups: Groups, topn: int, round_: int) -> DataFrame:
    """(id, bundle, groups): the groups of each bundle that a query visits in this round; ``queries`` (id, vector, threshold)."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reached = batch.column("threshold").fill_null(-np.inf).to_numpy(zero_copy_only=False)
            row, at = groups.visited(_matrix(batch.column("vector")), reached, topn, round_)
            bundle = groups.bundle[at]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])]) if len(row) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(groups.names[at]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[starts])), pa.array(bundle[starts]), lists], ["id", "bundle", "groups"])

    kind = queries.schema["id"].dataType.simpleString()
    return queries.select("id", "vector", "threshold").mapInArrow(plan, f"id {kind}, bundle int, groups array<int>")


def _bundle_winners(q: pa.Table, i: pa.Table, topn: int) -> pa.Table:
    """Best ``topn`` items of the groups it visits, for every query of a slice; none below the query's threshold."""
    out_q, out_i, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if q.num_rows and i.num_rows:
        i = i.take(pc.sort_indices(i, sort_keys=[("group", "ascending"), ("id", "ascending")]))
        by_id = np.empty(i.num_rows, np.int64)  # place of an item by its id
        by_id[pc.sort_indices(i, sort_keys=[("id", "ascending")]).to_numpy()] = np.arange(i.num_rows)
        names, starts = np.unique(i.column("group").to_numpy(), return_index=True)
        ends = np.r_[starts[1:], i.num_rows]
        lists, reached = q.column("groups").combine_chunks(), q.column("threshold").fill_null(-np.inf).to_numpy()
        asked, owner = lists.flatten().to_numpy(), np.repeat(np.arange(q.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        here = names[at] == asked  # a slice may hold no item of a group
        at, owner = at[here], owner[here]
        left, right = (_matrix(t.column("vector").combine_chunks()) for t in (q, i))
        hidden_row, hidden_item = _hidden_cells(q.column("_hidden").combine_chunks(), i.column("id").combine_chunks())
        hidden = np.sort(hidden_row * i.num_rows + hidden_item)
        most_hidden = np.bincount(hidden_row, minlength=q.num_rows)
        # runs of queries that visit a bounded number of cells
        run = np.cumsum(np.bincount(owner, (ends - starts)[at], q.num_rows)) // _CELLS
        for first, last in itertools.pairwise(np.r_[0, np.flatnonzero(np.diff(run)) + 1, q.num_rows].tolist()):
            x, y = np.searchsorted(owner, [first, last])
            order = x + np.argsort(at[x:y], kind="stable")
            found = []
            for mine in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if not len(mine):
                    continue
                g, rows = at[mine[0]], owner[mine]
                cells = left[rows] @ right[starts[g] : ends[g]].T
                bar, n = reached[rows], cells.shape[1]
                cut = topn + int(most_hidden[rows].max())  # hidden items go later
                if cut < n and np.isinf(bar).any():
                    bar = np.maximum(bar, np.partition(cells, n - cut, axis=1)[:, n - cut])
                r, c = np.divmod(np.flatnonzero(cells >= bar[:, None] - SLACK), n)  # faster than nonzero where few are left
                found.append((rows[r], c + starts[g], cells[r, c]))
            if not found:
                continue
            row, item, value = (np.concatenate(part) for part in zip(*found, strict=True))
            if len(hidden):
                key = row * i.num_rows + item
                shown = hidden[np.minimum(np.searchsorted(hidden, key), len(hidden) - 1)] != key
                row, item, value = row[shown], item[shown], value[shown]
            value = np.round(value, SCORE_DIGITS) + 0.0
            order = np.lexsort((by_id[item], -value, row))
            row, item, value = row[order], item[order], value[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < topn
            for held, part in zip((out_q, out_i, out_s), (row, item, value), strict=True):
                held.append(part[best])
    rows, items, scores = (np.concatenate(held) for held in (out_q, out_i, out_s))
    return pa.table({"user_id": q.column("id").take(pa.array(rows)), "job_id": i.column("id").take(pa.array(items)), "score": scores})


class _Task:
    """The queries of a task, what they must not return, and the best items found so far."""

    def __init__(self, asked: list[pa.Table], hidden: list[pa.Table], kind: pa.DataType, groups: Groups, topn: int):
        q = pa.concat_tables([block.select(["id", "vector"]) for block in asked]).combine_chunks()
        self.groups, self.topn = groups, topn
        self.names = q.column("id").combine_chunks().unique()  # rows of one id share a ranking
        own = pc.index_in(q.column("id").combine_chunks(), value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64)
        self.asked, self.rows = own, np.repeat(np.arange(len(own)), np.bincount(own)[own])  # as often as its id occurs
        self.owner = own[self.rows]
        self.vectors = q.column("vector").combine_chunks()
        self.hidden = self._lists(hidden) if hidden else pa.nulls(len(self.rows), pa.list_(kind))
        self.reached = np.full(len(self.names), -np.inf)
        self.best = pa.table({"owner": pa.array([], pa.int64()), "job_id": pa.array([], kind), "score": pa.array([], pa.float64())})
        self.later, self.waiting = [], 0
        self.visits, self.ended = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)

    def _lists(self, parts: list[pa.Table]) -> pa.Array:
        pairs = pa.concat_tables(parts).combine_chunks()
        owner = pc.index_in(pairs.column("id").combine_chunks(), value_set=self.names)
        known = owner.is_valid()
        owner, items = owner.filter(known).to_numpy(zero_copy_only=False), pairs.column("_j").combine_chunks().filter(known)
        order = np.argsort(owner, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(self.names)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), items.take(pa.array(order))).take(pa.array(self.owner))

    def begin(self, round_: int) -> bool:
        """Whether any query visits a group in this round."""
        self._merge()
        row, at = self.groups.visited(_matrix(self.vectors), self.reached[self.asked], self.topn, round_)
        n = np.bincount(row, minlength=len(self.asked))
        self.visits += n
        self.ended[n > 0] = round_ + 1
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(self.groups.names[at]))
        self.met = np.unique(self.groups.names[at])
        self.q = pa.table({"id": pa.array(np.arange(len(self.rows))), "vector": self.vectors.take(pa.array(self.rows)), "groups": lists.take(pa.array(self.rows)), "_hidden": self.hidden})
        return len(row) > 0

    def see(self, items: pa.Table) -> None:
        if not np.isin(items.column("group").to_numpy(), self.met).any():
            return
        items = items.select(["id", "vector", "group"]).combine_chunks()
        bar = self.reached[self.owner]
        found = _bundle_winners(self.q.append_column("threshold", pa.array(bar, mask=np.isinf(bar))), items, self.topn)
        own = pa.array(self.owner[found.column("user_id").to_numpy()])
        self.later.append(found.set_column(0, "owner", own))
        self.waiting += found.num_rows
        if self.waiting >= max(KEPT // 2, len(self.owner) * self.topn):
            self._merge()

    def _merge(self) -> None:
        if self.waiting:
            found = pa.concat_tables([self.best, *self.later]).combine_chunks()
            keys = [("owner", "ascending"), ("score", "descending"), ("job_id", "ascending")]
            found = found.take(pc.sort_indices(found, sort_keys=keys, null_placement="at_start"))
            own = found.column("owner").to_numpy()
            place = np.arange(len(own)) - np.searchsorted(own, own)
            full = place == self.topn - 1
            self.reached[own[full]] = found.column("score").to_numpy()[full]
            self.best = found.filter(pa.array(place < self.topn))
        self.later, self.waiting = [], 0

    def ranking(self) -> pa.Table:
        self._merge()
        own = self.best.column("owner").to_numpy()
        rank = np.arange(1, len(own) + 1) - np.searchsorted(own, own)
        return pa.table({"user_id": self.names.take(pa.array(own)), "job_id": self.best.column("job_id"), "score": self.best.column("score"), "rank": pa.array(rank.astype(np.int32))})

    def visited(self) -> pa.Table:
        n = len(self.names)
        rounds = np.zeros(n, np.int32)
        np.maximum.at(rounds, self.asked, self.ended.astype(np.int32))
        return pa.table({"user_id": self.names, "visited": pa.array(np.bincount(self.asked, self.visits, n).astype(np.int64)), "rounds": pa.array(rounds)})


def _search(queries, items, topn, exclude, query_block_rows, item_block_rows, report: bool = False) -> tuple[DataFrame, int]:
    """(ranking, or, for a ``report``, (user_id, visited, rounds); number of groups)."""
    alike, spark = queries is items, queries.sparkSession
    items = cut_lineage(items.select("id", "vector"))
    queries = items if alike else cut_lineage(queries.select("id", "vector"))
    n, asking, kind = items.count(), queries.count(), items.schema["id"].dataType.simpleString()
    asker = queries.schema["id"].dataType.simpleString()
    schema = f"user_id {asker}, visited bigint, rounds int" if report else f"user_id {asker}, job_id {kind}, score double, rank int"
    if n == 0:
        return spark.createDataFrame([], schema), 0
    grouped = grouped_items(items, item_block_rows, n)
    groups = Groups(grouped, item_block_rows)
    cores, items_kind = spark.sparkContext.defaultParallelism, to_arrow_type(items.schema["id"].dataType)
    rows = max(1, min(query_block_rows, KEPT // max(1, topn)))
    tasks = max(1, ceil(asking / rows), min(2 * cores, asking, ceil(asking * n / _CELLS)))

    def task_of(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(tasks)).cast("int").alias("_t")

    parts = max(min(cores, ceil(n / item_block_rows)), ceil(n * groups.centres.shape[1] / BUNDLE_NUMBERS))
    # the order of the groups, in runs of like size whatever the size of a group
    ordered = grouped.select("id", "vector", "group", task_of("id")).repartitionByRange(parts, "group", "id").sortWithinPartitions("group", "id")
    sources = [packed(ordered, "items")]
    if not alike:
        sources.append(packed(queries.select("id", "vector", task_of("id")), "queries"))
    if exclude is not None:
        wanted = exclude.select(F.col("user_id").cast(asker).alias("id"), F.col("job_id").cast(kind).alias("_j")).dropna()
        sources.append(packed(wanted.select("id", "_j", task_of("id")), "hidden"))

    def task(number: int, passes: Passes) -> Iterator[pa.Table]:
        own = {"items" if alike else "queries": [], "hidden": []}
        for source, block in next(passes)[1]:
            if source in own:
                own[source].append(block.filter(pc.and_(pc.equal(block.column("_t"), number), block.column("id").is_valid())))
        hidden, asked = own.pop("hidden"), next(iter(own.values()))
        if not any(block.num_rows for block in asked):
            return
        state = _Task(asked, hidden, items_kind, groups, topn)
        for pass_, blocks in passes:
            if not state.begin(pass_ - 1):
                break
            for source, block in blocks:
                if source == "items":
                    state.see(block)
        yield state.visited() if report else state.ranking()

    return cut_lineage(unpacked(spark, streamed(sources, tasks, 1 + groups.rounds, task), schema)), len(groups.names)


def dense_rankings(queries: DataFrame, items: DataFrame, topn: int, exclude: DataFrame | None = None,
                   query_block_rows: int = QUERY_BLOCK_ROWS, item_block_rows: int = ITEM_BLOCK_ROWS) -> DataFrame:
    """(user_id, job_id, score, rank): the ``topn`` best items of every query by dot product of (id, vector) tables; exact.

    Ties go to the smaller item id; ``exclude`` (user_id, job_id) pairs are never returned. ``item_block_rows`` is the size
    of a group of items, ``query_block_rows`` the most queries of a task.
    """
    return _search(queries, items, topn, exclude, query_block_rows, item_block_rows)[0]


def dense_groups_visited(queries: DataFrame, items: DataFrame, topn: int, exclude: DataFrame | None = None,
                         query_block_rows: int = QUERY_BLOCK_ROWS, item_block_rows: int = ITEM_BLOCK_ROWS) -> DataFrame:
    """(user_id, groups, visited, rounds): how many groups of items a query's exact ranking visits."""
    seen, n = _search(queries, items, topn, exclude, query_block_rows, item_block_rows, report=True)
    return seen.select("user_id", F.lit(n).alias("groups"), "visited", "rounds")
