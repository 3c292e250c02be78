"""Approximate nearest neighbours by dot product: inverted lists of coarse centres, residual codes, exact re-rank.

Centres and code books are fitted on a bounded sample of the items; every item is then indexed: its list is that of the
nearest centre, its code names, for each part of the vector (one number, if not told otherwise), the nearest entry of the
book of residuals. A query visits the lists of the centres nearest to it. Lists are cut into slices of at most about
``slice_rows`` items and visits into slices of queries, so a list that holds a third of all items is scored by many tasks.
Each task returns a query's best items by code, and the best of all are scored exactly. How many lists are visited is
measured on the sample: the fewest that hold the wanted share of its true neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .ordering import top_per_group

SAMPLE = 20_000
SLICE_ROWS = 65_536
QUERY_ROWS = 4096


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre nearest to each row."""
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def centres_of(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``n`` means of groups of rows; a group that loses its rows keeps its centre."""
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class Index:
    """``books``: (parts, entries, dim / parts) residuals; ``probes``: how many lists a query visits."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of rows."""
        own = _nearest(x, self.centres)
        parts, _, wide = self.books.shape
        rest = (x - self.centres[own]).reshape(len(x), parts, wide)
        return own, np.stack([_nearest(rest[:, p], self.books[p]) for p in range(parts)], axis=1).astype(np.uint8)

    def visited(self, queries: np.ndarray) -> np.ndarray:
        """The lists each query visits, best centre first."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, : self.probes]

    def scores(self, queries: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries and the items of one list."""
        parts, _, wide = self.books.shape
        total = np.repeat((queries @ self.centres[place])[:, None], len(codes), axis=1)
        for p in range(parts):
            total += (queries[:, p * wide : (p + 1) * wide] @ self.books[p].T)[:, codes[:, p]]
        return total


def fit(x: np.ndarray, lists: int, parts: int, entries: int, wanted: float, k: int, seed: int, rounds: int = 12, asked: int = 500) -> Index:
    """An index of sampled rows; ``asked`` of them serve as queries that measure the lists to visit."""
    rng = np.random.default_rng(seed)
    centres = centres_of(x, lists, rounds, rng)
    wide = x.shape[1] // parts
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, wide)
    books = np.stack([centres_of(rest[:, p], entries, max(1, rounds // 3), rng) for p in range(parts)])
    index = Index(centres, books, len(centres))
    own, queries = _nearest(x, centres), x[:asked]
    products = queries @ x.T
    products[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argsort(-products, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
    rank = np.argsort(index.visited(queries), axis=1)  # of each list among a query's lists
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1), axis=None) + 1
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))) - 1)])
    return index


def sampled_index(
    items: DataFrame, lists: int = 256, parts: int | None = None, entries: int = 64, wanted: float = 0.97, k: int = 10, sample: int = SAMPLE, seed: int = 7
) -> Index | None:
    """Fit on the ``sample`` items of smallest seeded hash, the only rows that reach the driver; None without items.

    ``entries`` is at most 256. ``parts`` must divide the length of the vectors and is that length if not given: one byte a
    number. Fewer parts make shorter codes that tell close items apart less well.
    """
    drawn = items.select("vector", F.xxhash64("id", F.lit(seed)).alias("_h"), "id").orderBy("_h", "id").limit(sample).collect()
    if not drawn:
        return None
    x = np.array([r.vector for r in drawn], np.float64)
    parts = parts or x.shape[1]
    if x.shape[1] % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide the length of a vector, and a code is one byte")
    return fit(x, lists, parts, entries, wanted, k, seed)


def _best(index: Index, kept: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def best(key: tuple, queries: pa.Table, items: pa.Table) -> pa.Table:
        place, found = key[0].as_py(), []
        if queries.num_rows and items.num_rows:
            ids = items.column("id").combine_chunks()
            codes = np.frombuffer(b"".join(items.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            vectors = _rows(queries.column("vector").combine_chunks(), index.centres.shape[1])
            extra = queries.column("extra").to_numpy()
            step = max(1, 4_000_000 // len(ids))
            for at in range(0, len(vectors), step):
                scores = index.scores(vectors[at : at + step], place, codes)
                for row, line in enumerate(scores, at):
                    n = min(len(line), kept + int(extra[row]))
                    top = np.argpartition(-line, n - 1)[:n]
                    found.append(pa.table({"query": pa.concat_arrays([queries.column("id").combine_chunks().slice(row, 1)]).take(pa.array([0] * n)),
                                           "item": ids.take(pa.array(top)), "about": pa.array(line[top])}))
        if not found:
            return pa.table({"query": queries.column("id").slice(0, 0), "item": items.column("id").slice(0, 0), "about": pa.array([], pa.float64())})
        return pa.concat_tables(found)

    return best


def approximate_rankings(
    queries: DataFrame, items: DataFrame, topn: int, exclude: DataFrame | None = None, index: Index | None = None, widen: int = 10,
    slice_rows: int = SLICE_ROWS, query_rows: int = QUERY_ROWS, **fitting,
) -> DataFrame:
    """(user_id, job_id, score, rank): about the ``topn`` best items of every query of (id, vector) tables.

    Scores are exact; ``widen * topn`` items a query, picked by code, are scored. ``exclude`` (user_id, job_id) pairs are never
    returned and do not take the place of others. Ties go to the smaller item id. Rows without a vector do not count.
    """
    items = written(items.where(F.col("vector").isNotNull()), "items")
    index = index or sampled_index(items, k=topn, **fitting)
    spark = items.sparkSession
    asker, thing = queries.schema["id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    if index is None:
        return spark.createDataFrame([], f"user_id {asker}, job_id {thing}, score double, rank int")
    # bounded by the number of lists and code entries; as plain arrays, since tasks may not have this package
    shared, dim = spark.sparkContext.broadcast((index.centres, index.books, index.probes)), index.centres.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, codes = Index(*shared.value).placed(_rows(batch.column("vector"), dim))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "place": pa.array(own, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Index(*shared.value).visited(_rows(batch.column("vector"), dim)).tolist()
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "vector": batch.column("vector"), "extra": batch.column("extra"), "places": pa.array(lists, pa.list_(pa.int32()))}
            )

    known = queries.where(F.col("vector").isNotNull()).select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    if exclude is None:
        asked = known.withColumn("extra", F.lit(0).cast("long"))
    else:
        own = exclude.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("extra"))
        asked = known.join(own, "id", "left").fillna(0, ["extra"])
    asked = cut_lineage(asked)
    coded = cut_lineage(items.select("id", "vector").mapInArrow(place, f"id {thing}, place int, code binary"))
    visits = asked.mapInArrow(visit, f"id {asker}, vector array<double>, extra long, places array<int>")
    visits = visits.withColumn("place", F.explode("places")).drop("places")
    # slices by the size of each list; one row a list
    counts = coded.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    met = cut_lineage(visits.select("place").groupBy("place").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("asks")))
    sizes = F.broadcast(cut_lineage(counts.join(met, "place")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    drawn = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = visits.join(sizes, "place").withColumn("part", drawn("asks")).withColumn("slice", every("slices"))
    right = coded.join(sizes, "place").withColumn("slice", drawn("slices")).withColumn("part", every("asks"))
    kept, keys = widen * topn, ["place", "slice", "part"]
    picked = (
        left.select(*keys, "id", "vector", "extra").groupBy(*keys).cogroup(right.select(*keys, "id", "code").groupBy(*keys))
        .applyInArrow(lambda key, a, b: _best(Index(*shared.value), kept)(key, a, b), f"query {asker}, item {thing}, about double")
    )
    if exclude is not None:
        picked = picked.join(exclude.select(F.col("user_id").alias("query"), F.col("job_id").alias("item")), ["query", "item"], "left_anti")
    best = top_per_group(picked, ["query"], [F.desc("about"), F.asc("item")], kept).select("query", "item")
    pairs = best.join(asked.select(F.col("id").alias("query"), F.col("vector").alias("_q")), "query").join(
        items.select(F.col("id").alias("item"), F.transform("vector", lambda x: x.cast("double")).alias("_v")), "item"
    )
    score = F.round(F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x), 9)
    scored = pairs.select(F.col("query").alias("user_id"), F.col("item").alias("job_id"), score.alias("score"))
    return top_per_group(scored, ["user_id"], [F.desc("score"), F.asc("job_id")], topn)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, neighbours, recall): the share of the exact (user_id, job_id) pairs that were found."""
    found = exact.select("user_id", "job_id").join(approximate.select("user_id", "job_id", F.lit(1).alias("_f")), ["user_id", "job_id"], "left")
    return found.agg(F.countDistinct("user_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("_f") / F.count(F.lit(1))).alias("recall"))
