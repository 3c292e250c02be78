"""Any page of a job's ranking of all users, without sorting the users.

A request names a job, what to sort by, and a page. The users are scored against a block of requests in one pass and only
counted: rows per range of the sort value. The ranges in which a page begins and ends are found from the running counts and
are cut into finer ranges, by value and, where many users share one value, by the place of their id, until each holds few
rows. Only the rows from the first to the last of these are sorted. Every pass is one scan of the users with partial counts; a hot
value costs further counts, never a large sort. The number of passes grows with the logarithm of the number of users unless
the values are spread very unevenly. Tasks hold users of neighbouring places, so once a range is cut by place a request meets
only the users of that range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import exploded_range, global_position

BINS = 256
FEW = 1024
REQUEST_BLOCK = 512
TASK_USERS = 4096
TASK_PLACES = 32_768  # of a task that counts in NumPy
CELLS = 2_000_000
MET_ROWS = 65_536
UNKNOWN = -1e300  # sorts after every value that is known
_LAST = np.iinfo(np.int64).max
_BOUNDS = "low double, high double, low_place bigint, high_place bigint, inside bigint"
Score = Callable[[DataFrame], DataFrame]
BlockScore = Callable[[pa.Table, pa.Table], Callable[[int, int], np.ndarray | tuple[np.ndarray, np.ndarray]]]


def _ahead(value: Column, place: Column, high: Column, low_place: Column) -> Column:
    """Whether a row comes before the range that begins at (high, low_place): values fall, places rise."""
    return (value > high) | ((value == high) & (place < low_place))


def _behind(value: Column, place: Column, low: Column, high_place: Column) -> Column:
    return (value < low) | ((value == low) & (place > high_place))


def _bounds() -> list[Column]:
    return [
        F.min("value").alias("low"), F.max("value").alias("high"), F.min("place").alias("low_place"), F.max("place").alias("high_place"),
        F.count(F.lit(1)).alias("inside"),
    ]


class _Scored:
    """A block's rows as one table: ``score`` runs in every pass."""

    def __init__(self, people: DataFrame, requests: DataFrame, score: Score):
        rows = _known(score(people.crossJoin(F.broadcast(requests))))
        self.rows = rows.drop(*[c for c in requests.columns if c != "request_id"])

    def whole(self) -> DataFrame:
        return self.rows.groupBy("request_id").agg(*_bounds())

    def counted(self, state: DataFrame, bins: int) -> DataFrame:
        ranges = F.broadcast(state.drop("inside"))  # two rows a request of the block
        rows = self.rows.join(ranges, "request_id").where(
            F.col("value").between(F.col("low"), F.col("high")) & F.col("place").between(F.col("low_place"), F.col("high_place"))
        )
        by_value = F.floor((F.col("high") - F.col("value")) / (F.col("high") - F.col("low")) * bins)
        by_place = F.floor((F.col("place") - F.col("low_place")) / (F.col("high_place") - F.col("low_place") + 1) * bins)
        part = F.least(F.lit(bins - 1), F.when(F.col("high") > F.col("low"), by_value).otherwise(by_place))
        return rows.groupBy("request_id", "end", "target", "before", part.alias("_part")).agg(*_bounds())

    def met(self, pages: DataFrame) -> DataFrame:
        value, place = F.col("value"), F.col("place")
        return self.rows.join(F.broadcast(pages), "request_id").where(
            ~_ahead(value, place, F.col("high"), F.col("low_place")) & ~_behind(value, place, F.col("low"), F.col("high_place"))
        )

    def finished(self, shown: DataFrame) -> DataFrame:
        return shown


class _Levels:
    """Values of a run of requests (rows) and some users in the order of their places, as codes and a table of each request's values."""

    def __init__(self, found: np.ndarray | tuple[np.ndarray, np.ndarray], places: np.ndarray):
        self.places = places
        if isinstance(found, tuple):
            self.codes, table = found
        else:
            self.codes, table = None, found
        self.table = np.where(np.isnan(table), UNKNOWN, table)

    def between(self, low_place: int, high_place: int) -> slice:
        return slice(*np.searchsorted(self.places, [low_place, high_place + 1]))

    def counts(self, rows: np.ndarray, inside: list[slice]) -> tuple[np.ndarray, np.ndarray]:
        """(values, how often) of a run of users for each of some rows."""
        if self.codes is None:
            n, at = np.zeros((len(rows), len(self.places)), np.int64), np.arange(len(self.places))
            for k, own in enumerate(inside):
                n[k] = (at >= own.start) & (at < own.stop)
        else:
            n = np.empty((len(rows), self.table.shape[1]), np.int64)
            for k, (row, own) in enumerate(zip(rows, inside, strict=True)):
                n[k] = np.bincount(self.codes[row, own], minlength=n.shape[1])
        return self.table[rows], n

    def among(self, row: int, low: float, high: float, own: slice) -> np.ndarray:
        """Which of a run of users have a value from ``low`` to ``high``."""
        level = (self.table[row] >= low) & (self.table[row] <= high)
        return own.start + np.flatnonzero(level[own] if self.codes is None else level[self.codes[row, own]])

    def values(self, row: int, at: np.ndarray) -> np.ndarray:
        return self.table[row, at if self.codes is None else self.codes[row, at]]


class _Valued:
    """A block's values as matrices: a task holds the requests of the block and a batch of users, and passes on counts."""

    def __init__(self, people: DataFrame, requests: DataFrame, score: Score, values: BlockScore, reads: Sequence[str] | None, limits: tuple[float, float, int] | None):
        self.people, self.requests, self.score, self.values, self.limits = people, requests, score, values, limits
        self.read = people.select("place", *reads) if reads is not None else people
        self.asked = requests.toArrow()  # a block of requests
        self.names = self.asked.column("request_id").to_pylist()
        self.kind = requests.schema["request_id"].dataType.simpleString()

    def _passed(self, task: Callable[[Iterator[tuple[np.ndarray, _Levels]]], Iterator[pa.RecordBatch]], schema: str, first: np.ndarray | None = None, last: np.ndarray | None = None) -> DataFrame:
        """``task`` over (numbers of some requests, their values for a batch of users) of the batches of a task.

        ``first`` and ``last`` are the places between which each request looks for users; a request without any meets none.
        """
        asked, values = self.asked, self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def cells() -> Iterator[tuple[np.ndarray, _Levels]]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    order = np.argsort(batch.column("place").to_numpy(), kind="stable")
                    users = pa.Table.from_batches([batch]).take(pa.array(order))
                    places = users.column("place").to_numpy()
                    met = np.arange(asked.num_rows) if first is None else np.flatnonzero((first <= places[-1]) & (last >= places[0]))
                    if not len(met):
                        continue
                    rows_of, step = values(asked if len(met) == asked.num_rows else asked.take(pa.array(met)), users), max(1, CELLS // len(places))
                    for at in range(0, len(met), step):
                        yield met[at : at + step], _Levels(rows_of(at, min(len(met), at + step)), places)

            yield from task(cells())

        return self.read.mapInArrow(run, schema)

    def whole(self) -> DataFrame:
        n = len(self.names)
        if self.limits is not None:  # nothing to look for
            least, most, total = self.limits
            rows = [(name, least, most, 0, total - 1, total) for name in self.names if total]
            return self.people.sparkSession.createDataFrame(rows, f"request_id {self.kind}, {_BOUNDS}")

        def task(cells):
            low, high, inside, ends = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64), []
            for met, found in cells:
                value, count = found.counts(np.arange(len(met)), [slice(0, len(found.places))] * len(met))
                low[met] = np.minimum(low[met], np.where(count > 0, value, np.inf).min(axis=1))
                high[met] = np.maximum(high[met], np.where(count > 0, value, -np.inf).max(axis=1))
                inside[met] += len(found.places)
                ends += [found.places[0], found.places[-1]]
            if ends:
                yield _batch(np.arange(n), low, high, np.full(n, min(ends)), np.full(n, max(ends)), inside)

        return self._named(self._passed(task, f"_r int, {_BOUNDS}").groupBy("_r").agg(*_added()))

    def counted(self, state: DataFrame, bins: int) -> DataFrame:
        rows = state.select("request_id", "end", "target", "before", "low", "high", "low_place", "high_place").collect()  # two rows a request
        at_name = {name: i for i, name in enumerate(self.names)}
        # a range that both ends of a page lie in is counted once
        numbered: dict[tuple, int] = {}
        plan = [(numbered.setdefault((at_name[r.request_id], r.low, r.high, r.low_place, r.high_place), len(numbered)), r.request_id, r.end, r.target, r.before) for r in rows]
        ranges, by_request = list(numbered), [[] for _ in self.names]
        for i, (r, *_) in enumerate(ranges):
            by_request[r].append(i)
        first, last = self._places(ranges)
        bounds = [np.array([x[k] for x in ranges], kind) for k, kind in ((1, np.float64), (2, np.float64), (3, np.int64), (4, np.int64))]

        def task(cells):
            inside = np.zeros((len(ranges), bins), np.int64)
            least, most = np.full(inside.shape, np.inf), np.full(inside.shape, -np.inf)
            for met, found in cells:
                row_of, mine, own = [], [], []
                for row, r in enumerate(met.tolist()):
                    for i in by_request[r]:
                        _, low, high, low_place, high_place = ranges[i]
                        users = found.between(low_place, high_place)
                        if high > low:
                            row_of.append(row)
                            mine.append(i)
                            own.append(users)
                        elif users.start < users.stop:
                            at = found.places[found.among(row, low, high, users)] - low_place
                            inside[i] += np.bincount(at * bins // (high_place - low_place + 1), minlength=bins)
                if mine:  # by value
                    value, n = found.counts(np.array(row_of), own)
                    mine = np.array(mine)
                    low, high = (bound[mine] for bound in bounds[:2])
                    k, at = np.nonzero((n > 0) & (value >= low[:, None]) & (value <= high[:, None]))
                    value, n = value[k, at], n[k, at]
                    part = np.minimum(bins - 1, np.floor((high[k] - value) / (high[k] - low[k]) * bins)).astype(np.int64)
                    for put, into, x in ((np.add, inside, n), (np.minimum, least, value), (np.maximum, most, value)):
                        put.at(into, (mine[k], part), x)
            i, part = np.nonzero(inside)
            low, high, low_place, high_place = (bound[i] for bound in bounds)
            by_value, wide = high > low, high_place - low_place + 1
            # a part by place holds the places from the first that falls into it to the last
            begin, end = (low_place - (-(part + k) * wide // bins) for k in (0, 1))
            yield _batch(
                i, np.where(by_value, least[i, part], low), np.where(by_value, most[i, part], high), np.where(by_value, low_place, begin),
                np.where(by_value, high_place, end - 1), inside[i, part], part,
            )

        counted = self._passed(task, f"_i int, {_BOUNDS}, _part bigint", first, last).groupBy("_i", "_part").agg(*_added())
        named = self.people.sparkSession.createDataFrame(plan, f"_i int, request_id {self.kind}, end string, target bigint, before bigint")
        return counted.join(F.broadcast(named), "_i").drop("_i")

    def _places(self, ranges: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the ranges (request, low, high, low place, high place) of each request."""
        first, last = np.full(len(self.names), _LAST), np.full(len(self.names), -1)
        for r, _, _, low_place, high_place in ranges:
            first[r], last[r] = min(first[r], low_place), max(last[r], high_place)
        return first, last

    def met(self, pages: DataFrame) -> DataFrame:
        at_name = {name: i for i, name in enumerate(self.names)}
        found = pages.select("request_id", "low", "high", "low_place", "high_place").collect()  # one row a request
        ranges = {at_name[r.request_id]: (r.low, r.high, r.low_place, r.high_place) for r in found}
        # a page of one value lies between two places; others hold whole values
        first, last = self._places([(r, low, high, *((low_place, high_place) if low == high else (0, _LAST - 1))) for r, (low, high, low_place, high_place) in ranges.items()])

        def task(cells):
            held, n = [], 0

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)) for part in zip(*held, strict=True)], ["_r", "place", "value"])

            for met, found in cells:
                for row, r in enumerate(met.tolist()):
                    low, high, low_place, high_place = ranges[r]
                    on = found.among(row, low, high, found.between(first[r], last[r]))
                    value, places = found.values(row, on), found.places[on]
                    shown = ~((value == high) & (places < low_place)) & ~((value == low) & (places > high_place))
                    held.append((np.full(np.count_nonzero(shown), r, np.int32), places[shown], value[shown]))
                    n += len(held[-1][0])
                    if n >= MET_ROWS:
                        yield batch()
                        held, n = [], 0
            if n:
                yield batch()

        return self._named(self._passed(task, "_r int, place bigint, value double", first, last)).join(F.broadcast(pages), "request_id")

    def finished(self, shown: DataFrame) -> DataFrame:
        """The other columns of the rows shown, by ``score``."""
        pairs = shown.select("request_id", F.col("_user").alias("place"))
        rows = _known(self.score(pairs.join(self.people, "place").join(F.broadcast(self.requests), "request_id")))
        rows = rows.drop(*[c for c in self.requests.columns if c != "request_id"]).withColumnRenamed("place", "_user")
        return rows.join(shown.drop("value"), ["request_id", "_user"])

    def _named(self, rows: DataFrame) -> DataFrame:
        names = self.people.sparkSession.createDataFrame(list(enumerate(self.names)), f"_r int, request_id {self.kind}")
        return rows.join(F.broadcast(names), "_r").drop("_r")


def _batch(key: np.ndarray, low: np.ndarray, high: np.ndarray, low_place: np.ndarray, high_place: np.ndarray, inside: np.ndarray, part: np.ndarray | None = None) -> pa.RecordBatch:
    columns = {"_r" if part is None else "_i": key.astype(np.int32), "low": low, "high": high, "low_place": low_place.astype(np.int64), "high_place": high_place.astype(np.int64), "inside": inside}
    return pa.RecordBatch.from_pydict(columns if part is None else columns | {"_part": part})


def _added() -> list[Column]:
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_place").alias("low_place"), F.max("high_place").alias("high_place"), F.sum("inside").alias("inside")]


def _narrowed(rows: _Scored | _Valued, state: DataFrame, bins: int) -> DataFrame:
    """One pass: each range of ``state`` gives way to the one of its parts that holds its target position."""
    counted = rows.counted(state, bins)
    # at most ``bins`` rows a range
    running = F.sum("inside").over(W.partitionBy("request_id", "end").orderBy("_part")) - F.col("inside")
    found = counted.withColumn("before", F.col("before") + running)
    return found.where((F.col("before") <= F.col("target")) & (F.col("target") < F.col("before") + F.col("inside"))).drop("_part")


def _block_pages(rows: _Scored | _Valued, requests: DataFrame, bins: int, few: int) -> DataFrame:
    first = (F.col("page") - 1) * F.col("page_size")
    whole = cut_lineage(rows.whole())
    asked = requests.join(F.broadcast(whole), "request_id").withColumn("total", F.col("inside")).withColumn("_first", first)
    asked = asked.where(F.col("_first") < F.col("total"))
    last = F.least(F.col("_first") + F.col("page_size"), F.col("total")) - 1
    ends = F.explode(F.array(F.struct(F.lit("first").alias("end"), F.col("_first").alias("target")), F.struct(F.lit("last").alias("end"), last.alias("target"))))
    names = ["request_id", "end", "target", "before", "low", "high", "low_place", "high_place", "inside"]
    begun = asked.withColumn("_e", ends).withColumn("before", F.lit(0).cast("long")).select("request_id", "_e.end", "_e.target", *names[3:])
    state = cut_lineage(begun)
    while not (wide := state.where(F.col("inside") > few)).isEmpty():
        state = cut_lineage(state.where(F.col("inside") <= few).unionByName(_narrowed(rows, wide, bins).select(*names)))
    starts = state.where(F.col("end") == "first").select("request_id", "high", "low_place", "before")
    stops = state.where(F.col("end") == "last").select("request_id", "low", "high_place")
    pages = asked.select(*requests.columns, "total").join(starts, "request_id").join(stops, "request_id")
    # at most a page and two narrow ranges a request
    order = W.partitionBy("request_id").orderBy(F.desc("value"), "place")
    numbered = rows.met(pages).withColumn("_user", F.col("place")).withColumn("place", F.col("before") + F.row_number().over(order))
    first = (F.col("page") - 1) * F.col("page_size")
    shown = numbered.where((F.col("place") > first) & (F.col("place") <= first + F.col("page_size")))
    shown = rows.finished(cut_lineage(shown) if isinstance(rows, _Valued) else shown)  # read twice
    return shown.withColumn("total_pages", F.ceil(F.col("total") / F.col("page_size")).cast("long")).drop("before", "high", "low", "low_place", "high_place", "_user")


def _known(rows: DataFrame, name: str = "value") -> DataFrame:
    """Unknown values (null, NaN) sort after all others."""
    return rows.withColumn(name, F.when(F.col(name).isNotNull() & ~F.isnan(name), F.col(name)).otherwise(F.lit(UNKNOWN)))


def _own_pages(requests: DataFrame, people: DataFrame, total: int, value: Column, score: Score) -> DataFrame:
    """Pages of requests that sort by a value of the users alone: one order for all of them, met by place."""
    first = (F.col("page") - 1).cast("long") * F.col("page_size")
    last = F.least(first + F.col("page_size"), F.lit(total)) - 1
    asked = requests.where((first < total) & (F.col("page_size") > 0)).withColumn("total", F.lit(total).cast("long")).withColumn("total_pages", F.ceil(F.lit(total) / F.col("page_size")).cast("long"))
    wanted = exploded_range(asked.withColumn("_first", first), last - F.col("_first") + 1, "_step").withColumn("_at", F.col("_first") + F.col("_step"))
    order = _known(people.select("user_id", "place", value.cast("double").alias("_own")), "_own")
    numbered = cut_lineage(global_position(order, [F.desc("_own"), F.asc("place")], "_at"))
    met = wanted.join(numbered.select("_at", "place"), "_at").join(people, "place")
    shown = _known(score(met.drop("_at", "_first", "_step", "total", "total_pages")))
    shown = shown.drop(*[c for c in requests.columns if c != "request_id"])
    places = numbered.select(F.col("place"), (F.col("_at") + 1).alias("_shown"))
    return asked.join(shown, "request_id").join(places, "place").withColumn("place", F.col("_shown")).drop("_shown")


def candidate_pages(
    requests: DataFrame, users: DataFrame, score: Score, block: int = REQUEST_BLOCK, bins: int = BINS, few: int = FEW,
    own_order: Mapping[str, str] | None = None, kind: str = "sort_by", values: BlockScore | None = None,
    reads: Sequence[str] | None = None, limits: tuple[float, float] | None = None,
) -> DataFrame:
    """The asked page of all ``users`` (user_id, ...) for each of ``requests`` (request_id, page, page_size, ...).

    ``score`` takes rows that hold the columns of a user and of a request and returns them with ``value``, a double to
    sort by, highest first; users with equal values come in the order of their ids, users without a value (null, NaN) last.
    It is applied in every pass, so it must give the same value each time. Requests are a stated set of queries: they meet the users
    in blocks of ``block`` rows. Request ids are unique and pages begin at 1; a page beyond the last one has no rows.

    ``own_order`` names, by the value that a request has in the column ``kind``, the column of ``users`` that ``score`` gives as
    ``value`` for such requests. That order is the same for all of them: the users are numbered once, a request looks up the
    places of its page, and only those pairs are scored.

    ``values(requests, users)`` prepares two Arrow tables and returns a function that gives the matrix of ``value`` for a slice
    of the requests (NaN: unknown), or, where values are few, two matrices: a code of each pair, and the value of each code for each
    request. With it the passes run in NumPy, and ``score`` is applied only to the rows of the pages. ``reads`` names the columns of
    the users that ``values`` needs, if not all. ``limits`` states that every value is known and lies between two numbers, which
    saves the pass that finds them.
    Returns the scored columns with ``place`` (from 1), ``total`` and ``total_pages``.
    """
    if block < 1 or bins < 2 or few < 1:
        raise ValueError("a block holds a request, a range has two parts, and few is at least 1")
    people = cut_lineage(global_position(users, ["user_id"], "place"))
    total = people.count()
    cores = users.sparkSession.sparkContext.defaultParallelism
    if values:  # a task counts its users in NumPy before it passes anything on
        people = people.repartitionByRange(cores * max(1, ceil(total / TASK_PLACES / cores)), "place").sortWithinPartitions("place")
    else:  # every pass is costly per user and request: one task for a few thousand users
        people = people.repartition(max(cores, ceil(total / TASK_USERS)))
    people = cut_lineage(people)
    found = None
    compared = requests
    if own_order:
        stated = F.coalesce(F.col(kind).isin(list(own_order)), F.lit(False))
        compared = requests.where(~stated)
        for name, column in own_order.items():
            pages = _own_pages(requests.where(F.col(kind) == name), people, total, F.col(column), score)
            found = pages if found is None else found.unionByName(pages)
    asked = cut_lineage(global_position(compared, ["request_id"], "_at"))
    n = asked.count()
    for start in range(0, n if found is not None else max(n, 1), block):
        some = asked.where((F.col("_at") >= start) & (F.col("_at") < start + block)).drop("_at")
        rows = _Valued(people, some, score, values, reads, limits and (*map(float, limits), total)) if values else _Scored(people, some, score)
        own = [c for c in some.columns if c not in ("page", "page_size")]
        pages = _block_pages(rows, some.select(*own, "page", "page_size"), bins, few)
        found = pages if found is None else found.unionByName(pages)
    return found
