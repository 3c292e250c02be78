"""Learned path attention and the full pair head.

A pair's shared skills are weighted by a softmax over ``tanh([skill, user, job] A + a) . u``; their weighted sum is the path
vector, the mean of the skills the user lacks the gap vector. The score is ``user . job / sqrt(dim)`` plus a head with one
hidden layer over user, job, path, gap and rule features. A pair without shared skills has a path vector of zeros, one
without gaps a gap vector of zeros.

Pairs come as rows with their vectors (``pair_inputs``) or, in large jobs, as blocks that hold each vector once
(``pair_blocks``). Training is full-batch: every evaluation is one pass over the written pairs, in which each task adds up the loss and its
slopes over ragged pairs, and the sums are added in chunks by vector sums. Only the sums reach the driver, where a
limited-memory quasi-Newton step with a backtracking search is taken; their size follows from the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .pairs import attach_profiles
from .relations import gelu, normal_share  # noqa: F401
from .vectorsums import hub_slices, vector_sums

CHUNK = 4096
SLICE = 256
BLOCK = 16_384


@dataclass(frozen=True)
class Shape:
    """Sizes of the model: node vectors, rule features, hidden units of attention and head."""

    dim: int
    rules: int
    attention: int = 16
    hidden: int = 32

    def _parts(self) -> list[tuple[str, tuple[int, ...]]]:
        wide = 4 * self.dim + self.rules
        return [
            ("a", (3 * self.dim, self.attention)), ("a0", (self.attention,)), ("u", (self.attention,)),
            ("w", (wide, self.hidden)), ("w0", (self.hidden,)), ("v", (self.hidden,)), ("v0", (1,)),
        ]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self._parts())

    def unpacked(self, theta: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self._parts():
            n = int(np.prod(s))
            out[name], at = theta[at : at + n].reshape(s), at + n
        return out

    def packed(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.asarray(parts[name]).reshape(-1) for name, _ in self._parts()])

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return self.packed({name: rng.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 or name in "uv" else np.zeros(s) for name, s in self._parts()})


@dataclass
class Pairs:
    """Pairs as matrices; row ``r`` of the skill rows belongs to pair ``owner[r]`` (ascending) and is shared or a gap.

    Many pairs may read one vector: ``user_at``, ``job_at`` and ``skill_at`` name the row of ``user``, ``job`` and ``skills``
    that a pair or skill row reads. Without them there is a vector each, in order.
    """

    user: np.ndarray
    job: np.ndarray
    rules: np.ndarray
    skills: np.ndarray
    owner: np.ndarray
    shared: np.ndarray
    user_at: np.ndarray | None = None
    job_at: np.ndarray | None = None
    skill_at: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.user_at = np.arange(len(self.rules)) if self.user_at is None else self.user_at
        self.job_at = np.arange(len(self.rules)) if self.job_at is None else self.job_at
        self.skill_at = np.arange(len(self.owner)) if self.skill_at is None else self.skill_at


def _sums_at(columns: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the entries with the same place ``at``, for places 0 to ``n`` - 1, in each of the columns."""
    return np.stack([np.bincount(at, column, n) for column in columns], axis=1)


def _weighted_sums(columns: np.ndarray, read: np.ndarray, weight: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums by place ``at`` of the weighted entries that ``read`` names; column by column, so that what is held stays small."""
    return np.stack([np.bincount(at, column[read] * weight, n) for column in columns], axis=1)


def _columns(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows.T)


def _forward(model: dict[str, np.ndarray], p: Pairs) -> dict[str, np.ndarray]:
    """Scores and what their slopes need. Weights are applied to each vector once, and pairs add up the products."""
    n, dim = len(p.rules), p.user.shape[1]
    a_skill, a_user, a_job = np.split(model["a"], 3)
    w_user, w_job, w_path, w_gap, w_rule = np.split(model["w"], [dim, 2 * dim, 3 * dim, 4 * dim])
    own, at = p.owner[p.shared], p.skill_at[p.shared]
    pair_part = (p.user @ a_user)[p.user_at] + (p.job @ a_job)[p.job_at] + model["a0"]
    hidden = np.tanh((p.skills @ a_skill)[at] + pair_part[own])
    logits = hidden @ model["u"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, own, logits)
    weight = np.exp(logits - top[own])
    weight = weight / np.bincount(own, weight, n)[own]
    path_columns = _columns(p.skills @ w_path)
    lacking, gap_at = p.owner[~p.shared], p.skill_at[~p.shared]
    gap_weight = 1.0 / np.maximum(1, np.bincount(lacking, minlength=n))[lacking]
    before = (p.user @ w_user)[p.user_at] + (p.job @ w_job)[p.job_at] + p.rules @ w_rule + model["w0"]
    before += _weighted_sums(path_columns, at, weight, own, n) + _weighted_sums(_columns(p.skills @ w_gap), gap_at, gap_weight, lacking, n)
    share = normal_share(before)
    after = before * share
    score = np.einsum("ij,ij->i", p.user[p.user_at], p.job[p.job_at]) / np.sqrt(dim) + after @ model["v"] + model["v0"][0]
    return {
        "own": own, "at": at, "hidden": hidden, "weight": weight, "path_columns": path_columns, "lacking": lacking, "gap_at": gap_at,
        "gap_weight": gap_weight, "before": before, "share": share, "after": after, "score": score,
    }


def scores(shape: Shape, theta: np.ndarray, p: Pairs) -> np.ndarray:
    return _forward(shape.unpacked(theta), p)["score"]


def attention(shape: Shape, theta: np.ndarray, p: Pairs) -> np.ndarray:
    """Weights of the shared skill rows, in their order."""
    return _forward(shape.unpacked(theta), p)["weight"]


def loss_and_slopes(shape: Shape, theta: np.ndarray, p: Pairs, label: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed logistic loss of labels 0 and 1, and its slopes."""
    model = shape.unpacked(theta)
    f = _forward(model, p)
    own, at = f["own"], f["at"]
    n, n_user, n_job, n_skill = len(label), len(p.user), len(p.job), len(p.skills)
    loss = float((np.logaddexp(0, f["score"]) - label * f["score"]).sum())
    push = 0.5 * (1 + np.tanh(f["score"] / 2)) - label
    bell = np.exp(-0.5 * f["before"] ** 2) / np.sqrt(2 * np.pi)
    to_before = push[:, None] * model["v"] * (f["share"] + f["before"] * bell)
    before_columns = _columns(to_before)
    to_weight = np.zeros(len(own))
    for path, push_back in zip(f["path_columns"], before_columns, strict=True):
        to_weight += path[at] * push_back[own]
    mean = np.bincount(own, f["weight"] * to_weight, n)
    to_logit = f["weight"] * (to_weight - mean[own])
    to_inner = to_logit[:, None] * model["u"] * (1 - f["hidden"] ** 2)
    inner_columns = _columns(to_inner)
    # slopes are summed up by vector first, then meet each vector once
    of_pair = np.vstack([_columns(_sums_at(inner_columns, own, n)), before_columns])
    by_user, by_job = _sums_at(of_pair, p.user_at, n_user), _sums_at(of_pair, p.job_at, n_job)
    by_skill = np.hstack([_sums_at(inner_columns, at, n_skill), _weighted_sums(before_columns, own, f["weight"], at, n_skill)])
    by_gap = _weighted_sums(before_columns, f["lacking"], f["gap_weight"], f["gap_at"], n_skill)
    cut = shape.attention
    user, job, skill = p.user.T @ by_user, p.job.T @ by_job, p.skills.T @ by_skill
    slopes = {
        "a": np.vstack([skill[:, :cut], user[:, :cut], job[:, :cut]]), "a0": to_inner.sum(axis=0), "u": f["hidden"].T @ to_logit,
        "w": np.vstack([user[:, cut:], job[:, cut:], skill[:, cut:], p.skills.T @ by_gap, p.rules.T @ to_before]),
        "w0": to_before.sum(axis=0), "v": f["after"].T @ push, "v0": [push.sum()],
    }
    return loss, shape.packed(slopes)


# Pairs as rows --------------------------------------------------------------------------------


def pair_inputs(
    pairs: DataFrame, users: DataFrame, jobs: DataFrame, user_vectors: DataFrame, job_vectors: DataFrame, skill_vectors: DataFrame,
    rules: list[Column], dim: int,
) -> DataFrame:
    """(user_id, job_id, [label,] user_vector, job_vector, rules, skill_vectors, shared) of pairs of known users and jobs.

    ``user_vectors`` and ``job_vectors`` (id, vector), ``skill_vectors`` (skill, vector). A user or job without a vector gets
    zeros; a skill without one is left out. A job's skill vectors are brought together once per job, not per pair.
    """
    zero = F.array_repeat(F.lit(0.0), dim)
    listed = jobs.select("job_id", F.explode(F.array_distinct("skills")).alias("skill")).join(skill_vectors.select("skill", "vector"), "skill")
    of_job = listed.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("skill", "vector"))).alias("_listed"))
    posts = jobs.join(of_job, "job_id", "left").join(job_vectors.select(F.col("id").alias("job_id"), F.col("vector").alias("_vector")), "job_id", "left")
    people = users.join(user_vectors.select(F.col("id").alias("user_id"), F.col("vector").alias("user_vector")), "user_id", "left")
    keep = ["label"] if "label" in pairs.columns else []
    joined = attach_profiles(pairs.select("user_id", "job_id", *keep), people, posts)
    of_pair = F.coalesce("job__listed", F.array().cast("array<struct<skill:string,vector:array<double>>>"))
    return joined.withColumn("_s", of_pair).select(
        "user_id", "job_id", *keep, F.coalesce("user_vector", zero).alias("user_vector"), F.coalesce("job__vector", zero).alias("job_vector"),
        F.array(*[c.cast("double") for c in rules]).alias("rules"), F.col("_s.vector").alias("skill_vectors"),
        F.transform(F.col("_s.skill"), lambda s: F.coalesce(F.array_contains("skills", s), F.lit(False))).alias("shared"),
    )


@dataclass(frozen=True)
class PathTables:
    """People, posts and skills, each row with its vector and a number of its own; written, because blocks read them often."""

    people: DataFrame
    posts: DataFrame
    skills: DataFrame


def path_tables(users: DataFrame, jobs: DataFrame, user_vectors: DataFrame, job_vectors: DataFrame, skill_vectors: DataFrame, dim: int) -> PathTables:
    """The tables of ``pair_blocks``, from those of ``pair_inputs``."""
    zero = F.array_repeat(F.lit(0.0), dim)

    def numbered(df: DataFrame) -> DataFrame:
        return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))

    def whole(side: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
        own = side.join(vectors.select(F.col("id").alias(key), F.col("vector").alias("_vector")), key, "left")
        return numbered(own.withColumn("_vector", F.coalesce("_vector", zero)))

    skills = numbered(skill_vectors.select("skill", F.col("vector").alias("_vector")))
    names = jobs.select("job_id", F.explode(F.array_distinct("skills")).alias("skill")).join(skills.select("skill", F.col("_row").alias("_skill")), "skill")
    of_job = names.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("skill", "_skill"))).alias("_listed"))
    none = F.array().cast("array<struct<skill:string,_skill:bigint>>")
    posts = jobs.join(of_job, "job_id", "left").withColumn("_listed", F.coalesce("_listed", none))
    return PathTables(whole(users, user_vectors, "user_id"), whole(posts, job_vectors, "job_id"), skills)


def pair_blocks(pairs: DataFrame, tables: PathTables, rules: list[Column], block_pairs: int = BLOCK) -> DataFrame:
    """The rows of ``pair_inputs`` in blocks: (block, pairs, people, posts, skills), written.

    A block holds the pairs of some users and each vector that they read once, so a vector is neither sent nor stored with
    every pair. Blocks hold about ``block_pairs`` pairs; a user with more is dealt to several by job.
    """
    keep = ["label"] if "label" in pairs.columns else []
    pairs = cut_lineage(pairs.select("user_id", "job_id", *keep))
    n, cores = pairs.count(), pairs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block_pairs), min(cores, n // 1024))
    dealt, _ = hub_slices(pairs, ["user_id"], "job_id", block_pairs)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("user_id", "slice"), F.lit(blocks)))
    shared = F.transform("job__listed.skill", lambda s: F.coalesce(F.array_contains("skills", s), F.lit(False)))
    joined = attach_profiles(dealt.drop("slice"), tables.people.drop("_vector").withColumnRenamed("_row", "person"), tables.posts.drop("_vector"))
    rows = written(
        joined.select(
            "block", "user_id", "job_id", *keep, F.array(*[c.cast("double") for c in rules]).alias("rules"), "person",
            F.col("job__row").alias("post"), shared.alias("shared"),
        ),
        "pairs",
    )

    def listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))

    used = tables.posts.select(F.col("_row").alias("post"), F.col("_vector").alias("vector"), F.col("_listed._skill").alias("skills"))
    people = tables.people.select(F.col("_row").alias("person"), F.col("_vector").alias("vector"))
    skills = tables.skills.select(F.col("_row").alias("skill"), F.col("_vector").alias("vector"))
    met = rows.select("block", "post").distinct().join(used, "post")
    heard = rows.select("block", "post").distinct().join(used.select("post", F.explode("skills").alias("skill")), "post").select("block", "skill").distinct()
    whole = listed(rows, "pairs", *[c for c in rows.columns if c != "block"])
    whole = whole.join(listed(rows.select("block", "person").distinct().join(people, "person"), "people", "person", "vector"), "block")
    whole = whole.join(listed(met, "posts", "post", "vector", "skills"), "block")
    whole = whole.join(listed(heard.join(skills, "skill"), "skills", "skill", "vector"), "block", "left")
    return written(whole.repartition(min(blocks, max(4 * cores, blocks // 16))), "blocks")


def _vectors(found: pa.Array, key: str, dim: int) -> tuple[pa.Array, np.ndarray]:
    return found.field(key), _rows(found.field("vector"), dim)


def _block_runs(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[pa.StructArray, Pairs]]:
    """Pairs of each block and their matrices, at most ``BLOCK`` pairs at a time."""
    for place in range(batch.num_rows):
        rows, posts = batch.column("pairs")[place].values, batch.column("posts")[place].values
        people, users = _vectors(batch.column("people")[place].values, "person", shape.dim)
        post_rows, jobs = _vectors(posts, "post", shape.dim)
        named = batch.column("skills")[place].values
        heard, skills = _vectors(named, "skill", shape.dim) if named is not None else (pa.array([], pa.int64()), np.zeros((0, shape.dim)))
        lists = posts.field("skills")
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(length) - length
        code = _places(lists.flatten(), heard)
        user_at, job_at = _places(rows.field("person"), people), _places(rows.field("post"), post_rows)
        for at in range(0, len(rows), BLOCK):
            some = rows.slice(at, BLOCK)
            own = job_at[at : at + BLOCK]
            counts = length[own]
            owner = np.repeat(np.arange(len(some)), counts)
            entry = np.repeat(begin[own] - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
            flags = some.field("shared").flatten().to_numpy(zero_copy_only=False).astype(bool)
            rules = _rows(some.field("rules"), shape.rules)
            yield some, Pairs(users, jobs, rules, skills, owner, flags, user_at[at : at + BLOCK], own, code[entry])


def _places(values: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.index_in(values, value_set=among).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[pa.RecordBatch | pa.StructArray, Pairs]]:
    """Runs of pairs of a batch of either form, with the columns of the pairs."""
    return _block_runs(batch, shape) if "posts" in batch.schema.names else _slices(batch, shape)


def _column(some: pa.RecordBatch | pa.StructArray, name: str) -> pa.Array:
    return some.field(name) if isinstance(some, pa.StructArray) else some.column(name)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _slices(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[pa.RecordBatch, Pairs]]:
    """Runs of pairs, so that the matrices of a run stay small however large a batch is."""
    for at in range(0, batch.num_rows, SLICE):
        some = batch.slice(at, SLICE)
        flags = some.column("shared")
        counts = np.asarray([len(f) for f in flags.to_pylist()], np.int64)
        yield some, Pairs(
            _rows(some.column("user_vector"), shape.dim), _rows(some.column("job_vector"), shape.dim), _rows(some.column("rules"), shape.rules),
            _rows(some.column("skill_vectors").flatten(), shape.dim), np.repeat(np.arange(len(counts)), counts),
            flags.flatten().to_numpy(zero_copy_only=False).astype(bool),
        )


def _summing(shape: Shape, theta: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape.size + 2)
        for batch in batches:
            for some, pairs in _runs(batch, shape):
                label = _column(some, "label").to_numpy(zero_copy_only=False)
                loss, slopes = loss_and_slopes(shape, theta, pairs, label)
                sums += np.concatenate([[loss, len(label)], slopes])
        if sums[1]:
            cut = [sums[at : at + CHUNK].tolist() for at in range(0, len(sums), CHUNK)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(cut)), pa.int32()), "vector": pa.array(cut, pa.list_(pa.float64()))})

    return total


def quasi_newton(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, steps: int, memory: int = 8, tolerance: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Limited-memory quasi-Newton descent; the value after every step. Ends early where no step lowers the value, or only by
    ``tolerance`` of it."""
    value, slope = evaluate(theta)
    values, met = [value], []
    for _ in range(steps):
        direction, used = slope.copy(), []
        for s, y in reversed(met):
            share = (s @ direction) / (s @ y)
            used.append(share)
            direction -= share * y
        if met:
            s, y = met[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y), share in zip(met, reversed(used), strict=True):
            direction += (share - (y @ direction) / (s @ y)) * s
        fall, rate = float(slope @ direction), 1.0
        while rate > 1e-6:
            tried = theta - rate * direction
            new_value, new_slope = evaluate(tried)
            if new_value <= value - 1e-4 * rate * fall:
                break
            rate /= 4
        else:
            return theta, values
        if (tried - theta) @ (new_slope - slope) > 1e-12:
            met = [*met, (tried - theta, new_slope - slope)][-memory:]
        gained = value - new_value
        theta, value, slope = tried, new_value, new_slope
        values.append(value)
        if gained < tolerance * abs(value):
            break
    return theta, values


@dataclass
class PathModel:
    """``losses``: mean loss with the penalty, before the first and after every step."""

    shape: Shape
    theta: np.ndarray
    losses: list[float]


def train_path_model(labelled: DataFrame, shape: Shape, steps: int = 20, decay: float = 1e-3, seed: int = 7) -> PathModel:
    """Fit the model to rows of ``pair_inputs`` or ``pair_blocks`` with a ``label`` of 0 or 1; ``decay`` is the weight of half the squares."""
    context = labelled.sparkSession.sparkContext
    rows = labelled if "posts" in labelled.columns else written(labelled, "pairs")

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast(theta)
        parts = rows.mapInArrow(lambda batches: _summing(shape, shared.value)(batches), "chunk int, vector array<double>")
        found = {r.chunk: r.vector for r in vector_sums(parts, ["chunk"]).collect()}
        shared.unpersist()
        if not found:
            return 0.0, np.zeros_like(theta)
        sums = np.concatenate([found[i] for i in sorted(found)])
        return sums[0] / sums[1] + 0.5 * decay * float(theta @ theta), sums[2:] / sums[1] + decay * theta

    theta, losses = quasi_newton(evaluate, shape.start(seed), steps)
    return PathModel(shape, theta, losses)


def score_paths(model: PathModel, inputs: DataFrame) -> DataFrame:
    """(user_id, job_id, score, attention) of the rows of ``pair_inputs`` or ``pair_blocks``; one weight per shared skill, in skill order."""
    shape, shared = model.shape, inputs.sparkSession.sparkContext.broadcast(model.theta)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, pairs in _runs(batch, shape):
                found = _forward(shape.unpacked(shared.value), pairs)
                ends = np.cumsum(np.bincount(found["own"], minlength=len(pairs.rules)))
                weights = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found["weight"], pa.float64()))
                yield pa.RecordBatch.from_pydict(
                    {"user_id": _column(some, "user_id"), "job_id": _column(some, "job_id"), "score": pa.array(found["score"], pa.float64()), "attention": weights}
                )

    pair = inputs.schema["pairs"].dataType.elementType if "posts" in inputs.columns else inputs.schema
    ids = ", ".join(f"{c} {pair[c].dataType.simpleString()}" for c in ("user_id", "job_id"))
    return inputs.mapInArrow(apply, f"{ids}, score double, attention array<double>")
