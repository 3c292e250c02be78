"""Negative sampling: seeded, deterministic, and never a known positive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .dense import dense_rankings
from .neighbours import approximate_rankings
from .ordering import exploded_range, global_position, position_in_group


def seeded(*keys: str, seed: int) -> Column:
    """A number from 0 to 2**60 - 1 drawn from the keys' text: the first 15 hex digits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys, F.lit(seed))), 1, 15), 16, 10).cast("long")


def shuffled_catalogue(jobs: DataFrame, seed: int, bucket: list[str] | None = None) -> DataFrame:
    """Catalogue with a seeded random place: global, or inside each bucket together with the bucket size."""
    keyed = jobs.select("job_id", *(bucket or [])).withColumn("_mix", seeded("job_id", seed=seed))
    if not bucket:
        return global_position(keyed, ["_mix", "job_id"], "place").drop("_mix")
    placed = position_in_group(keyed, bucket, ["_mix", "job_id"], "place").drop("_mix")
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, bucket)


def _start(seed: int, size: Column, *keys: str) -> Column:
    return F.pmod(seeded(*keys, seed=seed), size)


def uniform_negatives(pairs: DataFrame, jobs: DataFrame, known: DataFrame, per_pair: int, seed: int) -> DataFrame:
    """(user_id, job_id, draw, negative_id): ``per_pair`` negatives for every positive pair.

    The catalogue is put in a seeded random order, and each user reads a run of it from a random start.
    A run of ``wanted + known`` places holds at least ``wanted`` jobs that are no known positive, so no
    retries are needed and the rows made are bounded by the output plus the known pairs. A user that
    wants more negatives than exist starts over.
    """
    catalogue = shuffled_catalogue(jobs, seed)
    n_jobs = catalogue.count()
    size = F.lit(n_jobs).cast("long")
    wanted = pairs.groupBy("user_id").agg((F.count(F.lit(1)) * per_pair).alias("_wanted"))
    blocked = known.join(wanted.select("user_id"), "user_id", "left_semi").select("user_id", "job_id").distinct()
    counts = blocked.groupBy("user_id").agg(F.count(F.lit(1)).alias("_known"))
    runs = wanted.join(counts, "user_id", "left").fillna(0, ["_known"])
    steps = exploded_range(runs, F.least(size, F.col("_wanted") + F.col("_known")), "_step")
    places = steps.select("user_id", "_step").withColumn(
        "place", (_start(seed, size, "user_id") + F.col("_step")) % size
    )
    free = places.join(catalogue, "place").join(blocked, ["user_id", "job_id"], "left_anti")
    pool = position_in_group(free.select("user_id", "job_id", "_step"), ["user_id"], ["_step"], "_slot").select(
        "user_id", "_slot", F.col("job_id").alias("negative_id")
    )
    pool_sizes = pool.groupBy("user_id").agg(F.count(F.lit(1)).alias("_pool"))
    numbered = position_in_group(pairs.select("user_id", "job_id"), ["user_id"], ["job_id"], "_pair")
    draws = numbered.join(pool_sizes, "user_id").select(
        "user_id", "job_id", "_pair", "_pool", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1))).alias("draw")
    )
    slot = (F.col("_pair") * per_pair + F.col("draw")) % F.col("_pool")
    return draws.withColumn("_slot", slot).join(pool, ["user_id", "_slot"]).select("user_id", "job_id", "draw", "negative_id")


def sampled_pool(users: DataFrame, jobs: DataFrame, known: DataFrame, n: int, seed: int) -> DataFrame:
    """(user_id, job_id): ``n`` distinct non-positive jobs per user, or all of them when there are fewer."""
    one = users.select("user_id").withColumn("job_id", F.lit(None).cast(jobs.schema["job_id"].dataType))
    return uniform_negatives(one, jobs, known, n, seed).select("user_id", F.col("negative_id").alias("job_id")).distinct()


def semantic_negatives(
    user_vectors: DataFrame, job_vectors: DataFrame, seen: DataFrame, top: int = 200, approximate: bool = False, **options
) -> DataFrame:
    """(user_id, job_id, score, rank): the ``top`` most similar jobs the user never touched, however many it has seen.

    ``approximate`` looks only where inverted lists lead; ``options`` go to the search.
    """
    search = approximate_rankings if approximate else dense_rankings
    return search(user_vectors, job_vectors, top, seen, **options)


def structural_negatives(
    pairs: DataFrame, jobs: DataFrame, known: DataFrame, seed: int, bucket: tuple[str, ...] = ("job_type", "city")
) -> DataFrame:
    """(user_id, job_id, negative_id): one job of the same type and city as the positive, not a known positive.

    Each pair reads a run of its bucket's shuffled places from a random start. A run of as many places as the user knows
    jobs in the bucket, plus one, holds a free job if there is one; a pair whose user knows the whole bucket has a NULL
    ``negative_id``. Places meet the bucket on (bucket, place), so a bucket holding a third of all jobs is never paired
    with all its positives.
    """
    keys = list(bucket)
    placed = shuffled_catalogue(jobs, seed, keys)
    sizes = placed.select("job_id", *keys, "size")
    blocked = known.select("user_id", "job_id").distinct()
    taken = blocked.join(placed.select("job_id", *keys), "job_id").groupBy("user_id", *keys).agg(F.count(F.lit(1)).alias("_taken"))
    asked = pairs.select("user_id", "job_id").distinct().join(sizes, "job_id").join(taken, ["user_id", *keys], "left").fillna(0, ["_taken"])
    draws = exploded_range(asked, F.least(F.col("size"), F.col("_taken") + 1), "draw")
    draws = draws.withColumn("place", F.pmod(seeded("user_id", "job_id", seed=seed) + F.col("draw"), F.col("size")))
    members = placed.select(*keys, "place", F.col("job_id").alias("negative_id"))
    free = draws.join(members, [*keys, "place"]).join(
        blocked.select("user_id", F.col("job_id").alias("negative_id")), ["user_id", "negative_id"], "left_anti"
    )
    first = free.groupBy("user_id", "job_id").agg(F.min_by("negative_id", "draw").alias("negative_id"))
    return asked.select("user_id", "job_id").join(first, ["user_id", "job_id"], "left")


def mixed_negatives(
    pairs: DataFrame, uniform: DataFrame, semantic: DataFrame, structural: DataFrame, epoch: int, warmup: int, seed: int
) -> DataFrame:
    """(user_id, job_id, draw, negative_id, source): one source per draw, by a seeded roll.

    Before the warm-up ends every draw is uniform. After that a roll under 0.5 takes a semantic negative,
    one under 0.7 a structural one, the rest a uniform one; a source that has nothing falls through.
    """
    rolls = uniform.join(pairs.select("user_id", "job_id").distinct(), ["user_id", "job_id"], "left_semi").withColumn(
        "_roll", F.pmod(seeded("user_id", "job_id", "draw", seed=seed + epoch), F.lit(1_000_000)) / 1_000_000.0
    )
    semantic = written(semantic.select("user_id", "job_id", "rank"), "semantic")  # a search that is read twice
    sizes = semantic.groupBy("user_id").agg(F.max("rank").alias("_n"))
    picked = rolls.join(sizes, "user_id", "left").withColumn(
        "_rank", F.pmod(seeded("user_id", "job_id", "draw", seed=seed - 1), F.col("_n")) + 1
    )
    by_rank = semantic.select("user_id", F.col("rank").cast("long").alias("_rank"), F.col("job_id").alias("_semantic"))
    same_bucket = structural.select("user_id", "job_id", F.col("negative_id").alias("_structural"))
    joined = picked.join(by_rank, ["user_id", "_rank"], "left").join(same_bucket, ["user_id", "job_id"], "left")
    warm = F.lit(epoch >= warmup)
    take_semantic = warm & (F.col("_roll") < 0.5) & F.col("_semantic").isNotNull()
    take_structural = warm & ~take_semantic & (F.col("_roll") < 0.7) & F.col("_structural").isNotNull()
    return joined.select(
        "user_id",
        "job_id",
        "draw",
        F.when(take_semantic, F.col("_semantic")).when(take_structural, F.col("_structural")).otherwise(F.col("negative_id")).alias("negative_id"),
        F.when(take_semantic, "semantic").when(take_structural, "structural").otherwise("uniform").alias("source"),
    )
