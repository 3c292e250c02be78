"""Graph propagation over node vectors, and skill-path attention."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import with_reverse
from .vectorsums import HUB, hub_slices, vector_sums


def node_degree(edges: DataFrame) -> DataFrame:
    """(node, degree) over directed edges (src, dst), counted at the destination, at least 1."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("degree"))


def bipartite_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of user-job pairs with tagged node names (``c:`` users, ``j:`` jobs)."""
    rows = pairs.select(
        F.lit("cj").alias("relation"), F.concat(F.lit("c:"), "user_id").alias("src"), F.concat(F.lit("j:"), "job_id").alias("dst")
    )
    return with_reverse(rows).select("src", "dst")


def propagate(
    nodes: DataFrame, pairs: DataFrame, layers: int, dim: int, keep_raw_without_edges: bool = False, hub: int = HUB
) -> DataFrame:
    """(node, vector): mean over the layers 0..K of degree-normalized neighbour sums.

    ``nodes`` holds (node, vector) with ``dim`` numbers each. A node without edges adds zeros after layer 0. Each
    layer is one join on the source node and one partially combined sum, in two levels if a node has more than
    ``hub`` edges; it is written before the next one starts, so the plan does not grow and a lost executor re-reads
    the layer.
    """
    edges = bipartite_edges(pairs.select("user_id", "job_id").distinct())
    if keep_raw_without_edges and edges.limit(1).count() == 0:
        return nodes
    degree = node_degree(edges)
    sliced, hubs = hub_slices(edges, ["dst"], "src", hub)
    weighted = cut_lineage(
        sliced.join(degree.select(F.col("node").alias("src"), F.col("degree").alias("_ds")), "src")
        .join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("_dd")), "dst")
        .select("src", "dst", "slice", (1.0 / F.sqrt(F.col("_ds") * F.col("_dd"))).alias("norm"))
    )
    layer = nodes.select("node", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    stacked = layer
    for _ in range(layers):
        messages = weighted.join(layer.withColumnRenamed("node", "src"), "src")
        layer = cut_lineage(vector_sums(messages.withColumnRenamed("dst", "node"), ["node"], "norm", hubs))
        stacked = stacked.unionByName(layer)
    total = vector_sums(stacked, ["node"])
    return total.select("node", F.transform("vector", lambda x: x / float(layers + 1)).alias("vector")).join(
        nodes.select("node"), "node", "left_semi"
    )


def relation_means(nodes: DataFrame, edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(relation, dst, vector): mean of the source vectors over each relation's edges."""
    return _means(nodes, *hub_slices(edges, ["relation", "dst"], "src", hub))


def _means(nodes: DataFrame, sliced: DataFrame, hubs: bool) -> DataFrame:
    messages = sliced.join(nodes.select(F.col("node").alias("src"), F.transform("vector", lambda x: x.cast("double")).alias("vector")), "src")
    return vector_sums(messages, ["relation", "dst"], slices=hubs, mean=True)


def _gelu(x: Column) -> Column:
    return 0.5 * x * (1.0 + F.tanh(sqrt(2.0 / pi) * (x + 0.044715 * x * x * x)))


def layer_norm(vector: Column, dim: int, epsilon: float = 1e-5) -> Column:
    mean = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x) / float(dim)
    square = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x) / float(dim)
    stats = F.array_repeat(F.struct(mean.alias("m"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)) + epsilon).alias("s")), dim)
    return F.zip_with(vector, stats, lambda x, t: (x - t["m"]) / t["s"])


def relational_encode(nodes: DataFrame, edges: DataFrame, dim: int, layers: int = 2) -> DataFrame:
    """(node, vector): per-relation means summed per node, then residual and layer norm, ``layers`` times.

    The relations carry no learned matrices; node names must be tagged by type.
    """
    state = nodes.select("node", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    sliced = hub_slices(edges, ["relation", "dst"], "src")
    for _ in range(layers):
        incoming = vector_sums(_means(state, *sliced), ["dst"])
        joined = state.join(incoming.select(F.col("dst").alias("node"), F.col("vector").alias("_m")), "node", "left")
        zero = F.array_repeat(F.lit(0.0), dim)
        mixed = F.zip_with("vector", F.coalesce("_m", zero), lambda h, m: h + _gelu(m))
        state = cut_lineage(joined.select("node", mixed.alias("_h")).select("node", layer_norm(F.col("_h"), dim).alias("vector")))
    return state


# Skill-path attention -------------------------------------------------------------------------


def softmax(logits: Column) -> Column:
    """Softmax of a short array; an empty array stays empty."""
    shifted = F.transform(
        F.arrays_zip(logits.alias("l"), F.array_repeat(F.array_max(logits), F.size(logits)).alias("m")),
        lambda e: F.exp(e["l"] - e["m"]),
    )
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(shifted, F.array_repeat(total, F.size(logits)), lambda x, t: x / t)


def path_attention(pairs: DataFrame, logit_of: DataFrame) -> DataFrame:
    """(user_id, job_id, attention): softmax weights of each pair's shared skills, in path order.

    ``pairs`` holds ``path_skills`` (a bounded list), ``logit_of`` (job_id, skill, logit). A skill
    without a logit counts as 0.
    """
    paths = pairs.select("user_id", "job_id", F.posexplode("path_skills").alias("pos", "skill"))
    scored = paths.join(logit_of, ["job_id", "skill"], "left").fillna(0.0, ["logit"])
    listed = scored.groupBy("user_id", "job_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "skill", "logit"))).alias("_p")
    )
    weights = F.zip_with("_p", softmax(F.col("_p.logit")), lambda p, w: F.struct(p["skill"].alias("skill"), w.alias("weight")))
    attended = listed.select("user_id", "job_id", weights.alias("attention"))
    empty = F.filter(F.array(F.struct(F.lit("").alias("skill"), F.lit(0.0).alias("weight"))), lambda e: F.lit(False))
    return pairs.join(attended, ["user_id", "job_id"], "left").withColumn("attention", F.coalesce("attention", empty))


def pooled_paths(pairs: DataFrame, skill_vectors: DataFrame, dim: int) -> DataFrame:
    """(user_id, job_id, path_vector, gap_vector): attention-weighted path and mean gap; zeros where there is none.

    ``pairs`` holds ``attention`` and ``gap_skills``; ``skill_vectors`` (skill, vector).
    """
    vectors = skill_vectors.select("skill", "vector")
    shared = pairs.select("user_id", "job_id", F.inline("attention")).withColumn("side", F.lit("path"))
    gaps = pairs.select(
        "user_id", "job_id", F.explode("gap_skills").alias("skill"), (1.0 / F.size("gap_skills")).alias("weight"), F.lit("gap").alias("side")
    )
    weighted = shared.unionByName(gaps).join(vectors, "skill")
    value = F.transform("vector", lambda x: x.cast("double"))
    parts = []
    for side in ("path", "gap"):
        for i in range(dim):
            cell = F.when(F.col("side") == side, F.get("_x", F.lit(i)) * F.col("weight")).otherwise(0.0)
            parts.append(F.sum(cell).alias(f"_{side}{i}"))
    sums = weighted.withColumn("_x", value).groupBy("user_id", "job_id").agg(*parts)
    pooled = sums.select(
        "user_id", "job_id", *[F.array(*[F.col(f"_{s}{i}") for i in range(dim)]).alias(f"{s}_vector") for s in ("path", "gap")]
    )
    zero = F.array_repeat(F.lit(0.0), dim)
    return pairs.select("user_id", "job_id").join(pooled, ["user_id", "job_id"], "left").select(
        "user_id", "job_id", F.coalesce("path_vector", zero).alias("path_vector"), F.coalesce("gap_vector", zero).alias("gap_vector")
    )
