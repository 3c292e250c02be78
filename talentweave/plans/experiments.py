"""Model choice by name, and the comparison of several models on one split."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import pair_features_v2
from ..operators.dense import dense_rankings, unit_vectors
from ..operators.evaluation import KS, evaluate_v2, seed_summary
from ..operators.graph import message_graph
from ..operators.interactions import positives
from ..operators.lexical import bm25_rankings_v2, tfidf_encode
from ..operators.negatives import uniform_negatives
from ..operators.pairhead import numbered_vectors, score_interactions, train_interaction_head, vector_cells
from ..operators.pairs import attach_profiles
from ..operators.pathmodel import PathModel, Shape, pair_blocks, path_tables, score_paths, train_path_model
from ..operators.propagation import propagate
from ..operators.relations import learned_relational_encode
from ..operators.rerank import (
    als_factors, attach_vectors, concat_views, labelled_pairs, pair_levels, recall_and_rerank, scaled_dot,
    score_pairs, split_nodes, tagged_nodes, train_pair_model,
)
from ..operators.scoring import TOPN, popularity_rankings, rule_rankings
from ..session import cut_lineage

FEATURES = ["coverage", "missing", "city", "degree", "experience", "type", "paths"]


@dataclass(frozen=True)
class Bundle:
    """The tables every model reads: profiles, catalogue and split interactions."""

    users: DataFrame
    jobs: DataFrame
    interactions: DataFrame
    vectors: Mapping[str, DataFrame] = field(default_factory=dict)

    def pairs(self, *splits: str) -> DataFrame:
        return positives(self.interactions, *splits)

    def test_users(self) -> DataFrame:
        return self.pairs("test").select("user_id").distinct()

    def queries(self) -> DataFrame:
        return self.users.join(self.test_users(), "user_id", "left_semi")

    def hidden(self) -> DataFrame:
        """What a test ranking must not show: train and validation positives."""
        return self.pairs("train", "valid")

    def with_ids(self, side: str) -> str:
        return (self.users if side == "user" else self.jobs).schema[f"{side}_id"].dataType.simpleString()


def rank_popularity(b: Bundle, topn: int = TOPN, **_) -> DataFrame:
    return popularity_rankings(b.test_users(), b.jobs, b.pairs("train"), b.hidden(), topn)


def rank_rule(b: Bundle, topn: int = TOPN, weights: dict[str, float] | None = None, **_) -> DataFrame:
    return rule_rankings(b.queries(), b.jobs, b.hidden(), topn, weights)


def rank_bm25(b: Bundle, topn: int = TOPN, **_) -> DataFrame:
    return bm25_rankings_v2(b.queries(), b.jobs, topn, b.hidden())


def _text_vectors(b: Bundle) -> tuple[DataFrame, DataFrame]:
    """Supplied user and job vectors, or the built-in encoder over both texts together."""
    if "user" in b.vectors:
        return b.vectors["user"], b.vectors["job"]
    both = b.users.select(F.concat(F.lit("c:"), "user_id").alias("node"), "text").unionByName(
        b.jobs.select(F.concat(F.lit("j:"), "job_id").alias("node"), "text")
    )
    encoded = cut_lineage(tfidf_encode(both, "node", "text").withColumnRenamed("id", "node"))
    return split_nodes(encoded, b.with_ids("user"), b.with_ids("job"))


def rank_dense(b: Bundle, topn: int = TOPN, **_) -> DataFrame:
    users, jobs = _text_vectors(b)
    asked = users.join(b.test_users().withColumnRenamed("user_id", "id"), "id", "left_semi")
    return dense_rankings(unit_vectors(asked, "id", "vector"), unit_vectors(jobs, "id", "vector"), topn, b.hidden())


def smoothed_factors(b: Bundle, dim: int = 32, layers: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Collaborative factors of the train pairs, smoothed over the train graph; a zero vector where there are none."""
    train = b.pairs("train")
    users, jobs = als_factors(pair_levels(train, b.interactions), rank=dim, seed=seed)
    nothing = F.array_repeat(F.lit(0.0), dim)

    def whole(side: DataFrame, factors: DataFrame, key: str) -> DataFrame:
        return side.select(F.col(key).alias("id")).join(factors, "id", "left").withColumn("vector", F.coalesce("vector", nothing))

    nodes = tagged_nodes(whole(b.users, users, "user_id"), whole(b.jobs, jobs, "job_id"))
    smooth = cut_lineage(propagate(nodes, train, layers, dim))
    return split_nodes(smooth, b.with_ids("user"), b.with_ids("job"))


def rank_graph(b: Bundle, topn: int = TOPN, dim: int = 32, layers: int = 2, seed: int = 42, **_) -> DataFrame:
    """Dot product of smoothed collaborative factors."""
    users, jobs = smoothed_factors(b, dim, layers, seed)
    asked = users.join(b.test_users().withColumnRenamed("user_id", "id"), "id", "left_semi")
    return dense_rankings(asked, jobs, topn, b.hidden())


def rank_two_stage(
    b: Bundle, topn: int = TOPN, dim: int = 32, layers: int = 2, seed: int = 42, recall_k: int = 500, per_pair: int = 4,
    pair_interaction: bool = False, exclude_valid: bool = True, **_,
) -> DataFrame:
    """Recall by smoothed factors, then a logistic head over pair features.

    ``pair_interaction`` swaps the rule features for [u, j, |u - j|, u * j] of text and graph views with
    their residual dot. ``exclude_valid`` must be off when validation users themselves are ranked.
    """
    train = b.pairs("train")
    users, jobs = smoothed_factors(b, dim, layers, seed)
    if pair_interaction:
        text_users, text_jobs = _text_vectors(b)
        users, jobs = numbered_vectors(concat_views(text_users, users)), numbered_vectors(concat_views(text_jobs, jobs))
    known = b.pairs("train", "valid", "test")
    labelled = labelled_pairs(train, uniform_negatives(train, b.jobs, known, per_pair, seed))
    score = _interaction_scorer(labelled, users, jobs) if pair_interaction else _feature_scorer(b, labelled, users, jobs, dim)

    asked = users.join(b.test_users().withColumnRenamed("user_id", "id"), "id", "left_semi")
    hidden = b.pairs("train", "valid") if exclude_valid else train
    return recall_and_rerank(asked.select("id", "vector"), jobs.select("id", "vector"), hidden, score, topn, recall_k)


def _interaction_scorer(labelled: DataFrame, users: DataFrame, jobs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Scores of pairs by the head over interaction vectors, learnt from labelled pairs."""
    head = train_interaction_head(vector_cells(labelled, users, jobs))
    return lambda pairs: score_interactions(head, vector_cells(pairs, users, jobs))


def _feature_scorer(b: Bundle, labelled: DataFrame, users: DataFrame, jobs: DataFrame, dim: int) -> Callable[[DataFrame], DataFrame]:
    """Scores of pairs by the head over rule features and the scaled dot product, learnt from labelled pairs."""

    def features(pairs: DataFrame) -> DataFrame:
        joined = attach_profiles(attach_vectors(pairs, users, jobs), b.users, b.jobs)
        named = [c.alias(n) for c, n in zip(pair_features_v2(), FEATURES, strict=True)]
        keep = ["label"] if "label" in pairs.columns else []
        return joined.select("user_id", "job_id", *keep, *named, scaled_dot(dim).alias("dot"))

    model = train_pair_model(features(labelled), [*FEATURES, "dot"])
    return lambda pairs: score_pairs(model, features(pairs))


@dataclass
class TrainedPaths:
    """Encoded (id, vector) of all users and jobs, the model, and the inputs of any pairs of them."""

    users: DataFrame
    jobs: DataFrame
    model: PathModel
    inputs: Callable[[DataFrame], DataFrame]


def train_paths(
    b: Bundle, dim: int = 64, layers: int = 1, per_pair: int = 4, steps: int = 15, decay: float = 1e-3, seed: int = 42
) -> TrainedPaths:
    """Relation layers with learned matrices over the train graph, then path attention and the pair head on top.

    ``vectors`` of the bundle name the user, job and skill vectors of ``dim`` numbers; a user or job without one starts from
    zeros. The layers read train pairs only.
    """
    if not {"user", "job", "skill"} <= set(b.vectors):
        raise ValueError("path attention needs user, job and skill vectors")
    tagged = {"user": ("c:", b.users, "user_id"), "job": ("j:", b.jobs, "job_id")}
    nodes = b.vectors["skill"].select(F.concat(F.lit("s:"), "skill").alias("node"), "vector")
    for side, (tag, rows, key) in tagged.items():
        own = rows.select(F.col(key).alias("id")).join(b.vectors[side], "id", "left")
        vector = F.coalesce(F.transform("vector", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dim))
        nodes = nodes.unionByName(own.select(F.concat(F.lit(tag), "id").alias("node"), vector.alias("vector")))
    graph = message_graph(b.users, b.jobs, b.interactions)
    ends = [F.concat(F.substring("relation", place, 1), F.lit(":"), F.col(name)).alias(name) for place, name in ((1, "src"), (2, "dst"))]
    encoded = learned_relational_encode(nodes, graph.select("relation", *ends), dim, layers).nodes
    users, jobs = split_nodes(encoded, b.with_ids("user"), b.with_ids("job"))
    skills = encoded.where(F.col("node").startswith("s:")).select(F.expr("substring(node, 3)").alias("skill"), "vector")
    train = b.pairs("train")
    tables = path_tables(b.users, b.jobs, users, jobs, skills, dim)

    def inputs(pairs: DataFrame) -> DataFrame:
        return pair_blocks(pairs, tables, pair_features_v2())

    negatives = uniform_negatives(train, b.jobs, b.pairs("train", "valid", "test"), per_pair, seed)
    model = train_path_model(inputs(labelled_pairs(train, negatives)), Shape(dim, len(FEATURES)), steps, decay, seed)
    return TrainedPaths(users, jobs, model, inputs)


def rank_paths(b: Bundle, topn: int = TOPN, recall_k: int = 500, exclude_valid: bool = True, **options) -> DataFrame:
    """Whole catalogue by dot product of the encoded vectors, its head by path attention and the pair head."""
    trained = train_paths(b, **options)
    asked = trained.users.join(b.test_users().withColumnRenamed("user_id", "id"), "id", "left_semi")
    hidden = b.pairs("train", "valid") if exclude_valid else b.pairs("train")

    def score(pairs: DataFrame) -> DataFrame:
        return score_paths(trained.model, trained.inputs(pairs)).select("user_id", "job_id", "score")

    return recall_and_rerank(asked, trained.jobs, hidden, score, topn, recall_k)


MODELS: dict[str, Callable[..., DataFrame]] = {
    "popularity": rank_popularity,
    "rule": rank_rule,
    "bm25": rank_bm25,
    "dense": rank_dense,
    "graph": rank_graph,
    "two_stage": rank_two_stage,
    "paths": rank_paths,
}


def run_model(name: str, bundle: Bundle, **config) -> DataFrame:
    """Ranking of the test users by a named model."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name}")
    return MODELS[name](bundle, **config)


def compare_models(bundle: Bundle, specs: Sequence[str | Mapping], ks: Sequence[int] = KS) -> DataFrame:
    """One row per model: mean metrics over its seeds, with deviations where there are several."""
    relevant = bundle.pairs("test")
    rows = None
    for spec in specs:
        spec = {"name": spec} if isinstance(spec, str) else dict(spec)
        config = dict(spec.get("config", {}))
        for seed in config.pop("seeds", [config.pop("seed", 42)]):
            rankings = run_model(spec["name"], bundle, seed=seed, **config)
            report = evaluate_v2(rankings, relevant, ks).withColumn("model", F.lit(spec.get("label", spec["name"]))).withColumn("seed", F.lit(seed))
            rows = report if rows is None else rows.unionByName(report)
    return seed_summary(rows)
