"""Queries over behaviour, profiles and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import features as fx
from ..operators import dense, evaluation, factors, interactions, negatives, neighbours, ordering, pairs, propagation, relations, rerank, scoring
from ..operators.dense import dense_rankings, unit_vectors
from ..operators.graph import with_reverse
from ..plans import experiments, recommend
from ..session import cut_lineage
from ..sources import raw, sinks

DIM = 64


def _r(name: str, alias: str | None = None):
    return F.round(F.col(f"`{name}`"), 6).alias(alias or name)


def _ranked(df: DataFrame) -> DataFrame:
    # scores are kept to nine digits; a half in the seventh is rounded as the SQL does, on the scaled number
    score = F.round(F.col("score") * 1e6) / 1e6
    return df.select("user_id", "job_id", score.alias("score"), F.col("rank").cast("int").alias("rank"))


def _report(df: DataFrame) -> DataFrame:
    return df.select(*[_r(c, c.replace("@", "_at_")) for c in df.columns])


# Behaviour ------------------------------------------------------------------------------------


def behaviour_levels(spark: SparkSession, d: str) -> DataFrame:
    return b.levels(spark, d)


def leave_last_out(spark, d):
    return b.interactions(spark, d)


def leave_last_out_v1(spark, d):
    return b.interactions(spark, d, min_level=1)


def time_split(spark, d):
    return interactions.time_split(b.table(spark, d, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "split")


def split_overlap(spark, d):
    return interactions.split_overlap(cut_lineage(b.interactions(spark, d)))


def positive_sets(spark, d):
    return interactions.positive_sets(b.interactions(spark, d))


def seen_pairs(spark, d):
    return interactions.seen_pairs(cut_lineage(b.interactions(spark, d)))


def dataset_stats(spark, d):
    stats = interactions.dataset_stats(b.users(spark, d), b.jobs(spark, d), cut_lineage(b.interactions(spark, d, 1)))
    return stats.select("item", F.col("value").cast("double").alias("value"))


def pair_levels(spark, d):
    split = cut_lineage(b.interactions(spark, d))
    return rerank.pair_levels(interactions.positives(split, "train"), split)


def catalogue(spark, d):
    return b.jobs(spark, d).select("job_id", "title", "city", "job_type", "min_degree_rank", "min_years", F.array_join("skills", "|").alias("skills"))


def profiles(spark, d):
    return b.users(spark, d).select("user_id", "live_city", F.array_join("desired_types", "|").alias("types"), "degree_rank", "years", F.array_join("skills", "|").alias("skills"))


def users_in_actions(spark, d):
    first = raw.users_in_actions(b.raw_users(spark, d), b.levels(spark, d).select(F.col("user_id").cast("string").alias("user_id")))
    return first.select("user_id", "live_city_id", "row_index")


def jobs_for_actions(spark, d):
    demanded = b.levels(spark, d).select(F.col("job_id").cast("string").alias("job_id"))
    return raw.jobs_for_actions(b.raw_jobs(spark, d), demanded).select("jd_no", "jd_title", "row_index")


def last_action_per_pair(spark, d):
    rows = b.levels(spark, d)
    return ordering.first_occurrence(rows, ["user_id", "job_id"], "row_index", last=True)


def systematic_sample(spark, d):
    valid = interactions.positives(b.interactions(spark, d), "valid").select("user_id").distinct()
    return ordering.systematic_sample(valid, "user_id", 50)


def dense_user_index(spark, d):
    return ordering.dense_index(b.levels(spark, d).select("user_id"), "user_id", "position")


# Rankings -------------------------------------------------------------------------------------


def popularity_counts(spark, d):
    bundle = b.bundle(spark, d)
    return scoring.popularity_counts(bundle.jobs, bundle.pairs("train"))


def popularity_ranking(spark, d):
    return _ranked(experiments.rank_popularity(b.bundle(spark, d)))


def rule_ranking(spark, d):
    return _ranked(experiments.rank_rule(b.bundle(spark, d)))


def rule_ranking_top_10(spark, d):
    """The same cut to ten places, for which long lists need not be read."""
    bundle = b.bundle(spark, d)
    return _ranked(scoring.rule_rankings(bundle.queries(), bundle.jobs, bundle.hidden(), 10))


def rule_ranking_weighted(spark, d):
    return _ranked(experiments.rank_rule(b.bundle(spark, d), weights={"city": 2.0, "years": 0.0}))


def rule_ranking_v1(spark, d):
    split = cut_lineage(b.interactions(spark, d, 1))
    test_users = interactions.positives(split, "test", min_level=1).select("user_id").distinct()
    asked = b.users(spark, d).join(test_users, "user_id", "left_semi")
    hidden = interactions.positives(split, "train", min_level=1)
    return _ranked(scoring.rule_rankings_v1(asked, b.jobs_with_stated_degree(spark, d), hidden))


def popularity_report(spark, d):
    bundle = b.bundle(spark, d)
    return _report(evaluation.evaluate_v2(experiments.rank_popularity(bundle), bundle.pairs("test")))


def rule_report(spark, d):
    bundle = b.bundle(spark, d)
    return _report(evaluation.evaluate_v2(experiments.rank_rule(bundle), bundle.pairs("test")))


def rule_report_v1(spark, d):
    split = cut_lineage(b.interactions(spark, d, 1))
    relevant = interactions.positives(split, "test", min_level=1)
    asked = b.users(spark, d).join(relevant.select("user_id").distinct(), "user_id", "left_semi")
    hidden = interactions.positives(split, "train", min_level=1)
    ranked = scoring.rule_rankings_v1(asked, b.jobs_with_stated_degree(spark, d), hidden)
    return _report(evaluation.evaluate_v1(ranked, relevant, 10))


def user_ndcg(spark, d):
    bundle = b.bundle(spark, d)
    rows = evaluation.user_ndcg(experiments.rank_popularity(bundle), bundle.pairs("test"), "popularity", 42)
    return rows.select("model", "seed", "user_id", _r("ndcg"))


def _two_models_ndcg(bundle) -> DataFrame:
    relevant = bundle.pairs("test")
    return evaluation.user_ndcg(experiments.rank_popularity(bundle), relevant, "popularity", 42, 50).unionByName(
        evaluation.user_ndcg(experiments.rank_rule(bundle), relevant, "rule", 42, 50)
    )


def paired_t_test(spark, d):
    test = evaluation.paired_t_test(_two_models_ndcg(b.bundle(spark, d)), "rule", "popularity", 42)
    return test.select("users", _r("mean_diff"), _r("t"))


def model_comparison(spark, d):
    rows = experiments.compare_models(b.bundle(spark, d), ["popularity", "rule"], ks=(10,))
    names = ["mrr", "recall@10", "precision@10", "ndcg@10", "hitrate@10", "eval_users"]
    return rows.select("model", "n_seeds", *[_r(c, c.replace("@", "_at_")) for c in names])


def seed_deviation(spark, d):
    """Per-user NDCG rows stand in for seeds: mean and population deviation per model."""
    rows = _two_models_ndcg(b.bundle(spark, d)).select("model", F.col("user_id").alias("seed"), "ndcg")
    return evaluation.seed_summary(rows).select("model", "n_seeds", _r("ndcg"), _r("ndcg_std"))


def prediction_sample(spark, d):
    sample = sinks.prediction_sample(experiments.rank_popularity(b.bundle(spark, d)))
    return sample.select("user_id", F.array_join(F.col("job_ids").cast("array<string>"), ",").alias("job_ids"))


def two_stage_rule(spark, d):
    """Popularity recalls, the rule score re-orders the first 20 places."""
    bundle = b.bundle(spark, d)
    first = cut_lineage(experiments.rank_popularity(bundle))
    head = first.where(F.col("rank") <= 20).select("user_id", "job_id")
    joined = pairs.attach_profiles(head, bundle.users, bundle.jobs).withColumns(
        dict(zip(experiments.FEATURES, fx.pair_features_v2(), strict=True))
    )
    w = fx.RULE_V2_WEIGHTS
    value = (
        w["coverage"] * F.col("coverage") + w["city"] * F.col("city") + w["type"] * F.col("type")
        + w["degree"] * F.col("degree") + w["years"] * F.col("experience")
    )
    return _ranked(scoring.two_stage(first, joined.select("user_id", "job_id", F.round(value, 9).alias("score")), 20))


def full_ranking(spark, d):
    """Every behaviour pair of a user ranked by its number of rows."""
    scored = b.levels(spark, d).groupBy("user_id", "job_id").agg(F.sum("level").cast("double").alias("score"))
    return _ranked(scoring.full_ranking(scored))


def masked_pairs(spark, d):
    split = cut_lineage(b.interactions(spark, d))
    scored = split.groupBy("user_id", "job_id").agg(F.sum("level").cast("double").alias("score"))
    return scoring.mask_pairs(scored, interactions.positives(split, "train"))


# Pair features --------------------------------------------------------------------------------


def _profile_pairs(spark, d) -> DataFrame:
    known = b.levels(spark, d).select("user_id", "job_id").distinct()
    return pairs.attach_profiles(known, b.users(spark, d), b.jobs_with_stated_degree(spark, d))


def pair_features_v1(spark, d):
    rows = _profile_pairs(spark, d).select("user_id", "job_id", *fx.pair_features_v1())
    rows = rows.withColumn("score", fx.rule_score_v1())
    return rows.select("user_id", "job_id", *[_r(c) for c in [*fx.FEATURE_NAMES, "score"]])


def pair_features_v2(spark, d):
    rows = _profile_pairs(spark, d).select("user_id", "job_id", *fx.pair_features_v2(), *fx.path_and_gap())
    return rows.select(
        "user_id", "job_id", *[_r(c) for c in experiments.FEATURES],
        F.array_join("path_skills", "|").alias("path_skills"), F.array_join("gap_skills", "|").alias("gap_skills"),
    )


def shared_skill_counts(spark, d):
    known = b.levels(spark, d).select("user_id", "job_id").distinct()
    return pairs.shared_skill_counts(known, b.users(spark, d), b.jobs(spark, d))


def skill_frequency(spark, d):
    both = pairs.skill_frequency(b.users(spark, d)).withColumn("side", F.lit("user")).unionByName(
        pairs.skill_frequency(b.all_jobs(spark, d)).withColumn("side", F.lit("job"))
    )
    return both.select("side", "skill", "frequency")


def skill_entries(spark, d):
    return pairs.skill_entries(b.all_jobs(spark, d), "job_id")


def _requirement_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    people = b.users(spark, d).select(
        "user_id", "skills", F.col("live_city").alias("expected_city"), F.col("degree_rank").cast("string").alias("education"),
        F.col("years").alias("experience_years"),
    )
    posts = b.jobs(spark, d).select(
        "job_id", F.slice("skills", 1, 2).alias("required_skills"), F.array("brand", "job_type").alias("preferred_skills"), "city",
        F.col("min_degree_rank").cast("string").alias("education_requirement"), F.col("min_years").alias("experience_requirement"),
    )
    return people, posts


def requirement_scores(spark, d):
    people, posts = _requirement_sides(spark, d)
    known = b.levels(spark, d).select("user_id", "job_id").distinct()
    rows = recommend.requirement_scores(known, people, posts)
    return rows.select("user_id", "job_id", *[_r(c) for c in rows.columns[2:]])


def requirement_paths(spark, d):
    people, posts = _requirement_sides(spark, d)
    known = b.levels(spark, d).select("user_id", "job_id").distinct()
    return pairs.attach_profiles(known, people, posts).select("user_id", "job_id", *fx.requirement_path_counts())


def skill_aliases(spark, d):
    """Part types are aliases of a canonical name; the other skills pass through."""
    posts = b.all_jobs(spark, d).select("job_id", "skills")
    names = b.table(spark, d, "part").select(F.lower("p_type").alias("alias"), F.concat(F.lit("kind-"), F.lower("p_type")).alias("canonical")).distinct()
    return pairs.normalize_skill_list(posts, "job_id", "skills", names).select("job_id", F.array_join("skills", "|").alias("skills"))


# Negatives ------------------------------------------------------------------------------------


def uniform_negatives(spark, d):
    bundle = b.bundle(spark, d)
    return negatives.uniform_negatives(bundle.pairs("train"), bundle.jobs, bundle.pairs(), 2, 7)


def sampled_pool(spark, d):
    bundle = b.bundle(spark, d)
    return negatives.sampled_pool(bundle.users, bundle.jobs, bundle.pairs(), 10, 7)


def structural_negatives(spark, d):
    bundle = b.bundle(spark, d)
    return negatives.structural_negatives(bundle.pairs("train"), bundle.jobs, bundle.pairs(), 7, bucket=("job_type",))


def structural_negatives_by_city(spark, d):
    bundle = b.bundle(spark, d)
    found = negatives.structural_negatives(bundle.pairs("train"), bundle.jobs, bundle.pairs(), 7)
    return found.select("user_id", "job_id", F.coalesce("negative_id", F.lit(-1)).alias("negative_id"))


def semantic_negatives(spark, d):
    users, jobs = b.node_vectors(spark, d)
    split = cut_lineage(b.interactions(spark, d))
    asked = users.join(interactions.positives(split, "train").select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    found = negatives.semantic_negatives(unit_vectors(asked, "id", "vector"), unit_vectors(jobs, "id", "vector"), interactions.seen_pairs(split))
    return _ranked(found)


def approximate_negatives(spark, d):
    """Hard negatives of all train users, found through inverted lists."""
    users, jobs = b.node_vectors(spark, d)
    split = cut_lineage(b.interactions(spark, d))
    asked = users.join(interactions.positives(split, "train").select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    seen = interactions.seen_pairs(split)
    return _ranked(negatives.semantic_negatives(unit_vectors(asked, "id", "vector"), unit_vectors(jobs, "id", "vector"), seen, 10, approximate=True))


def neighbour_recall(spark, d):
    """Stored vectors whose id is divisible by 100 against all others: is the approximate search good enough?"""
    vectors = cut_lineage(_unit_embeddings(spark, d))
    asked = vectors.where(F.col("id") % 100 == 0)
    own = _self_pairs(asked)
    found = neighbours.recall(neighbours.approximate_rankings(asked, vectors, 10, own), dense_rankings(asked, vectors, 10, own))
    return found.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


def mixed_negatives(spark, d):
    bundle = b.bundle(spark, d)
    users, jobs = b.node_vectors(spark, d, bundle)
    train, known = cut_lineage(bundle.pairs("train")), cut_lineage(bundle.pairs())
    uniform = negatives.uniform_negatives(train, bundle.jobs, known, 2, 7)
    semantic = negatives.semantic_negatives(unit_vectors(users, "id", "vector"), unit_vectors(jobs, "id", "vector"), interactions.seen_pairs(bundle.interactions))
    structural = negatives.structural_negatives(train, bundle.jobs, known, 7, bucket=("job_type",))
    return negatives.mixed_negatives(train, uniform, semantic, structural, 5, 3, 7)


# Vectors and propagation ----------------------------------------------------------------------


def _unit_embeddings(spark, d) -> DataFrame:
    return unit_vectors(b.table(spark, d, "embeddings"), "vec_id", "embedding")


def _self_pairs(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").alias("user_id"), F.col("id").alias("job_id"))


def dense_ranking(spark, d):
    """Every stored vector against all the others."""
    vectors = _unit_embeddings(spark, d)
    return _ranked(dense_rankings(vectors, vectors, 50, _self_pairs(vectors)))


def dense_ranking_by_groups(spark, d):
    """Ten nearest of every vector over many groups, most of which the bounds may skip."""
    vectors = cut_lineage(_unit_embeddings(spark, d))
    return _ranked(dense_rankings(vectors, vectors, 10, _self_pairs(vectors), item_block_rows=64))


def dense_groups_visited(spark, d):
    """Groups visited by each vector's search for its ten nearest."""
    vectors = cut_lineage(_unit_embeddings(spark, d))
    return dense.dense_groups_visited(vectors, vectors, 10, _self_pairs(vectors), item_block_rows=64)


def dense_label_report(spark, d):
    """Macro metrics of the dense ranking where a hit is a vector of the same label."""
    vectors = _unit_embeddings(spark, d)
    labels = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    ranked = dense_rankings(vectors, vectors, 50, _self_pairs(vectors))
    judged = ranked.join(labels.select(F.col("id").alias("user_id"), F.col("label").alias("_u")), "user_id").join(
        labels.select(F.col("id").alias("job_id"), F.col("label").alias("_j")), "job_id"
    )
    hits = judged.where(F.col("_u") == F.col("_j")).select("user_id", "rank")
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))
    wanted = labels.join(sizes, "label").select(F.col("id").alias("user_id"), "relevant").where(F.col("relevant") > 0)
    return _report(evaluation.macro_report(evaluation.metrics_of_hits(hits, wanted, (10, 50))))


def node_degree(spark, d):
    train = interactions.positives(b.interactions(spark, d), "train")
    return propagation.node_degree(propagation.bipartite_edges(train))


def _train_nodes(spark, d):
    users, jobs = b.node_vectors(spark, d)
    train = cut_lineage(interactions.positives(b.interactions(spark, d), "train"))
    return cut_lineage(rerank.tagged_nodes(users, jobs)), train


def _train_edges(train: DataFrame) -> DataFrame:
    """Candidate-job edges of the train pairs and their reverses, with tagged node names."""
    rows = train.select(
        F.lit("cj").alias("relation"), F.concat(F.lit("c:"), "user_id").alias("src"), F.concat(F.lit("j:"), "job_id").alias("dst")
    )
    return with_reverse(rows)


def _by_dimension(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("vector").alias("dim", "_v")).select(*keys, "dim", F.round("_v", 6).alias("value"))


def propagated_vectors(spark, d):
    nodes, train = _train_nodes(spark, d)
    return _by_dimension(propagation.propagate(nodes, train, 3, DIM), "node")


def relation_means(spark, d):
    nodes, train = _train_nodes(spark, d)
    return _by_dimension(propagation.relation_means(nodes, _train_edges(train)), "relation", "dst")


def relational_encoding(spark, d):
    nodes, train = _train_nodes(spark, d)
    return _by_dimension(propagation.relational_encode(nodes, _train_edges(train), DIM, 2), "node")


def relation_gram_sums(spark, d):
    """Gram sums that the relation matrices of the first layer are solved from, one row per entry."""
    nodes, train = _train_nodes(spark, d)
    means = propagation.relation_means(nodes, _train_edges(train))
    entries = relations.gram_sums(means, nodes, DIM).select("relation", "place", F.posexplode("vector").alias("entry", "_v"))
    return entries.select("relation", "place", "entry", F.round("_v", 6).alias("value"))


def learned_encoding(spark, d):
    """Train graph passed through two relation layers with learned matrices."""
    nodes, train = _train_nodes(spark, d)
    return _by_dimension(relations.learned_relational_encode(nodes, _train_edges(train), DIM, 2).nodes, "node")


def graph_dot_ranking(spark, d):
    """Dot product of propagated vectors."""
    nodes, train = _train_nodes(spark, d)
    users, jobs = rerank.split_nodes(cut_lineage(propagation.propagate(nodes, train, 2, DIM)), "long", "long")
    split = b.interactions(spark, d)
    test = interactions.positives(split, "test").select(F.col("user_id").alias("id")).distinct()
    return _ranked(dense_rankings(users.join(test, "id", "left_semi"), jobs, 100, interactions.positives(split, "train", "valid")))


def als_ranking(spark, d):
    return _ranked(experiments.rank_graph(b.bundle(spark, d)))


def two_stage_ranking(spark, d):
    return _ranked(experiments.rank_two_stage(b.bundle(spark, d)))


def pair_interaction_ranking(spark, d):
    return _ranked(experiments.rank_two_stage(b.bundle(spark, d), pair_interaction=True))


def pairwise_ranking(spark, d):
    """Ranking by factors learnt from pairwise preferences of the train pairs."""
    bundle = b.bundle(spark, d)
    return _ranked(_pairwise(bundle))


def _pairwise(bundle) -> DataFrame:
    learned = factors.pairwise_factors(bundle.pairs("train"), bundle.users, bundle.jobs, dim=16, epochs=3, blocks=2)
    asked = learned.users.join(bundle.queries().select(F.col("user_id").alias("id")), "id", "left_semi")
    return dense_rankings(asked, learned.jobs, scoring.TOPN, bundle.hidden())


def pairwise_ranking_facts(spark, d):
    bundle = b.bundle(spark, d)
    return _ranking_facts(_pairwise(bundle), bundle.hidden())


def _ranking_facts(ranked: DataFrame, hidden: DataFrame) -> DataFrame:
    """What every trained ranking must satisfy: places without gaps, each job once, no hidden pair."""
    shown = ranked.join(hidden.withColumn("_h", F.lit(1)), ["user_id", "job_id"], "left")
    return shown.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("places"), F.countDistinct("job_id").alias("jobs"), F.min("rank").cast("int").alias("first"),
        F.max("rank").cast("int").alias("last"), F.count("_h").alias("hidden"),
    )


def als_ranking_facts(spark, d):
    bundle = b.bundle(spark, d)
    return _ranking_facts(experiments.rank_graph(bundle), bundle.hidden())


def two_stage_ranking_facts(spark, d):
    bundle = b.bundle(spark, d)
    return _ranking_facts(experiments.rank_two_stage(bundle), bundle.hidden())


def pair_interaction_ranking_facts(spark, d):
    bundle = b.bundle(spark, d)
    return _ranking_facts(experiments.rank_two_stage(bundle, pair_interaction=True), bundle.hidden())


def _with_vectors(spark, d) -> experiments.Bundle:
    """The bundle with stored vectors for users, jobs and skills; a skill's vector is the stored one at its rank."""
    bundle = b.bundle(spark, d)
    users, jobs = b.node_vectors(spark, d)
    numbered = ordering.dense_index(b.all_jobs(spark, d).select(F.explode("skills").alias("skill")).distinct(), "skill", "vec_id")
    stored = b.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    skills = numbered.join(stored, "vec_id").select("skill", "vector")
    return experiments.Bundle(bundle.users, bundle.jobs, bundle.interactions, {"user": users, "job": jobs, "skill": skills})


def path_model_ranking(spark, d):
    """Catalogue ranked by encoded vectors, its head by learned path attention and the pair head."""
    return _ranked(experiments.rank_paths(_with_vectors(spark, d)))


def path_model_ranking_facts(spark, d):
    bundle = _with_vectors(spark, d)
    return _ranking_facts(experiments.rank_paths(bundle), bundle.hidden())


def learned_path_attention(spark, d):
    """Learned weights of the shared skills of every test pair: how many, and whether they add up to one."""
    bundle = _with_vectors(spark, d)
    trained = experiments.train_paths(bundle)
    found = experiments.score_paths(trained.model, trained.inputs(bundle.pairs("test").distinct()))
    total = F.aggregate("attention", F.lit(0.0), lambda acc, x: acc + x)
    return found.select("user_id", "job_id", F.size("attention").alias("skills"), F.round(total, 6).alias("total"))


def interaction_vectors(spark, d):
    """Pair-interaction vectors of every train pair, one row per dimension."""
    users, jobs = b.node_vectors(spark, d)
    train = interactions.positives(b.interactions(spark, d), "train")
    joined = rerank.attach_vectors(train, users, jobs)
    return _by_dimension(joined.select("user_id", "job_id", rerank.interaction_vector(F.col("user_vector"), F.col("job_vector")).alias("vector")), "user_id", "job_id")


def node_inputs(spark, d):
    bundle = b.bundle(spark, d)
    users, jobs = b.node_vectors(spark, d)
    u, j = rerank.node_inputs(bundle.users, bundle.jobs, users, jobs)

    def flat(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            F.lit(side).alias("side"), "id", "city_code", "type_code", F.round(F.get("structured", F.lit(0)), 6).alias("degree"),
            F.round(F.get("structured", F.lit(1)), 6).alias("years"), F.round(F.get("vector", F.lit(0)), 6).alias("first"),
        )

    return flat(u, "user").unionByName(flat(j, "job"))


def fused_encoding(spark, d):
    """Fused node inputs passed through the relation layers."""
    bundle = b.bundle(spark, d)
    users, jobs = b.node_vectors(spark, d)
    u, j = rerank.node_inputs(bundle.users, bundle.jobs, users, jobs)
    nodes = cut_lineage(rerank.tagged_nodes(rerank.fuse_vectors(u, DIM), rerank.fuse_vectors(j, DIM)))
    return _by_dimension(propagation.relational_encode(nodes, _train_edges(bundle.pairs("train")), DIM, 1), "node")


QUERIES = {
    f.__name__: f
    for f in (
        behaviour_levels, leave_last_out, leave_last_out_v1, time_split, split_overlap, positive_sets, seen_pairs, dataset_stats,
        pair_levels, catalogue, profiles, users_in_actions, jobs_for_actions, last_action_per_pair, systematic_sample,
        dense_user_index, popularity_counts, popularity_ranking, rule_ranking, rule_ranking_weighted, rule_ranking_v1,
        popularity_report, rule_report, rule_report_v1, user_ndcg, paired_t_test, model_comparison, seed_deviation,
        prediction_sample, two_stage_rule, full_ranking, masked_pairs, pair_features_v1, pair_features_v2, shared_skill_counts,
        skill_frequency, skill_entries, requirement_scores, requirement_paths, skill_aliases, uniform_negatives, sampled_pool,
        structural_negatives, structural_negatives_by_city, semantic_negatives, approximate_negatives, neighbour_recall, mixed_negatives, dense_ranking, dense_ranking_by_groups, dense_groups_visited, dense_label_report, node_degree,
        propagated_vectors, relation_means, relational_encoding, relation_gram_sums, learned_encoding, graph_dot_ranking, als_ranking, pairwise_ranking, pairwise_ranking_facts, two_stage_ranking,
        pair_interaction_ranking, als_ranking_facts, two_stage_ranking_facts, pair_interaction_ranking_facts, rule_ranking_top_10,
        path_model_ranking, path_model_ranking_facts, learned_path_attention, interaction_vectors, node_inputs, fused_encoding,
    )
}
