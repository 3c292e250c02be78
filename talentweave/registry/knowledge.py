"""Queries over the knowledge graph, evidence, recommendation, taxonomy, raw tables and sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.features import pair_features_v1, rule_score_v1
from ..operators import evaluation, evidence, graph, interactions, pairs, propagation, reverse, scoring, taxonomy
from ..operators.ordering import dense_index, first_rows
from ..operators.topk import term_keys
from ..operators.vocabulary import SkillGate
from ..plans import experiments, recommend, records
from ..session import cut_lineage, shared_folder, written
from ..sources import bundle as readers
from ..sources import raw, sinks
from .matching import DIM, _by_dimension, _requirement_sides


WHOLE_TEXTS = {"bm25_tokens": None, "hashed_tokens": None, "document_tokens": None}


def _build(spark, d, **options) -> dict[str, DataFrame]:
    return graph.build_graph(
        b.raw_users(spark, d), b.raw_jobs(spark, d), b.raw_actions(spark, d), user_skill_limit=None, job_skill_limit=None, **options
    )


def graph_nodes(spark, d):
    return _build(spark, d, parts=("nodes",))["nodes"]


def graph_edges(spark, d):
    return _build(spark, d, parts=("edges",))["edges"]


def graph_stats(spark, d):
    return _build(spark, d, parts=("nodes", "edges", "stats"))["stats"].select("item", F.col("count").alias("n"))


def pruned_graph_edges(spark, d):
    """Edges left when rare skills lose their node and dangling edges are dropped."""
    edges = _build(spark, d, min_skill_freq=100, prune_dangling=True, parts=("edges",))["edges"]
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


def dimension_values(spark, d):
    return graph.dimension_values(graph.user_cells(b.raw_users(spark, d)), graph.job_cells(b.raw_jobs(spark, d)))


def message_graph(spark, d):
    bundle = b.bundle(spark, d)
    return graph.message_graph(bundle.users, bundle.jobs, bundle.interactions, include_browsed=True)


def graph_export(spark, d):
    """Graph written as CSV and Parquet, statistics read back from the CSV file."""
    folder = shared_folder(spark, "graph")
    sinks.write_graph(_build(spark, d), folder)
    stats = readers.read_graph_stats(spark, f"{folder}/stats_csv")
    nodes = spark.read.option("header", True).option("escape", '"').csv(f"{folder}/nodes_csv")
    per_type = nodes.groupBy(F.concat(F.lit("node_type_"), F.col("node_type")).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return stats.select("item", F.col("count").alias("n")).union(per_type)


# Records and processed tables -----------------------------------------------------------------


def candidates_v1(spark, d):
    rows = records.candidates_v1(b.raw_users(spark, d), b.AS_OF_YEAR, None)
    return rows.select(
        "user_id", "text", F.array_join("skills", "|").alias("skills"), F.array_join("city_ids", "|").alias("city_ids"),
        F.array_join("desired_city_ids", "|").alias("desired_city_ids"), F.array_join("industries", "|").alias("industries"),
        F.array_join("desired_types", "|").alias("desired_types"), "degree", "degree_rank", "years",
    )


def jobs_v1(spark, d):
    rows = records.jobs_v1(b.raw_jobs(spark, d), b.AS_OF_YEAR, None)
    return rows.select("job_id", "title", "text", F.array_join(F.array_sort("skills"), "|").alias("skills"), "city", "job_type", "min_degree", "min_degree_rank", "min_years")


def _processed(spark, d) -> dict[str, DataFrame]:
    return records.preprocess(
        b.raw_users(spark, d), b.raw_jobs(spark, d), b.raw_actions(spark, d), b.AS_OF_YEAR, SkillGate(), max_user_skills=None,
        max_desc_chars=None, max_text_chars=None, max_text_tags=None,
    )


def processed_users(spark, d):
    rows = _processed(spark, d)["users"]
    return rows.select(
        "user_id", F.array_join(F.col("skill_ids").cast("array<string>"), "|").alias("skill_ids"), "live_city",
        F.array_join("desired_types", "|").alias("desired_types"), F.array_join("industries", "|").alias("industries"), "degree_rank", "years", "text",
    )


def processed_jobs(spark, d):
    rows = _processed(spark, d)["jobs"]
    return rows.select("job_id", "title", "city", "job_type", "min_degree_rank", "min_years", F.size("skill_ids").alias("n_skills"), "text")


def processed_run(spark, d):
    """A whole run written as Parquet, read back, and counted."""
    folder = shared_folder(spark, "processed")
    sinks.write_processed(_processed(spark, d), folder)
    tables = readers.read_processed(spark, folder)
    return interactions.run_metadata(tables["users"], tables["jobs"], tables["interactions"], tables["skill_vocab"]).select(
        "item", F.round("value", 6).alias("value")
    )


def raw_scan(spark, d):
    """Action rows written as tab-separated text in event order and read back with their row index."""
    folder = shared_folder(spark, "raw")
    rows = b.raw_actions(spark, d)
    names = ["user_id", "jd_no", "browsed", "delivered", "satisfied"]
    ordered = rows.repartitionByRange("row_index").sortWithinPartitions("row_index")
    ordered.select(F.concat_ws("\t", *names).alias("value")).write.text(f"{folder}/b_rows")
    spark.createDataFrame([("\t".join(names),)], "value string").coalesce(1).write.text(f"{folder}/a_header")
    table = raw.read_table(spark, [f"{folder}/a_header", f"{folder}/b_rows"])
    return first_rows(table, None).select(*names, "row_index")


def raw_preview(spark, d):
    return raw.preview(b.raw_users(spark, d))


def metrics_sink(spark, d):
    """Metric rows with different columns written under their union and read back."""
    bundle = b.bundle(spark, d)
    first = experiments.compare_models(bundle, ["popularity"], ks=(10,)).select("model", "n_seeds", "mrr")
    second = bundle.pairs("test").agg(F.count(F.lit(1)).alias("test_pairs")).withColumn("model", F.lit("split"))
    folder = shared_folder(spark, "metrics")
    sinks.write_metrics(sinks.metrics_table(first, second), folder)
    rows = spark.read.option("header", True).csv(f"{folder}/metrics_csv")
    numbers = [F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in (("n_seeds", "long"), ("mrr", "double"), ("test_pairs", "long"))]
    return rows.select("model", *numbers).withColumn("mrr", F.round("mrr", 6))


def user_ndcg_sink(spark, d):
    """Per-user NDCG written partitioned by model and seed, and read back."""
    folder = shared_folder(spark, "user_ndcg")
    bundle = b.bundle(spark, d)
    sinks.write_user_ndcg(evaluation.user_ndcg(experiments.rank_popularity(bundle), bundle.pairs("test"), "popularity", 42), folder)
    return spark.read.parquet(folder).select("model", F.col("seed").cast("int").alias("seed"), "user_id", F.round("ndcg", 6).alias("ndcg"))


def vector_tables(spark, d):
    """Vector tables of a run written and read back: length and first place of every vector."""
    folder = shared_folder(spark, "vectors")
    users, jobs = b.node_vectors(spark, d)
    stored = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    for name, rows in (("user", users), ("job", jobs), ("skill", stored)):
        rows.write.parquet(f"{folder}/emb_{name}")
    shown = [
        t.select(F.lit(name).alias("side"), F.col("id").cast("long").alias("id"), F.size("vector").alias("places"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))
        for name, t in readers.read_vectors(spark, folder).items()
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def stored_rankings(spark, d):
    """Popularity ranking stored and read back as served orders."""
    folder = shared_folder(spark, "rankings")
    experiments.rank_popularity(b.bundle(spark, d), topn=20).write.parquet(folder)
    return readers.read_rankings(spark, folder)


def occupation_reference(spark, d):
    """Occupation reference document built from nations and parts, written as JSON, read back as terms."""
    parts, nations = b.table(spark, d, "part"), b.table(spark, d, "nation")
    name = F.concat("p_brand", F.lit(" "), "p_type")
    occupations = parts.select(F.array(F.struct(name.alias("name"), F.concat(name, F.lit("；x")).alias("task"))).alias("occupations"))
    docs = occupations.unionByName(nations.select(F.array("n_name").alias("career_categories")), allowMissingColumns=True)
    folder = shared_folder(spark, "reference")
    docs.write.json(folder)
    raw_docs = spark.read.schema(readers.REFERENCE_SCHEMA).json(folder)
    return readers.reference_terms(raw_docs)


# Evidence -------------------------------------------------------------------------------------


def _known_pairs(spark, d) -> DataFrame:
    known = b.levels(spark, d).groupBy("user_id", "job_id").agg(F.sum("level").cast("double").alias("score"))
    return pairs.attach_profiles(known, b.users(spark, d), b.jobs_with_stated_degree(spark, d))


def _logits(spark, d) -> DataFrame:
    """Inverse document frequency of each job skill."""
    posts = b.jobs(spark, d)
    entries = pairs.skill_entries(posts, "job_id")
    n = posts.agg(F.count(F.lit(1)).alias("n"))
    idf = pairs.skill_frequency(posts).select("skill", F.log((n.scalar() + 1) / (F.col("frequency") + 1)).alias("idf"))
    return entries.join(idf, "skill").select("job_id", "skill", (F.col("weight") * F.col("idf")).alias("logit"))


def match_evidence_v1(spark, d):
    rows = evidence.first_generation_evidence(_known_pairs(spark, d))
    return rows.select(
        "user_id", "job_id", F.round("rule_score", 6).alias("rule_score"), F.array_join("matched_skills", "|").alias("matched"),
        F.array_join("missing_skills", "|").alias("missing"), F.array_join("graph_paths", "|").alias("paths"), F.array_join("reasons", "|").alias("reasons"),
    )


def _evidence_v2(spark, d) -> DataFrame:
    return evidence.second_generation_evidence(_known_pairs(spark, d), _logits(spark, d))


def match_evidence_v2(spark, d):
    rows = _evidence_v2(spark, d)
    return rows.select(
        "user_id", "job_id", F.array_join("matched_skills.skill", "|").alias("matched"), F.array_join("missing_skills", "|").alias("missing"),
        F.array_join("reasons", "|").alias("reasons"), F.size("graph_paths").alias("paths"), F.array_join(evidence.allowed_terms(), "|").alias("allowed"),
    )


def path_attention(spark, d):
    rows = _evidence_v2(spark, d).select("user_id", "job_id", F.inline("attention"))
    return rows.select("user_id", "job_id", "skill", F.round("weight", 6).alias("weight"))


def pooled_paths(spark, d):
    """Attention-pooled path vectors and mean gap vectors; a skill's vector is the stored one at its rank."""
    skills = b.all_jobs(spark, d).select(F.explode("skills").alias("skill")).distinct()
    numbered = dense_index(skills, "skill", "vec_id")
    vectors = numbered.join(b.table(spark, d, "embeddings"), "vec_id").select("skill", F.col("embedding").alias("vector"))
    rows = _evidence_v2(spark, d).withColumn("gap_skills", F.col("missing_skills"))
    pooled = propagation.pooled_paths(rows, vectors, DIM)
    return _by_dimension(pooled.select("user_id", "job_id", F.concat("path_vector", "gap_vector").alias("vector")), "user_id", "job_id")


def subgraph_edges(spark, d):
    rows = evidence.local_subgraph(_evidence_v2(spark, d))
    return rows.select("user_id", "job_id", F.explode("local_subgraph.edges").alias("_e")).select(
        "user_id", "job_id", F.col("_e.source").alias("source"), F.col("_e.target").alias("target"), F.col("_e.relation").alias("relation"),
        F.coalesce(F.col("_e.attributes")["status"], F.lit("")).alias("status"),
    )


def subgraph_nodes(spark, d):
    rows = evidence.local_subgraph(_evidence_v2(spark, d))
    return rows.select("user_id", "job_id", F.explode("local_subgraph.nodes").alias("_n")).select(
        "user_id", "job_id", F.col("_n.id").alias("node"), F.col("_n.type").alias("type"), F.col("_n.label").alias("label"), F.col("_n.role").alias("role")
    )


def _texts(spark, d) -> DataFrame:
    """Supplied explanation texts: one skill of the part with the next number is named in each."""
    named = b.all_jobs(spark, d).select((F.col("job_id") - 1).alias("job_id"), F.element_at("skills", 1).alias("_s"))
    known = b.levels(spark, d).select("user_id", "job_id").distinct()
    return known.join(named, "job_id").select("user_id", "job_id", F.concat(F.lit("Fits <you>: "), "_s", F.lit(" & more.\nGood luck")).alias("text"))


def _explained(spark, d) -> DataFrame:
    vocabulary = b.all_jobs(spark, d).select(F.explode("skills").alias("skill")).distinct()
    return evidence.grounded_explanations(written(_evidence_v2(spark, d), "evidence"), written(_texts(spark, d), "texts"), vocabulary)


def explanations(spark, d):
    rows = _explained(spark, d)
    return rows.select("user_id", "job_id", "text", "html", "source", F.coalesce("rejected_text", F.lit("")).alias("rejected"))


def explanation_documents(spark, d):
    """Explained pairs with their payload written as JSON text and read back."""
    folder = shared_folder(spark, "explanations")
    rows = evidence.local_subgraph(_explained(spark, d)).withColumn("payload", evidence.evidence_payload())
    sinks.write_explanations(rows, folder, "user_id", "job_id", "text", "source", "payload")
    value = F.col("value")
    found = spark.read.text(folder).select(
        F.get_json_object(value, "$.user_id").cast("long").alias("user_id"), F.get_json_object(value, "$.job_id").cast("long").alias("job_id"),
        F.get_json_object(value, "$.source").alias("source"), F.get_json_object(value, "$.payload").alias("_p"),
    )
    return found.select("user_id", "job_id", "source", F.get_json_object("_p", "$.local_subgraph.schema_version").alias("schema_version"))


def requirement_explanations(spark, d):
    people, posts = _requirement_sides(spark, d)
    known = b.levels(spark, d).select("user_id", "job_id").distinct()
    rows = evidence.requirement_explanation(pairs.attach_profiles(known, people, posts))
    return rows.select(
        "user_id", "job_id", F.array_join("matched_skills", "|").alias("matched"), F.array_join("missing_skills", "|").alias("missing"),
        F.size("graph_paths").alias("paths"), F.array_join("reasons", "|").alias("reasons"),
    )


# Recommendation -------------------------------------------------------------------------------


def _service_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    behaviour = written(b.levels(spark, d), "levels")
    people = b.users(spark, d, behaviour).withColumn("user_id", F.col("user_id").cast("string")).withColumn("degree", F.col("degree_rank").cast("string"))
    posts = b.jobs_with_stated_degree(spark, d, behaviour).withColumn("job_id", F.col("job_id").cast("string"))
    return cut_lineage(people), cut_lineage(posts)


def _requests(spark, d) -> DataFrame:
    """One request per customer; models, sizes and missing ids follow from the customer number."""
    key = F.col("c_custkey")
    model = F.element_at(F.array(*[F.lit(m) for m in ("rule", "Graph", "bm25", "semantic_hash", "unknown")]), (key % 5 + 1).cast("int"))
    return b.table(spark, d, "customer").select(
        F.concat(F.lit("r"), key).alias("request_id"),
        F.when(key % 11 == 10, None).otherwise(key.cast("string")).alias("candidate_id"),
        F.lit(None).cast(recommend.PROFILE_SCHEMA).alias("candidate_profile"),
        model.alias("model"),
        (key % 7 * 20).cast("int").alias("top_k"),
        (key % 2 == 0).alias("include_explanations"),
    )


def _stored(spark, d) -> DataFrame:
    bundle = b.bundle(spark, d)
    ranked = experiments.rank_popularity(bundle, topn=20)
    return ranked.where(F.col("user_id") % 2 == 0).select(F.col("user_id").cast("string"), F.col("job_id").cast("string"), "rank")


def _stored_whole(spark, d) -> DataFrame:
    ranked = experiments.rank_popularity(b.bundle(spark, d), topn=recommend.MAX_TOP_K)
    return ranked.select(F.col("user_id").cast("string"), F.col("job_id").cast("string"), "rank")


def recommendations(spark, d):
    """Every customer's request answered; the store holds as many places as a request can ask, for all test users."""
    people, posts = _service_tables(spark, d)
    items = recommend.recommend(_requests(spark, d), people, posts, _stored_whole(spark, d), **WHOLE_TEXTS)["items"]
    return items.select("request_id", "candidate_id", "model", "rank", "job_id", F.round("score", 6).alias("score"),
                        F.array_join("matched_skills", "|").alias("matched"), F.size("warnings").alias("warnings"))


def recommendations_by_rule(spark, d):
    """The requests that end in the rule ranking, by name or as a fallback."""
    people, posts = _service_tables(spark, d)
    asked = _requests(spark, d).withColumn("model", F.when(F.col("model").isin("rule", "unknown"), F.col("model")).otherwise("graph"))
    items = recommend.recommend(asked, people, posts, _stored(spark, d), **WHOLE_TEXTS)["items"]
    return items.select("request_id", "candidate_id", "model", "rank", "job_id", F.round("score", 6).alias("score"),
                        F.array_join("matched_skills", "|").alias("matched"), F.size("warnings").alias("warnings"))


def recommendations_for_profiles(spark, d):
    """Every customer segment described as an ad-hoc profile and ranked by rules."""
    people, posts = _service_tables(spark, d)
    profile = F.struct(
        F.concat(F.lit("p"), F.col("user_id")).alias("candidate_id"), F.col("skills").alias("skills"), F.col("text").alias("experience_text"),
        F.col("desired_city_ids"), F.col("city_ids").alias("current_city_ids"), F.col("industries"), F.col("desired_types").alias("desired_job_types"),
        F.lit("").alias("degree"), F.col("years").alias("years_experience"),
    )
    asked = people.select(
        F.concat(F.lit("p"), "user_id").alias("request_id"), F.lit(None).cast("string").alias("candidate_id"), profile.alias("candidate_profile"),
        F.lit("rule").alias("model"), F.lit(10).alias("top_k"), F.lit(True).alias("include_explanations"),
    )
    items = recommend.recommend(asked, people, posts, **WHOLE_TEXTS)["items"]
    return items.select("request_id", "candidate_id", "rank", "job_id", F.round("score", 6).alias("score"))


def rejected_requests(spark, d):
    people, _ = _service_tables(spark, d)
    _, rejected = recommend.resolve_requests(_requests(spark, d), people)
    return rejected.select("request_id", "error_code")


def candidate_pages(spark, d):
    """Candidates per job by match percentage, second page of ten."""
    rows = _known_pairs(spark, d).select("user_id", "job_id", *pair_features_v1())
    scored = rows.select("job_id", "user_id", recommend.match_percent(rule_score_v1(), F.lit(1.0)).alias("match"))
    return recommend.paged(scored, "job_id", F.col("match"), "user_id", 2, 10)


def health(spark, d):
    return recommend.health(b.users(spark, d), b.jobs(spark, d)).select("item", F.col("count").alias("n"))


def invalid_profiles(spark, d):
    people = b.raw_users(spark, d).withColumn("candidate_id", F.when(F.col("row_index") % 10 == 0, "").otherwise(F.col("user_id")))
    return recommend.invalid_profiles(people, ["candidate_id", "live_city_id"]).select("user_id", "reason")


def invalid_jobs(spark, d):
    """Job profiles without an id or a title."""
    posts = b.raw_jobs(spark, d).withColumn("title", F.when(F.col("row_index") % 13 == 0, "").otherwise(F.col("jd_title")))
    posts = posts.withColumn("job_id", F.when(F.col("row_index") % 10 == 0, "").otherwise(F.col("jd_no")))
    return recommend.invalid_profiles(posts, ["job_id", "title"]).select("jd_no", "reason")


def candidate_pages_by_experience(spark, d):
    """Candidates per job, the most experienced first, first page of five."""
    rows = _known_pairs(spark, d).select("user_id", "job_id", "years")
    return recommend.paged(rows, "job_id", F.col("years"), "user_id", 1, 5)


def job_candidate_pages(spark, d):
    """All users ranked for every hundredth job by match, salary and experience: one page each, near the top or far down."""
    people = b.users(spark, d).join(b.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("salary")), "user_id")
    posts = b.all_jobs(spark, d).where(F.col("job_id") % 100 == 0).withColumn(
        "min_degree", F.when(F.col("min_degree_rank") == 0, "").otherwise(F.col("min_degree_rank").cast("string"))
    )
    sort = F.explode(F.array(F.lit("match"), F.lit("salary"), F.lit("experience"))).alias("sort_by")
    renamed = [F.col(c).alias(f"job_{c}") for c in ("city", "job_type", "min_degree", "min_degree_rank", "min_years", "skills")]
    asked = posts.select("job_id", *renamed, sort).withColumn("request_id", F.concat_ws(":", "job_id", "sort_by"))
    asked = asked.withColumn("page", (F.col("job_id") / 100 * 13 % 60 + 1).cast("int")).withColumn("page_size", F.lit(20))

    def keys(values):
        return term_keys(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull())))

    # what the matrix form of the score reads
    people = people.withColumns({"skill_keys": keys(F.col("skills")), "city_keys": keys(F.concat("city_ids", "desired_city_ids")), "type_keys": keys(F.col("desired_types"))})
    asked = asked.withColumns({
        "skill_keys_": keys(F.col("job_skills")), "city_keys_": keys(F.array("job_city")), "type_keys_": keys(F.array(F.nullif("job_job_type", F.lit("")))),
        "n_skills": F.size(F.array_distinct("job_skills")), "degree_stated": F.coalesce((F.col("job_min_degree") != "").cast("int"), F.lit(0)),
    })

    def values(jobs, users):
        jobs = jobs.rename_columns([c.removesuffix("_") if c.endswith("keys_") else c for c in jobs.column_names])
        levels = scoring.rule_levels_v1_block(jobs, users)

        def percent(start, stop):
            codes, table = levels(start, stop)
            found = np.floor(100.0 * table + 0.5)
            return codes, np.where(np.isnan(found), 100.0, np.clip(found, 0, 100))  # as match_percent does

        return percent

    def score(rows):
        rows = rows.select("*", *pair_features_v1()).withColumn("match", recommend.match_percent(rule_score_v1(), F.lit(1.0)))
        value = F.when(F.col("sort_by") == "match", F.col("match")).when(F.col("sort_by") == "salary", F.col("salary")).otherwise(F.col("years"))
        return rows.select("request_id", "user_id", "place", "match", value.cast("double").alias("value"))

    reads = ("skill_keys", "city_keys", "type_keys", "degree_rank", "years")
    pages = reverse.candidate_pages(asked, people, score, own_order={"salary": "salary", "experience": "years"}, values=values, block=8192, reads=reads, limits=(0, 100))
    return pages.select("job_id", "sort_by", "page", "place", "user_id", "match", F.round("value", 2).alias("value"), "total", "total_pages")


# Taxonomy -------------------------------------------------------------------------------------


def taxonomy_tree(spark, d):
    """Regions, nations and customers as one code tree."""
    regions = b.table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("career_code"), F.lit(None).cast("string").alias("parent_code"), F.col("r_name").alias("name"))
    nations = b.table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), "n_name")
    people = b.table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), "c_name")
    tree = taxonomy.flatten_tree(regions.union(nations).union(people))
    return tree.select("career_code", "name", F.coalesce("parent_code", F.lit("")).alias("parent_code"), F.array_join("path", "/").alias("path"), "has_children")


def latest_occupations(spark, d):
    rows = b.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("career_code"), F.length("event_type").alias("version_id"), F.col("event_type").alias("name"),
        F.col("value"), F.col("event_id").alias("row_index"),
    )
    return taxonomy.latest_occupations(rows)


QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes, graph_edges, graph_stats, pruned_graph_edges, dimension_values, message_graph, graph_export, candidates_v1,
        jobs_v1, processed_users, processed_jobs, processed_run, raw_scan, raw_preview, metrics_sink, stored_rankings,
        occupation_reference, match_evidence_v1, match_evidence_v2, path_attention, pooled_paths, subgraph_edges, subgraph_nodes,
        explanations, explanation_documents, requirement_explanations, recommendations, recommendations_by_rule,
        recommendations_for_profiles, rejected_requests, candidate_pages, candidate_pages_by_experience, job_candidate_pages, health, invalid_profiles, invalid_jobs, user_ndcg_sink, vector_tables, taxonomy_tree,
        latest_occupations,
    )
}
