"""Recruitment knowledge graph: typed nodes, typed edges, statistics, and the train-only message graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import BEHAVIOUR_WEIGHTS, flag_is_set
from ..functions.text import clean_token, extract_skill_tokens, node_id, normalize_value, split_multi_value
from ..session import spread, written
from .interactions import browsed_pairs, positives
from .ordering import first_occurrence
from .pairs import skill_entries

# ---- fixed values ---------------------------------------------------------------------------
USER_FIELDS = [
    "live_city_id", "desire_jd_city_id", "desire_jd_industry_id", "desire_jd_type_id", "desire_jd_salary_id",
    "cur_industry_id", "cur_jd_type", "cur_salary_id", "cur_degree_id", "birthday", "start_work_date", "experience",
]
JOB_FIELDS = [
    "jd_title", "company_name", "city", "jd_sub_type", "require_nums", "max_salary", "min_salary", "start_date",
    "end_date", "is_travel", "min_years", "key", "min_edu_level", "max_edu_level", "is_mangerial",
    "resume_language_required", "job_description",
]
# (relation, source field, target node type)
USER_RELATIONS = [
    ("LIVES_IN_CITY", "live_city_id", "city"),
    ("DESIRES_CITY", "desire_jd_city_id", "city"),
    ("DESIRES_INDUSTRY", "desire_jd_industry_id", "industry"),
    ("DESIRES_JOB_TYPE", "desire_jd_type_id", "job_type"),
    ("CURRENT_INDUSTRY", "cur_industry_id", "industry"),
    ("CURRENT_JOB_TYPE", "cur_jd_type", "job_type"),
    ("HAS_DEGREE", "cur_degree_id", "degree"),
]
JOB_RELATIONS = [
    ("LOCATED_IN_CITY", "city", "city"),
    ("BELONGS_TO_JOB_TYPE", "jd_sub_type", "job_type"),
    ("REQUIRES_DEGREE", "min_edu_level", "degree"),
]
STAT_ITEMS = {"city": "cities", "industry": "industries", "job_type": "job_types", "degree": "degrees",
              "company": "companies", "skill": "skills"}
# ---------------------------------------------------------------------------------------------

USER_TABLE, JOB_TABLE, ACTION_TABLE = "table1_user", "table2_jd", "table3_action"


def _cells(table: DataFrame, id_col: str, fields: list[str], key: str) -> DataFrame:
    """Normalized cells of the known fields; absent columns read as empty, rows without id are rejected."""
    order = F.col("row_index") if "row_index" in table.columns else F.monotonically_increasing_id()
    cells = [normalize_value(F.col(c)).alias(c) if c in table.columns else F.lit("").alias(c) for c in fields]
    return table.select(normalize_value(F.col(id_col)).alias(key), *cells, order.alias("row_index")).where(F.col(key) != "")


def user_cells(users: DataFrame) -> DataFrame:
    return _cells(users, "user_id", USER_FIELDS, "user_id")


def job_cells(jobs: DataFrame) -> DataFrame:
    return _cells(jobs, "jd_no", JOB_FIELDS, "job_id")


def attributes_json(fields: list[str]) -> Column:
    """Attributes as JSON text with sorted keys; empty values are kept."""
    return F.to_json(F.struct(*sorted(fields)))


def entity_nodes(cells: DataFrame, node_type: str, key: str, fields: list[str], name: Column) -> DataFrame:
    """User or job nodes, first occurrence per node id."""
    rows = cells.select(
        node_id(node_type, F.col(key)).alias("node_id"),
        F.lit(node_type).alias("node_type"),
        name.alias("node_name"),
        attributes_json(fields).alias("attributes_json"),
        "row_index",
    )
    return first_occurrence(rows, ["node_id"], "row_index").drop("row_index")


def user_nodes(cells: DataFrame) -> DataFrame:
    return entity_nodes(cells, "user", "user_id", USER_FIELDS, F.col("user_id"))


def job_nodes(cells: DataFrame) -> DataFrame:
    title = F.coalesce(F.nullif(F.col("jd_title"), F.lit("")), F.col("job_id"))
    return entity_nodes(cells, "job", "job_id", JOB_FIELDS, title)


def dimension_nodes(values: DataFrame) -> DataFrame:
    """Nodes of (node_type, value) rows, cleaned once more; values that clean to the same token become one node."""
    cleaned = values.select("node_type", clean_token(F.col("value"), lower_ascii=False).alias("value"))
    return (
        cleaned.where(F.col("value") != "")
        .distinct()
        .select(
            node_id(F.col("node_type"), F.col("value")).alias("node_id"),
            "node_type",
            F.col("value").alias("node_name"),
            F.to_json(F.struct(F.col("value").alias("name"))).alias("attributes_json"),
        )
    )


def _multi_values(cells: DataFrame, key: str, relations: list[tuple[str, str, str]]) -> DataFrame:
    """(key, relation, field, target_type, value): every multi-value cell unpivoted and exploded."""
    entries = F.array(
        *[
            F.struct(
                F.lit(relation).alias("relation"),
                F.lit(source).alias("field"),
                F.lit(target).alias("target_type"),
                split_multi_value(F.col(source), lower_ascii=False).alias("values"),
            )
            for relation, source, target in relations
        ]
    )
    # outer generators: plain ones make the optimizer test the arrays first, which splits every cell once more
    flat = cells.select(key, F.inline_outer(entries))
    return flat.select(key, "relation", "field", "target_type", F.posexplode_outer("values").alias("_pos", "value")).where("_pos is not null").drop("_pos")


def _edges(rows: DataFrame, source_type: str, key: str, evidence: Column, weight: Column) -> DataFrame:
    """Edge rows with both ends cleaned once more; an edge with an empty end is dropped."""
    return (
        rows.withColumn("_source", clean_token(F.col(key), lower_ascii=False))
        .withColumn("_target", clean_token(F.col("value"), lower_ascii=False))
        .where((F.col("_source") != "") & (F.col("_target") != ""))
        .select(
            node_id(source_type, F.col("_source")).alias("source_id"),
            F.lit(source_type).alias("source_type"),
            "relation",
            node_id(F.col("target_type"), F.col("_target")).alias("target_id"),
            "target_type",
            weight.cast("double").alias("weight"),
            evidence.alias("evidence"),
        )
    )


def attribute_edges(cells: DataFrame, source_type: str, key: str, relations: list, table: str) -> DataFrame:
    evidence = F.concat(F.lit(table + "."), F.col("field"))
    return _edges(_multi_values(cells, key, relations), source_type, key, evidence, F.lit(1.0))


def user_skills(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """(user_id, value) skill rows of the experience field."""
    return _listed(cells, "user_id", extract_skill_tokens(F.col("experience"), limit))


def job_skills(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """(job_id, value) skill rows of title and description."""
    text = F.concat("jd_title", F.lit("\n"), "job_description")
    return _listed(cells, "job_id", extract_skill_tokens(text, limit))


def _listed(cells: DataFrame, key: str, tokens: Column) -> DataFrame:
    return cells.select(key, F.posexplode_outer(tokens).alias("_pos", "value")).where("_pos is not null").drop("_pos")


def skill_edges(skills: DataFrame, source_type: str, key: str, relation: str, evidence: str) -> DataFrame:
    rows = skills.withColumn("relation", F.lit(relation)).withColumn("target_type", F.lit("skill"))
    return _edges(rows, source_type, key, F.lit(evidence), F.lit(1.0))


def behaviour_edges(actions: DataFrame) -> DataFrame:
    """One weighted edge per set flag of an action row."""
    flags = F.array(
        *[
            F.struct(
                F.lit(f"{name.upper()}_JOB").alias("relation"),
                F.lit(weight).alias("weight"),
                flag_is_set(F.col(name)).alias("set"),
            )
            for name, weight in BEHAVIOUR_WEIGHTS.items()
            if name in actions.columns
        ]
    )
    rows = actions.select(
        normalize_value(F.col("user_id")).alias("user_id"),
        normalize_value(F.col("jd_no")).alias("value"),
        F.lit("job").alias("target_type"),
        F.inline(flags),
    ).where((F.col("user_id") != "") & (F.col("value") != "") & F.col("set"))
    return _edges(rows, "user", "user_id", F.lit(ACTION_TABLE), F.col("weight"))


def dimension_values(users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Distinct (node_type, value) of cities, industries, job types, degrees and companies of both sides."""
    both = _multi_values(users, "user_id", USER_RELATIONS).select(F.col("target_type").alias("node_type"), "value").union(
        _multi_values(jobs, "job_id", JOB_RELATIONS).select("target_type", "value")
    )
    companies = jobs.where(F.col("company_name") != "").select(F.lit("company").alias("node_type"), F.col("company_name").alias("value"))
    return both.union(companies).distinct()


def skill_values(user_skill_rows: DataFrame, job_skill_rows: DataFrame, min_freq: int = 1) -> DataFrame:
    """Skills frequent enough on at least one side; the two counts are tested separately."""

    def frequent(rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
        return counted.where(F.col("_n") >= min_freq).select(F.lit("skill").alias("node_type"), "value")

    return frequent(user_skill_rows).union(frequent(job_skill_rows)).distinct()


def node_table(user_rows: DataFrame, job_rows: DataFrame, values: DataFrame) -> DataFrame:
    """All nodes: users, jobs and the observed dimension values."""
    return user_nodes(user_rows).unionByName(job_nodes(job_rows)).unionByName(dimension_nodes(values))


def edge_table(user_rows: DataFrame, job_rows: DataFrame, u_skills: DataFrame, j_skills: DataFrame, actions: DataFrame) -> DataFrame:
    """All edges, each once."""
    return (
        attribute_edges(user_rows, "user", "user_id", USER_RELATIONS, USER_TABLE)
        .unionByName(skill_edges(u_skills, "user", "user_id", "HAS_SKILL", USER_TABLE + ".experience"))
        .unionByName(attribute_edges(job_rows, "job", "job_id", JOB_RELATIONS, JOB_TABLE))
        .unionByName(skill_edges(j_skills, "job", "job_id", "REQUIRES_SKILL", JOB_TABLE + ".jd_title+job_description"))
        .unionByName(behaviour_edges(actions))
        .distinct()
    )


def build_graph(
    users: DataFrame, jobs: DataFrame, actions: DataFrame, min_skill_freq: int = 1,
    user_skill_limit: int | None = None, job_skill_limit: int | None = None,
    prune_dangling: bool = False, parts: tuple[str, ...] = ("nodes", "edges", "stats"),
) -> dict[str, DataFrame]:
    """The asked ``parts`` of ``nodes``, ``edges`` and ``stats`` from the three raw tables.

    Rare skills lose their node but keep their edges unless ``prune_dangling`` is set. Users and jobs are
    counted before deduplication, edges after. Cells, skills and what several parts share are written once.
    """
    u, j = written(user_cells(spread(users, "user_id")), "user_cells"), written(job_cells(spread(jobs, "jd_no")), "job_cells")
    u_skills, j_skills = user_skills(u, user_skill_limit), job_skills(j, job_skill_limit)
    if "nodes" in parts and parts != ("nodes",):
        u_skills, j_skills = written(u_skills, "user_skills"), written(j_skills, "job_skills")
    graph: dict[str, DataFrame] = {}
    if parts != ("edges",) or prune_dangling:
        values = dimension_values(u, j).union(skill_values(u_skills, j_skills, min_skill_freq))
        values = written(values, "values") if "stats" in parts else values
        graph["nodes"] = node_table(u, j, values)
    if parts != ("nodes",):
        edges = edge_table(u, j, u_skills, j_skills, spread(actions, "user_id", "jd_no"))
        if prune_dangling:
            edges = edges.join(graph["nodes"].select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
        graph["edges"] = written(edges, "edges") if "stats" in parts else edges
    if "stats" in parts:
        graph["stats"] = graph_stats(u, j, values, graph["edges"])
    return {name: graph[name] for name in parts}


def graph_stats(user_rows: DataFrame, job_rows: DataFrame, values: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, count) for users, jobs, every dimension and edges; dimensions without values count 0."""

    def counted(df: DataFrame, item: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(item).alias("item"), "count")

    per_type = values.groupBy().agg(*[F.count_if(F.col("node_type") == t).alias(name) for t, name in STAT_ITEMS.items()])
    dimensions = per_type.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("count")) for n in STAT_ITEMS.values()])).alias("_s")
    ).select("_s.*")
    return counted(user_rows, "users").union(counted(job_rows, "jobs")).union(dimensions).union(counted(edges, "edges"))


# Message graph --------------------------------------------------------------------------------


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and their reverses; the relation name is read backwards."""
    back = edges.select(F.reverse("relation").alias("relation"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("relation", "src", "dst").unionByName(back)


def message_graph(users: DataFrame, jobs: DataFrame, interactions: DataFrame, include_browsed: bool = False) -> DataFrame:
    """(relation, src, dst) of candidate-skill, job-skill and candidate-job edges with reverses.

    Only train positives link candidates and jobs, so held-out rows never leak into a message.
    """
    def skills_of(df: DataFrame, key: str, relation: str) -> DataFrame:
        rows = skill_entries(df, key)
        return rows.select(F.lit(relation).alias("relation"), F.col(key).cast("string").alias("src"), F.col("skill").alias("dst"))

    linked = positives(interactions, "train")
    if include_browsed:
        linked = linked.unionAll(browsed_pairs(interactions))
    behaviour = linked.select(
        F.lit("cj").alias("relation"), F.col("user_id").cast("string").alias("src"), F.col("job_id").cast("string").alias("dst")
    )
    return with_reverse(skills_of(users, "user_id", "cs").unionByName(skills_of(jobs, "job_id", "js")).unionByName(behaviour))
