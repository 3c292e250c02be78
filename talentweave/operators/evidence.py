"""Match evidence and explanations, one row per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import FEATURE_NAMES, flag, gap_skills, head, pair_features_v1, rule_score_v1, shared_skills
from ..functions.text import escape_html, strip
from ..session import broadcast_if_small
from .propagation import path_attention

# ---- fixed values ---------------------------------------------------------------------------
SCHEMA_VERSION = "local_kg_v1"
REASONS_V1 = {
    "coverage": "技能覆盖度 ",
    "city_match": "城市匹配",
    "education_match": "学历满足岗位要求",
    "experience_match": "经验满足岗位要求",
    "job_type_match": "岗位类型符合期望",
    "none": "根据当前模型排序进入 Top-K",
}
REASONS_V2 = {
    "city": "工作城市符合期望",
    "degree": "学历满足岗位要求",
    "years": "工作年限满足岗位要求",
    "type": "岗位类型符合求职意向",
}
REASONS_REQUIREMENT = {"skills": "技能覆盖度较高", "city": "城市匹配"}
SKILL_TERM = r"([A-Za-z][A-Za-z0-9+.#]{2,})"
ASCII_VOCABULARY = r"^[A-Za-z0-9+.#]+$"
# ---------------------------------------------------------------------------------------------


def _present(*candidates: Column) -> Column:
    return F.filter(F.array(*candidates), lambda r: r.isNotNull())


def _paths(user: Column, job: Column, skills: Column) -> Column:
    """Plain path texts; user and job ride along so the lambda sees them."""
    return F.transform(
        skills, lambda s: F.concat(F.lit("Candidate:"), user, F.lit(" -> Skill:"), s, F.lit(" <- Job:"), job)
    )


def first_generation_evidence(pairs: DataFrame, include_explanations: bool = True) -> DataFrame:
    """Feature map, score, matched and missing skills, paths and reasons of profile-joined pairs."""
    features = pairs.withColumns({name: c for name, c in zip(FEATURE_NAMES, pair_features_v1(), strict=True)})
    scored = features.withColumn("rule_score", rule_score_v1())
    rounded = {n: F.round(F.col(n), 6) for n in FEATURE_NAMES}
    feature_map = F.create_map(*[x for n in FEATURE_NAMES for x in (F.lit(n), rounded[n])])
    matched = F.array_sort(F.array_distinct(shared_skills(F.col("skills"), F.col("job_skills"))))
    missing = F.array_sort(gap_skills(F.col("skills"), F.col("job_skills")))
    reasons = _present(
        F.when(rounded[FEATURE_NAMES[0]] > 0, F.concat(F.lit(REASONS_V1["coverage"]), F.format_string("%.2f", rounded[FEATURE_NAMES[0]]))),
        *[F.when(rounded[n] >= 1.0, REASONS_V1[n]) for n in ("city_match", "education_match", "experience_match", "job_type_match")],
    )
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit(REASONS_V1["none"]))).otherwise(reasons)
    out = scored.withColumn("feature_evidence", feature_map).withColumn("matched_skills", matched).withColumn("missing_skills", missing)
    out = out.withColumn(
        "graph_paths",
        _paths(F.col("user_id").cast("string"), F.col("job_id").cast("string"), F.col("matched_skills")),
    ).withColumn("reasons", reasons)
    if not include_explanations:
        nothing = F.array().cast("array<string>")
        out = out.withColumns({c: nothing for c in ("matched_skills", "missing_skills", "graph_paths", "reasons")})
    return out.drop(*FEATURE_NAMES)


def second_generation_evidence(pairs: DataFrame, logits: DataFrame) -> DataFrame:
    """Matched skills with attention weights, missing skills, reasons and weighted paths.

    ``pairs`` is profile-joined and carries ``score``; ``logits`` (job_id, skill, logit).
    """
    shared = shared_skills(F.col("skills"), F.col("job_skills"))
    attended = path_attention(pairs.withColumn("path_skills", shared), logits)
    matched = F.transform(
        F.array_sort(F.transform("attention", lambda e: F.struct((-e["weight"]).alias("w"), e["skill"].alias("skill")))),
        lambda e: F.struct(e["skill"].alias("skill"), F.round(-e["w"], 4).alias("weight")),
    )
    n_job, n_shared = F.size("job_skills"), F.size("path_skills")
    share = F.bround(100.0 * n_shared / F.greatest(F.lit(1), n_job), 0).cast("int")
    cities = F.concat("desired_cities", F.array("live_city"))
    reasons = _present(
        F.concat(F.lit("技能覆盖率 "), share, F.lit("%("), n_shared, F.lit("/"), n_job, F.lit(" 项要求技能匹配)")),
        F.when(F.array_contains(cities, F.col("job_city")), REASONS_V2["city"]),
        F.when((F.col("degree_rank") >= F.col("job_min_degree_rank")) & (F.col("job_min_degree_rank") > 0), REASONS_V2["degree"]),
        F.when((F.col("years") >= F.col("job_min_years")) & (F.col("job_min_years") > 0), REASONS_V2["years"]),
        F.when(F.array_contains("desired_types", F.col("job_job_type")), REASONS_V2["type"]),
    )
    out = attended.withColumn("matched_skills", matched).withColumn("reasons", reasons).withColumn(
        "missing_skills", gap_skills(F.col("skills"), F.col("job_skills"))
    )
    user, job = F.col("user_id").cast("string"), F.col("job_id").cast("string")
    paths = F.transform(
        "matched_skills",
        lambda s: F.concat(
            F.lit("Candidate:"), user, F.lit(" -HAS_SKILL("), s["weight"].cast("string"), F.lit(")-> Skill:"), s["skill"],
            F.lit(" <-REQUIRES_SKILL- Job:"), job,
        ),
    )
    return out.withColumn("graph_paths", paths).withColumn("score", F.round("score", 4))


def attributes(**values: Column) -> Column:
    """Attribute map without missing and empty values."""
    entries = F.map_from_arrays(
        F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()])
    )
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))


def _node(node: Column, kind: str, label: Column, role: str, attrs: Column) -> Column:
    return F.struct(
        node.alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"), F.lit(role).alias("role"), attrs.alias("attributes")
    )


def _edge(source: Column, target: Column, relation: str, attrs: Column | None = None) -> Column:
    none = F.map_filter(F.create_map(F.lit(""), F.lit("")), lambda k, v: F.lit(False))
    return F.struct(
        source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"),
        (none if attrs is None else attrs).alias("attributes"),
    )


def local_subgraph(evidence: DataFrame, max_missing: int | None = None) -> DataFrame:
    """Add ``local_subgraph``: the pair, its matched and missing skills, and city and type context.

    Skill order follows the evidence; city and type nodes come in value order.
    """
    user, job = F.col("user_id").cast("string"), F.col("job_id").cast("string")
    me, post = F.concat(F.lit("candidate:"), user), F.concat(F.lit("job:"), job)
    score = F.round("score", 4)
    matched, missing = F.col("matched_skills"), head(F.col("missing_skills"), max_missing)
    live, at, kind = F.col("live_city").cast("string"), F.col("job_city").cast("string"), F.col("job_job_type")
    wanted_cities, wanted_types = F.col("desired_cities").cast("array<string>"), F.col("desired_types")

    def context(*parts: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.concat(*parts), lambda v: v.isNotNull() & (v != ""))))

    cities = context(F.array(live, at), wanted_cities)
    types = context(F.array(kind), wanted_types)

    def skill(s: Column) -> Column:
        return F.concat(F.lit("skill:"), s)

    nodes = F.concat(
        F.array(
            _node(me, "Candidate", user, "query_candidate", attributes(
                live_city=live, desired_cities=F.concat_ws(",", wanted_cities), desired_types=F.concat_ws(",", wanted_types),
                degree_rank=F.col("degree_rank"), years=F.col("years"))),
            _node(post, "Job", F.col("job_title"), "recommended_job", attributes(
                job_id=job, score=score, city=at, job_type=kind, min_degree_rank=F.col("job_min_degree_rank"),
                min_years=F.col("job_min_years"))),
        ),
        F.transform(matched, lambda s: _node(skill(s["skill"]), "Skill", s["skill"], "matched_skill", attributes(attention=s["weight"]))),
        F.transform(missing, lambda s: _node(skill(s), "Skill", s, "missing_required_skill", attributes(attention=F.lit(None)))),
        F.transform(cities, lambda c: _node(F.concat(F.lit("city:"), c), "City", c, "context_city", attributes(attention=F.lit(None)))),
        F.transform(types, lambda t: _node(F.concat(F.lit("job_type:"), t), "JobType", t, "context_job_type", attributes(attention=F.lit(None)))),
    )

    def links(values: Column, prefix: str, source: Column, relation: str, holds) -> Column:
        return F.transform(F.filter(values, holds), lambda v: _edge(source, F.concat(F.lit(prefix), v), relation))

    def both(s: Column) -> Column:
        attrs = attributes(attention=s["weight"], status=F.lit("matched"))
        return F.array(_edge(me, skill(s["skill"]), "HAS_SKILL", attrs), _edge(post, skill(s["skill"]), "REQUIRES_SKILL", attrs))

    edges = F.concat(
        F.array(_edge(me, post, "MATCHED_TO", attributes(score=score))),
        F.flatten(F.transform(matched, both)),
        F.transform(missing, lambda s: _edge(post, skill(s), "REQUIRES_SKILL", attributes(status=F.lit("missing_for_candidate")))),
        links(cities, "city:", me, "LIVES_IN", lambda c: c == live),
        links(cities, "city:", me, "DESIRES_CITY", lambda c: F.array_contains(wanted_cities, c)),
        links(cities, "city:", post, "LOCATED_IN", lambda c: c == at),
        links(types, "job_type:", me, "DESIRES_TYPE", lambda t: F.array_contains(wanted_types, t)),
        links(types, "job_type:", post, "OF_TYPE", lambda t: t == kind),
    )
    structured = F.transform(
        matched,
        lambda s: F.struct(
            F.array(me, skill(s["skill"]), post).alias("nodes"),
            F.array(F.lit("HAS_SKILL"), F.lit("REQUIRES_SKILL")).alias("relations"),
            F.lit("matched_skill_attention").alias("support"),
            s["weight"].alias("weight"),
        ),
    )
    focus = F.struct(user.alias("candidate_id"), job.alias("job_id"), F.col("job_title"), score.alias("score"))
    return evidence.withColumn(
        "local_subgraph",
        F.struct(
            F.lit(SCHEMA_VERSION).alias("schema_version"), focus.alias("focus_pair"), nodes.alias("nodes"), edges.alias("edges"),
            F.col("graph_paths"), structured.alias("structured_paths"), F.col("reasons").alias("reason_evidence"),
        ),
    )


def allowed_terms() -> Column:
    """Skills an explanation of the pair may name."""
    return F.array_union(F.col("matched_skills.skill"), F.col("missing_skills"))


def template_text(max_matched: int | None = None, max_reasons: int | None = None, max_missing: int | None = None) -> Column:
    """Deterministic explanation of the pair; each list can be shortened for display."""
    top = F.array_join(head(F.col("matched_skills.skill"), max_matched), "、")
    return F.concat(
        F.lit("推荐岗位「"), F.col("job_title"), F.lit("」:你的技能 "),
        F.coalesce(F.nullif(top, F.lit("")), F.lit("(无直接技能重叠)")), F.lit(" 与该岗位要求匹配。"),
        F.when(F.size("reasons") > 0, F.concat(F.lit("匹配依据:"), F.array_join(head(F.col("reasons"), max_reasons), ";"), F.lit("。"))).otherwise(""),
        F.when(F.size("missing_skills") > 0,
               F.concat(F.lit("建议补充技能:"), F.array_join(head(F.col("missing_skills"), max_missing), "、"), F.lit("。"))).otherwise(""),
    )


def html_fragment(text: Column) -> Column:
    """Escaped paragraphs, one per non-blank line."""
    lines = F.filter(F.transform(F.split(text, r"(?:\r?\n)+"), strip), lambda p: p != "")
    body = F.array_join(F.transform(lines, lambda p: F.concat(F.lit("<p>"), escape_html(p), F.lit("</p>"))), "")
    return F.concat(F.lit('<div class="llm-explanation">'), body, F.lit("</div>"))


def audit_texts(evidence: DataFrame, texts: DataFrame, skills: DataFrame) -> DataFrame:
    """Add ``given_text`` and ``faithful`` to the pairs that have a supplied text.

    A text is unfaithful when it names a Latin-script term of the whole vocabulary that is neither
    allowed for the pair nor its job title. Terms meet the vocabulary by equality, one row each.
    """
    given = evidence.join(texts.select("user_id", "job_id", F.col("text").alias("given_text")), ["user_id", "job_id"])
    lower_allowed = F.transform(allowed_terms(), F.lower)
    mentioned = F.array_distinct(F.transform(F.regexp_extract_all("given_text", F.lit(SKILL_TERM), F.lit(1)), F.lower))
    stray = F.filter(F.array_except(mentioned, lower_allowed), lambda t: t != F.lower("job_title"))
    known = skills.where(F.col("skill").rlike(ASCII_VOCABULARY)).select(F.lower("skill").alias("_term")).distinct()
    offending = (
        given.select("user_id", "job_id", F.explode(stray).alias("_term"))
        .join(broadcast_if_small(known), "_term", "left_semi")
        .select("user_id", "job_id").distinct().withColumn("_bad", F.lit(True))
    )
    return given.join(offending, ["user_id", "job_id"], "left").withColumn("faithful", F.col("_bad").isNull()).drop("_bad")


def grounded_explanations(evidence: DataFrame, texts: DataFrame | None, skills: DataFrame) -> DataFrame:
    """Final text with its provenance: a faithful supplied text, else the template.

    A rejected text is kept beside the template for inspection.
    """
    template = template_text()
    if texts is None:
        judged = evidence.withColumn("_text", F.lit(None).cast("string")).withColumn("_ok", F.lit(None).cast("boolean"))
    else:
        audited = audit_texts(evidence, texts.where(F.coalesce("text", F.lit("")) != ""), skills)
        judged = evidence.join(
            audited.select("user_id", "job_id", F.col("given_text").alias("_text"), F.col("faithful").alias("_ok")), ["user_id", "job_id"], "left"
        )
    chosen = judged.withColumn("text", F.when(F.col("_ok"), F.col("_text")).otherwise(template)).withColumn(
        "source",
        F.when(F.col("_ok"), "llm").when(F.col("_text").isNotNull(), "template_fallback_unfaithful").otherwise("template"),
    )
    rejected = F.when(F.col("source") == "template_fallback_unfaithful", F.col("_text"))
    return (
        chosen.withColumn("html", html_fragment(F.col("text"))).withColumn("faithful", F.lit(True)).withColumn("rejected_text", rejected)
        .drop("_text", "_ok")
    )


def evidence_payload() -> Column:
    """The pair's evidence as JSON text."""
    return F.to_json(F.struct("job_title", "matched_skills", "missing_skills", "graph_paths", "reasons", "local_subgraph"))


def requirement_explanation(pairs: DataFrame) -> DataFrame:
    """Matched and missing skills, paths and reasons against required and preferred skills."""
    wanted = F.array_union("job_required_skills", "job_preferred_skills")
    out = pairs.withColumn("matched_skills", F.array_sort(F.array_distinct(F.array_intersect(F.col("skills"), wanted)))).withColumn(
        "missing_skills", F.array_sort(F.array_except("job_required_skills", "skills"))
    )
    same_city = (F.col("expected_city") != "") & (F.col("expected_city") == F.col("job_city"))
    return out.withColumn(
        "graph_paths", _paths(F.col("user_id").cast("string"), F.col("job_id").cast("string"), F.col("matched_skills"))
    ).withColumn(
        "reasons",
        _present(
            F.when(F.size("matched_skills") > 0, REASONS_REQUIREMENT["skills"]),
            F.when(flag(same_city) > 0, REASONS_REQUIREMENT["city"]),
        ),
    )
