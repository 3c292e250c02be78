"""SQL that the matching queries must agree with."""

from __future__ import annotations

BASE = """
ev AS (
  SELECT event_id AS row_index, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id,
         CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS level
  FROM events),
lv AS (SELECT user_id, job_id, level, row_index FROM ev WHERE level > 0 AND user_id IS NOT NULL AND job_id IS NOT NULL),
known AS (SELECT * FROM lv WHERE user_id IN (SELECT c_custkey FROM customer) AND job_id IN (SELECT p_partkey FROM part)),
pos2 AS (SELECT row_index, row_number() OVER (PARTITION BY user_id ORDER BY row_index DESC) AS back,
                count(*) OVER (PARTITION BY user_id) AS n FROM known WHERE level >= 2),
sp AS (SELECT k.*, CASE WHEN p.back = 1 AND p.n >= 2 THEN 'test' WHEN p.back = 2 AND p.n >= 3 THEN 'valid' ELSE 'train' END AS split
       FROM known k LEFT JOIN pos2 p ON k.row_index = p.row_index),
pos1 AS (SELECT row_index, row_number() OVER (PARTITION BY user_id ORDER BY row_index DESC) AS back,
                count(*) OVER (PARTITION BY user_id) AS n FROM known),
sp1 AS (SELECT k.*, CASE WHEN p.back = 1 AND p.n >= 2 THEN 'test' WHEN p.back = 2 AND p.n >= 3 THEN 'valid' ELSE 'train' END AS split
        FROM known k LEFT JOIN pos1 p ON k.row_index = p.row_index),
train AS (SELECT DISTINCT user_id, job_id FROM sp WHERE level >= 2 AND split = 'train'),
test AS (SELECT DISTINCT user_id, job_id FROM sp WHERE level >= 2 AND split = 'test'),
hidden AS (SELECT DISTINCT user_id, job_id FROM sp WHERE level >= 2 AND split IN ('train', 'valid')),
seen AS (SELECT DISTINCT user_id, job_id FROM sp WHERE level >= 1),
askers AS (SELECT DISTINCT user_id FROM test),
alljobs AS (
  SELECT p_partkey AS job_id, p_name AS title, CAST(p_size % 25 AS VARCHAR) AS city, lower(p_type) AS job_type,
         CAST(p_size % 9 AS INTEGER) AS min_degree_rank, CAST(p_size // 10 AS DOUBLE) AS min_years, lower(p_brand) AS brand,
         string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2
  FROM part),
jskill AS (
  SELECT job_id, skill, min(pos) AS pos FROM (
    SELECT job_id, w1 AS skill, 1 AS pos FROM alljobs UNION ALL SELECT job_id, w2, 2 FROM alljobs
    UNION ALL SELECT job_id, brand, 3 FROM alljobs UNION ALL SELECT job_id, job_type, 4 FROM alljobs)
  GROUP BY job_id, skill),
jn AS (SELECT job_id, count(*) AS n_job FROM jskill GROUP BY job_id),
jobs AS (SELECT a.*, jn.n_job FROM alljobs a JOIN jn ON a.job_id = jn.job_id WHERE a.job_id IN (SELECT job_id FROM lv)),
views AS (SELECT DISTINCT user_id, job_id FROM lv WHERE level = 1),
uskill AS (SELECT v.user_id, s.skill FROM views v JOIN jskill s ON v.job_id = s.job_id GROUP BY v.user_id, s.skill HAVING count(*) >= 2),
utype AS (SELECT v.user_id, a.job_type FROM views v JOIN alljobs a ON v.job_id = a.job_id GROUP BY v.user_id, a.job_type HAVING count(*) >= 2),
users AS (
  SELECT c_custkey AS user_id, CAST(c_nationkey AS VARCHAR) AS live_city, CAST((c_nationkey + 1) % 25 AS VARCHAR) AS next_city,
         CAST(1 + c_custkey % 8 AS INTEGER) AS degree_rank, floor(abs(c_acctbal) / 1000) AS years
  FROM customer WHERE c_custkey IN (SELECT user_id FROM lv)),
sharedn AS (SELECT u.user_id, j.job_id, count(*) AS n FROM uskill u JOIN jskill j ON u.skill = j.skill GROUP BY ALL),
pairs AS (
  SELECT u.user_id, j.job_id, coalesce(s.n, 0) AS n, j.n_job, u.degree_rank, u.years, j.min_degree_rank, j.min_years,
         CASE WHEN j.city IN (u.live_city, u.next_city) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS city,
         CASE WHEN t.user_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS type
  FROM users u CROSS JOIN jobs j
  LEFT JOIN sharedn s ON s.user_id = u.user_id AND s.job_id = j.job_id
  LEFT JOIN utype t ON t.user_id = u.user_id AND t.job_type = j.job_type),
pop AS (SELECT j.job_id, CAST(coalesce(c.n, 0) AS DOUBLE) AS score FROM jobs j
        LEFT JOIN (SELECT job_id, count(*) AS n FROM train GROUP BY job_id) c ON j.job_id = c.job_id),
poprank AS (
  SELECT a.user_id, p.job_id, p.score, row_number() OVER (PARTITION BY a.user_id ORDER BY p.score DESC, p.job_id) AS rank
  FROM askers a CROSS JOIN pop p ANTI JOIN hidden h ON h.user_id = a.user_id AND h.job_id = p.job_id),
rule2 AS (SELECT user_id, job_id, round(3.0 * n / n_job + city + 1.5 * type
            + CASE WHEN degree_rank >= min_degree_rank THEN 0.3 ELSE 0 END + CASE WHEN years >= min_years THEN 0.3 ELSE 0 END, 9) AS score
          FROM pairs),
rulerank AS (
  SELECT r.user_id, r.job_id, r.score, row_number() OVER (PARTITION BY r.user_id ORDER BY r.score DESC, r.job_id) AS rank
  FROM rule2 r SEMI JOIN askers a ON a.user_id = r.user_id ANTI JOIN hidden h ON h.user_id = r.user_id AND h.job_id = r.job_id),
feat1 AS (
  SELECT user_id, job_id, n / n_job AS cov, (n_job - n) / n_job AS miss, city,
         CASE WHEN min_degree_rank > 0 AND degree_rank >= min_degree_rank THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS edu,
         CASE WHEN min_years > 0 AND years >= min_years THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exp, type, ln(1.0 + n) AS paths
  FROM pairs),
rule1 AS (SELECT *, round(0.5 * cov + 0.1 * (1 - miss) + 0.15 * city + 0.1 * edu + 0.1 * exp + 0.05 * type + 0.03 * paths, 9) AS score FROM feat1),
test1 AS (SELECT DISTINCT user_id, job_id FROM sp1 WHERE split = 'test'),
rule1rank AS (
  SELECT r.user_id, r.job_id, r.score, row_number() OVER (PARTITION BY r.user_id ORDER BY r.score DESC, r.job_id) AS rank
  FROM rule1 r SEMI JOIN test1 a ON a.user_id = r.user_id
  ANTI JOIN (SELECT DISTINCT user_id, job_id FROM sp1 WHERE split = 'train') h ON h.user_id = r.user_id AND h.job_id = r.job_id),
vec AS (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
vnorm AS (SELECT vec_id, sqrt(sum(v * v)) AS norm FROM vec GROUP BY vec_id),
unitv AS (SELECT vec.vec_id, dim, CASE WHEN norm > 0 THEN v / norm ELSE v END AS v FROM vec JOIN vnorm ON vec.vec_id = vnorm.vec_id),
nodes AS (
  SELECT 'c:' || u.user_id AS node, dim, v FROM users u JOIN vec ON vec.vec_id = u.user_id
  UNION ALL SELECT 'j:' || j.job_id, dim, v FROM jobs j JOIN vec ON vec.vec_id = (SELECT max(vec_id) FROM embeddings) - j.job_id),
edges AS (SELECT 'c:' || user_id AS src, 'j:' || job_id AS dst, 'cj' AS relation FROM train
          UNION ALL SELECT 'j:' || job_id, 'c:' || user_id, 'jc' FROM train),
deg AS (SELECT dst AS node, count(*) AS degree FROM edges GROUP BY dst),
wedge AS (SELECT e.src, e.dst, 1.0 / sqrt(CAST(a.degree * b.degree AS DOUBLE)) AS norm FROM edges e JOIN deg a ON e.src = a.node JOIN deg b ON e.dst = b.node),
l1 AS (SELECT dst AS node, dim, sum(v * norm) AS v FROM wedge JOIN nodes ON wedge.src = nodes.node GROUP BY ALL),
l2 AS (SELECT dst AS node, dim, sum(v * norm) AS v FROM wedge JOIN l1 ON wedge.src = l1.node GROUP BY ALL),
l3 AS (SELECT dst AS node, dim, sum(v * norm) AS v FROM wedge JOIN l2 ON wedge.src = l2.node GROUP BY ALL)
"""


def sql(body: str, more: str = "", recursive: bool = False) -> str:
    """A statement over the shared tables; ``more`` adds further named ones."""
    extra = f",\n{more}" if more else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE.strip()}{extra}\n{body}"


def metrics_sql(ranks: str, relevant: str, ks: tuple[int, ...], skip: bool, count_name: str) -> str:
    per_k = ", ".join(
        f"sum(CASE WHEN r.rank <= {k} THEN 1 ELSE 0 END) AS h{k}, sum(CASE WHEN r.rank <= {k} THEN 1 / log2(r.rank + 1) ELSE 0 END) AS d{k}"
        for k in ks
    )
    outs = ", ".join(
        f"avg(h{k} / n) AS recall_at_{k}, avg(h{k} / {k}) AS precision_at_{k}, "
        f"avg(d{k} / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + CAST(least(n, {k}) AS BIGINT)) t(i))) AS ndcg_at_{k}, "
        f"avg(CASE WHEN h{k} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hitrate_at_{k}"
        for k in ks
    )
    only = f"WHERE w.user_id IN (SELECT user_id FROM {ranks})" if skip else ""
    names = ["mrr"] + [f"{m}_at_{k}" for k in ks for m in ("recall", "precision", "ndcg", "hitrate")]
    shown = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    return sql(
        f"SELECT {shown}, {count_name} FROM (SELECT avg(coalesce(1 / first, 0)) AS mrr, {outs}, CAST(count(*) AS DOUBLE) AS {count_name} FROM peruser)",
        f"peruser AS (SELECT w.user_id, count(*) AS n, min(r.rank) AS first, {per_k} FROM {relevant} w "
        f"LEFT JOIN {ranks} r ON r.user_id = w.user_id AND r.job_id = w.job_id {only} GROUP BY w.user_id)",
    )


def ndcg_sql(model: str, ranks: str, k: int) -> str:
    """Per-user NDCG; every user of the test split has one relevant job."""
    return (
        f"SELECT '{model}' AS model, w.user_id, coalesce(CASE WHEN r.rank <= {k} THEN 1 / log2(r.rank + 1) END, 0.0) AS ndcg "
        f"FROM test w LEFT JOIN {ranks} r ON r.user_id = w.user_id AND r.job_id = w.job_id"
    )


RANKED = "SELECT user_id, job_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM {} WHERE rank <= {}"
TWO = f"nd AS ({ndcg_sql('popularity', 'poprank', 50)} UNION ALL {ndcg_sql('rule', 'rulerank', 50)})"
ALL_PAIRS = "(SELECT DISTINCT user_id, job_id FROM lv) k JOIN {} f ON f.user_id = k.user_id AND f.job_id = k.job_id"

CODES = """
codes AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS code FROM (
  SELECT 'city' AS kind, live_city AS value FROM users UNION SELECT 'city', city FROM jobs UNION SELECT 'type', job_type FROM jobs
  UNION SELECT 'type', min(job_type) FROM utype GROUP BY user_id))"""

SQL: dict[str, str] = {
    "behaviour_levels": sql("SELECT user_id, job_id, CAST(level AS INTEGER) AS level, row_index FROM lv"),
    "leave_last_out": sql("SELECT user_id, job_id, CAST(level AS INTEGER) AS level, row_index, split FROM sp"),
    "leave_last_out_v1": sql("SELECT user_id, job_id, CAST(level AS INTEGER) AS level, row_index, split FROM sp1"),
    "time_split": """
WITH o AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events),
c AS (SELECT *, CAST(floor(n * (1 - 0.2)) AS BIGINT) AS ts FROM o)
SELECT event_id, CASE WHEN p >= ts THEN 'test' WHEN p >= CAST(floor(ts * (1 - 0.1)) AS BIGINT) THEN 'valid' ELSE 'train' END AS split FROM c""",
    "split_overlap": sql("SELECT user_id, job_id FROM train INTERSECT SELECT user_id, job_id FROM test"),
    "positive_sets": sql("SELECT user_id, split, count(DISTINCT job_id) AS jobs FROM sp WHERE level >= 2 GROUP BY ALL"),
    "seen_pairs": sql("SELECT user_id, job_id FROM seen"),
    "dataset_stats": sql("""
SELECT 'candidate_count' AS item, CAST(count(*) AS DOUBLE) AS value FROM users
UNION ALL SELECT 'job_count', count(*) FROM jobs UNION ALL SELECT 'interaction_count', count(*) FROM sp1
UNION ALL SELECT 'positive_interaction_count', count(*) FROM sp1 WHERE level >= 1
UNION ALL SELECT s || '_positive_count', (SELECT count(*) FROM (SELECT DISTINCT user_id, job_id FROM sp1 WHERE split = s)) FROM (VALUES ('train'), ('valid'), ('test')) t(s)"""),
    "pair_levels": sql("""
SELECT t.user_id, t.job_id, CAST(coalesce(l.level, 2) AS INTEGER) AS level FROM train t
LEFT JOIN (SELECT user_id, job_id, arg_max(level, row_index) AS level FROM sp WHERE level >= 2 AND split = 'train' GROUP BY ALL) l
ON l.user_id = t.user_id AND l.job_id = t.job_id"""),
    "catalogue": sql("""
SELECT j.job_id, title, city, job_type, min_degree_rank, min_years, s.skills FROM jobs j
JOIN (SELECT job_id, string_agg(skill, '|' ORDER BY pos) AS skills FROM jskill GROUP BY job_id) s ON s.job_id = j.job_id"""),
    "profiles": sql("""
SELECT u.user_id, live_city, coalesce(t.types, '') AS types, degree_rank, years, coalesce(s.skills, '') AS skills FROM users u
LEFT JOIN (SELECT user_id, string_agg(skill, '|' ORDER BY skill) AS skills FROM uskill GROUP BY user_id) s ON s.user_id = u.user_id
LEFT JOIN (SELECT user_id, string_agg(job_type, '|' ORDER BY job_type) AS types FROM utype GROUP BY user_id) t ON t.user_id = u.user_id"""),
    "users_in_actions": sql("""
SELECT CAST(c_custkey AS VARCHAR) AS user_id, n_name AS live_city_id, c_custkey AS row_index
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT user_id FROM lv)"""),
    "jobs_for_actions": sql("""
SELECT CAST(job_id AS VARCHAR) AS jd_no, title AS jd_title, job_id AS row_index FROM alljobs WHERE job_id IN (SELECT job_id FROM lv)"""),
    "last_action_per_pair": sql("""
SELECT user_id, job_id, CAST(arg_max(level, row_index) AS INTEGER) AS level, max(row_index) AS row_index FROM lv GROUP BY user_id, job_id"""),
    "systematic_sample": sql("""
SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS p, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id FROM sp WHERE level >= 2 AND split = 'valid')) WHERE p % greatest(1, n // 50) = 0"""),
    "dense_user_index": sql("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS position FROM (SELECT DISTINCT user_id FROM lv)"),
    "popularity_counts": sql("SELECT job_id, score FROM pop"),
    "popularity_ranking": sql(RANKED.format("poprank", 1000)),
    "rule_ranking": sql(RANKED.format("rulerank", 1000)),
    "rule_ranking_top_10": sql(RANKED.format("rulerank", 10)),
    "rule_ranking_weighted": sql(RANKED.format("""(
  SELECT r.user_id, r.job_id, r.score, row_number() OVER (PARTITION BY r.user_id ORDER BY r.score DESC, r.job_id) AS rank
  FROM (SELECT user_id, job_id, round(3.0 * n / n_job + 2.0 * city + 1.5 * type + CASE WHEN degree_rank >= min_degree_rank THEN 0.3 ELSE 0 END, 9) AS score FROM pairs) r
  SEMI JOIN askers a ON a.user_id = r.user_id ANTI JOIN hidden h ON h.user_id = r.user_id AND h.job_id = r.job_id)""", 1000)),
    "rule_ranking_v1": sql(RANKED.format("rule1rank", 1000)),
    "popularity_report": metrics_sql("poprank", "test", (10, 50), True, "eval_users"),
    "rule_report": metrics_sql("rulerank", "test", (10, 50), True, "eval_users"),
    "rule_report_v1": metrics_sql("rule1rank", "test1", (10,), False, "user_count"),
    "user_ndcg": sql(f"SELECT model, 42 AS seed, user_id, round(ndcg, 6) AS ndcg FROM ({ndcg_sql('popularity', 'poprank', 10)})"),
    "paired_t_test": sql("""
SELECT count(*) AS users, round(avg(a.ndcg - b.ndcg), 6) AS mean_diff, round(avg(a.ndcg - b.ndcg) / (stddev_samp(a.ndcg - b.ndcg) / sqrt(count(*))), 6) AS t
FROM nd a JOIN nd b ON a.user_id = b.user_id WHERE a.model = 'rule' AND b.model = 'popularity'""", TWO),
    "model_comparison": sql("""
SELECT model, 1::BIGINT AS n_seeds, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall_at_10,
  round(avg(CASE WHEN rank <= 10 THEN 0.1 ELSE 0.0 END), 6) AS precision_at_10,
  round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg_at_10,
  round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hitrate_at_10, CAST(count(*) AS DOUBLE) AS eval_users
FROM found GROUP BY model""", """found AS (
  SELECT 'popularity' AS model, w.user_id, r.rank FROM test w LEFT JOIN poprank r ON r.user_id = w.user_id AND r.job_id = w.job_id
  UNION ALL SELECT 'rule', w.user_id, r.rank FROM test w LEFT JOIN rulerank r ON r.user_id = w.user_id AND r.job_id = w.job_id)"""),
    "seed_deviation": sql("""
SELECT model, count(*) AS n_seeds, round(avg(ndcg), 6) AS ndcg, round(stddev_pop(ndcg), 6) AS ndcg_std FROM nd GROUP BY model""", TWO),
    "prediction_sample": sql("""
SELECT user_id, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY rank) AS job_ids FROM poprank
WHERE rank <= 10 AND user_id IN (SELECT user_id FROM askers ORDER BY user_id LIMIT 5) GROUP BY user_id"""),
    "two_stage_rule": sql("""
SELECT p.user_id, p.job_id, round(r.score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY p.user_id ORDER BY r.score DESC, p.job_id) AS INTEGER) AS rank
FROM poprank p JOIN rule2 r ON r.user_id = p.user_id AND r.job_id = p.job_id WHERE p.rank <= 20
UNION ALL SELECT user_id, job_id, round(score, 6), CAST(rank AS INTEGER) FROM poprank WHERE rank > 20 AND rank <= 1000"""),
    "full_ranking": sql("""
SELECT user_id, job_id, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS INTEGER) AS rank
FROM (SELECT user_id, job_id, CAST(sum(level) AS DOUBLE) AS score FROM lv GROUP BY ALL)"""),
    "masked_pairs": sql("""
SELECT s.user_id, s.job_id, s.score FROM (SELECT user_id, job_id, CAST(sum(level) AS DOUBLE) AS score FROM sp GROUP BY ALL) s
ANTI JOIN train t ON t.user_id = s.user_id AND t.job_id = s.job_id"""),
    "pair_features_v1": sql(f"""
SELECT f.user_id, f.job_id, round(cov, 6) AS required_skill_coverage, round(miss, 6) AS missing_skill_ratio, city AS city_match,
  edu AS education_match, exp AS experience_match, type AS job_type_match, round(paths, 6) AS skill_path_count_log1p, round(score, 6) AS score
FROM {ALL_PAIRS.format('rule1')}"""),
    "pair_features_v2": sql(f"""
SELECT f.user_id, f.job_id, round(n / n_job, 6) AS coverage, round((n_job - n) / n_job, 6) AS missing, city,
  CASE WHEN degree_rank >= min_degree_rank THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS degree, CASE WHEN years >= min_years THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS experience,
  type, round(ln(1.0 + n), 6) AS paths, coalesce(l.path_skills, '') AS path_skills, coalesce(l.gap_skills, '') AS gap_skills
FROM {ALL_PAIRS.format('pairs')}
LEFT JOIN (SELECT k.user_id, k.job_id, string_agg(s.skill, '|' ORDER BY s.pos) FILTER (u.skill IS NOT NULL) AS path_skills,
    string_agg(s.skill, '|' ORDER BY s.pos) FILTER (u.skill IS NULL) AS gap_skills
  FROM (SELECT DISTINCT user_id, job_id FROM lv) k JOIN jskill s ON s.job_id = k.job_id
  LEFT JOIN uskill u ON u.user_id = k.user_id AND u.skill = s.skill GROUP BY ALL) l ON l.user_id = f.user_id AND l.job_id = f.job_id"""),
    "shared_skill_counts": sql(f"SELECT f.user_id, f.job_id, CAST(n AS INTEGER) AS shared, CAST(n_job - n AS INTEGER) AS missing FROM {ALL_PAIRS.format('pairs')}"),
    "skill_frequency": sql("""
SELECT 'user' AS side, skill, count(*) AS frequency FROM uskill GROUP BY skill
UNION ALL SELECT 'job', skill, count(*) FROM jskill GROUP BY skill"""),
    "skill_entries": sql("SELECT job_id, skill, 1.0::DOUBLE AS weight FROM jskill"),
    "requirement_scores": sql(f"""
SELECT *, round(0.5 * (0.8 * rq + 0.2 * pf) + 0.2 * education_match + 0.2 * experience_match + 0.1 * city_match, 6) AS score FROM (
SELECT f.user_id, f.job_id, rq AS required_skill_coverage, pf AS preferred_skill_coverage,
  CASE WHEN j.city = u.live_city THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS city_match,
  CASE WHEN u.degree_rank = j.min_degree_rank THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS education_match,
  CASE WHEN u.years >= j.min_years THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS experience_match, rq, pf
FROM {ALL_PAIRS.format('wanted')} JOIN users u ON u.user_id = f.user_id JOIN jobs j ON j.job_id = f.job_id)""".replace("SELECT *,", "SELECT user_id, job_id, round(rq, 6) AS required_skill_coverage, round(pf, 6) AS preferred_skill_coverage, city_match, education_match, experience_match,", 1), """
wanted AS (
  SELECT k.user_id, k.job_id, avg(CASE WHEN u.skill IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (s.kind = 'r') AS rq,
    avg(CASE WHEN u.skill IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (s.kind = 'p') AS pf
  FROM (SELECT DISTINCT user_id, job_id FROM lv) k
  JOIN (SELECT job_id, w1 AS skill, 'r' AS kind FROM alljobs UNION SELECT job_id, w2, 'r' FROM alljobs
        UNION SELECT job_id, brand, 'p' FROM alljobs UNION SELECT job_id, job_type, 'p' FROM alljobs) s ON s.job_id = k.job_id
  LEFT JOIN uskill u ON u.user_id = k.user_id AND u.skill = s.skill GROUP BY ALL)"""),
    "requirement_paths": sql("""
SELECT k.user_id, k.job_id, CAST(count(DISTINCT s.skill) FILTER (u.skill IS NOT NULL AND s.kind = 'r') AS DOUBLE) AS shared_required_skill_count,
  CAST(count(DISTINCT s.skill) FILTER (u.skill IS NOT NULL AND s.kind = 'p') AS DOUBLE) AS shared_preferred_skill_count,
  CAST(count(DISTINCT s.skill) FILTER (u.skill IS NULL AND s.kind = 'r') AS DOUBLE) AS missing_required_skill_count,
  CAST(count(DISTINCT s.skill) FILTER (u.skill IS NOT NULL) AS DOUBLE) AS skill_path_count
FROM (SELECT DISTINCT user_id, job_id FROM lv) k
JOIN (SELECT job_id, w1 AS skill, 'r' AS kind FROM alljobs UNION SELECT job_id, w2, 'r' FROM alljobs
      UNION SELECT job_id, brand, 'p' FROM alljobs UNION SELECT job_id, job_type, 'p' FROM alljobs) s ON s.job_id = k.job_id
LEFT JOIN uskill u ON u.user_id = k.user_id AND u.skill = s.skill GROUP BY ALL"""),
    "skill_aliases": sql("""
SELECT job_id, string_agg(CASE WHEN skill IN (SELECT lower(p_type) FROM part) THEN 'kind-' || skill ELSE skill END, '|' ORDER BY pos) AS skills
FROM jskill GROUP BY job_id"""),
    "semantic_negatives": sql("""
SELECT user_id, job_id, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS INTEGER) AS rank
FROM near n ANTI JOIN seen s ON s.user_id = n.user_id AND s.job_id = n.job_id
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) <= 200""", """
near AS (SELECT user_id, job_id, score FROM (
  SELECT a.user_id, j.job_id, round(sum(x.v * y.v), 9) AS score FROM (SELECT DISTINCT user_id FROM train) a
  JOIN unitv x ON x.vec_id = a.user_id CROSS JOIN jobs j
  JOIN unitv y ON y.vec_id = (SELECT max(vec_id) FROM embeddings) - j.job_id AND y.dim = x.dim GROUP BY ALL))"""),
    "dense_ranking": sql("SELECT user_id, job_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 50", """
near AS (SELECT user_id, job_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS rank FROM (
  SELECT x.vec_id AS user_id, y.vec_id AS job_id, round(sum(x.v * y.v), 9) AS score
  FROM unitv x JOIN unitv y ON x.dim = y.dim AND x.vec_id <> y.vec_id GROUP BY ALL))"""),
    "dense_ranking_by_groups": sql("SELECT user_id, job_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 10", """
near AS (SELECT user_id, job_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS rank FROM (
  SELECT x.vec_id AS user_id, y.vec_id AS job_id, round(sum(x.v * y.v), 9) AS score
  FROM unitv x JOIN unitv y ON x.dim = y.dim AND x.vec_id <> y.vec_id GROUP BY ALL))"""),
    "node_degree": sql("SELECT node, degree FROM deg"),
    "propagated_vectors": sql("""
SELECT n.node, CAST(n.dim AS INTEGER) AS dim, round((n.v + coalesce(l1.v, 0) + coalesce(l2.v, 0) + coalesce(l3.v, 0)) / 4, 6) + 0.0 AS value FROM nodes n
LEFT JOIN l1 ON l1.node = n.node AND l1.dim = n.dim LEFT JOIN l2 ON l2.node = n.node AND l2.dim = n.dim
LEFT JOIN l3 ON l3.node = n.node AND l3.dim = n.dim"""),
    "relation_means": sql("SELECT relation, dst, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS value FROM edges JOIN nodes ON edges.src = nodes.node GROUP BY relation, dst, dim"),
    "relational_encoding": sql("SELECT node, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS value FROM h2", """
m1 AS (SELECT dst, dim, avg(v) AS v FROM edges JOIN nodes ON edges.src = nodes.node GROUP BY ALL),
p1 AS (SELECT n.node, n.dim, n.v + coalesce(0.5 * m.v * (1 + tanh(sqrt(2 / pi()) * (m.v + 0.044715 * m.v ** 3))), 0) AS v FROM nodes n LEFT JOIN m1 m ON m.dst = n.node AND m.dim = n.dim),
h1 AS (SELECT node, dim, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS v FROM p1 WINDOW w AS (PARTITION BY node)),
m2 AS (SELECT dst, dim, avg(v) AS v FROM edges JOIN h1 ON edges.src = h1.node GROUP BY ALL),
p2 AS (SELECT n.node, n.dim, n.v + coalesce(0.5 * m.v * (1 + tanh(sqrt(2 / pi()) * (m.v + 0.044715 * m.v ** 3))), 0) AS v FROM h1 n LEFT JOIN m2 m ON m.dst = n.node AND m.dim = n.dim),
h2 AS (SELECT node, dim, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS v FROM p2 WINDOW w AS (PARTITION BY node))"""),
    "learned_path_attention": sql("""
SELECT t.user_id, t.job_id, CAST(count(p.skill) AS INTEGER) AS skills, CASE WHEN count(p.skill) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS total
FROM test t JOIN users u ON u.user_id = t.user_id JOIN jobs j ON j.job_id = t.job_id
LEFT JOIN (SELECT k.user_id, s.job_id, s.skill FROM uskill k JOIN jskill s ON s.skill = k.skill
           JOIN (SELECT skill, row_number() OVER (ORDER BY skill) - 1 AS vec_id FROM (SELECT DISTINCT skill FROM jskill)) n ON n.skill = s.skill
           WHERE n.vec_id IN (SELECT vec_id FROM embeddings)) p ON p.user_id = t.user_id AND p.job_id = t.job_id GROUP BY ALL"""),
    "neighbour_recall": """
SELECT count(*) AS queries, count(*) * least(10, (SELECT count(*) - 1 FROM embeddings)) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 100 = 0""",
    "relation_gram_sums": sql("""
SELECT x.relation, CAST(x.dim AS INTEGER) AS place, CAST(e.dim AS INTEGER) AS entry, round(sum(x.v * e.v), 6) + 0.0 AS value
FROM xs x JOIN es e ON e.relation = x.relation AND e.dst = x.dst GROUP BY ALL""", """
ms AS (SELECT relation, dst, dim, avg(v) AS v FROM edges JOIN nodes ON edges.src = nodes.node WHERE dst IN (SELECT node FROM nodes) GROUP BY ALL),
xs AS (SELECT relation, dst, dim, v FROM ms UNION ALL SELECT DISTINCT relation, dst, 64, 1.0::DOUBLE FROM ms),
es AS (SELECT * FROM xs UNION ALL SELECT m.relation, m.dst, 65 + n.dim, n.v FROM (SELECT DISTINCT relation, dst FROM ms) m JOIN nodes n ON n.node = m.dst)"""),
    "graph_dot_ranking": sql("""
SELECT r.user_id, r.job_id, round(r.score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY r.user_id ORDER BY r.score DESC, r.job_id) AS INTEGER) AS rank FROM (
  SELECT a.user_id, j.job_id, round(sum(x.v * y.v), 9) AS score FROM askers a JOIN smooth x ON x.node = 'c:' || a.user_id CROSS JOIN jobs j
  JOIN smooth y ON y.node = 'j:' || j.job_id AND y.dim = x.dim GROUP BY ALL) r
ANTI JOIN hidden h ON h.user_id = r.user_id AND h.job_id = r.job_id
QUALIFY row_number() OVER (PARTITION BY r.user_id ORDER BY r.score DESC, r.job_id) <= 100""", """
smooth AS (SELECT n.node, n.dim, (n.v + coalesce(l1.v, 0) + coalesce(l2.v, 0)) / 3 AS v FROM nodes n
  LEFT JOIN l1 ON l1.node = n.node AND l1.dim = n.dim LEFT JOIN l2 ON l2.node = n.node AND l2.dim = n.dim)"""),
    "interaction_vectors": sql("""
SELECT user_id, job_id, CAST(dim + part * 64 AS INTEGER) AS dim, round(CASE part WHEN 0 THEN u WHEN 1 THEN j WHEN 2 THEN abs(u - j) ELSE u * j END, 6) + 0.0 AS value
FROM (SELECT t.user_id, t.job_id, x.dim, x.v AS u, y.v AS j FROM train t JOIN nodes x ON x.node = 'c:' || t.user_id
      JOIN nodes y ON y.node = 'j:' || t.job_id AND y.dim = x.dim) CROSS JOIN range(4) p(part)"""),
    "node_inputs": sql("""
SELECT 'user' AS side, u.user_id AS id, CAST(coalesce(c.code, 0) AS INTEGER) AS city_code, CAST(coalesce(t.code, 0) AS INTEGER) AS type_code,
  round(degree_rank / 8, 6) AS degree, round(ln(1 + years) / 4, 6) AS years, round(n.v, 6) + 0.0 AS first
FROM users u LEFT JOIN (SELECT user_id, min(job_type) AS job_type FROM utype GROUP BY user_id) f ON f.user_id = u.user_id
LEFT JOIN codes c ON c.kind = 'city' AND c.value = u.live_city LEFT JOIN codes t ON t.kind = 'type' AND t.value = f.job_type
LEFT JOIN nodes n ON n.node = 'c:' || u.user_id AND n.dim = 0
UNION ALL
SELECT 'job', j.job_id, CAST(coalesce(c.code, 0) AS INTEGER), CAST(coalesce(t.code, 0) AS INTEGER), round(min_degree_rank / 8, 6), round(ln(1 + min_years) / 4, 6), round(n.v, 6)
FROM jobs j LEFT JOIN codes c ON c.kind = 'city' AND c.value = j.city LEFT JOIN codes t ON t.kind = 'type' AND t.value = j.job_type
LEFT JOIN nodes n ON n.node = 'j:' || j.job_id AND n.dim = 0""", CODES),
}

_LABEL_KS = (10, 50)
SQL["dense_label_report"] = sql(
    "SELECT "
    + ", ".join(
        ["round(avg(coalesce(1 / first, 0)), 6) AS mrr"]
        + [
            f"round(avg(h{k} / n), 6) AS recall_at_{k}, round(avg(h{k} / {k}), 6) AS precision_at_{k}, "
            f"round(avg(d{k} / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + CAST(least(n, {k}) AS BIGINT)) t(i))), 6) AS ndcg_at_{k}, "
            f"round(avg(CASE WHEN h{k} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hitrate_at_{k}"
            for k in _LABEL_KS
        ]
    )
    + ", CAST(count(*) AS DOUBLE) AS eval_users FROM peruser",
    """
near AS (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS rank FROM (
  SELECT x.vec_id AS user_id, y.vec_id AS job_id, round(sum(x.v * y.v), 9) AS score
  FROM unitv x JOIN unitv y ON x.dim = y.dim AND x.vec_id <> y.vec_id GROUP BY ALL)),
hits AS (SELECT n.user_id, n.rank FROM near n JOIN embeddings a ON a.vec_id = n.user_id JOIN embeddings b ON b.vec_id = n.job_id WHERE n.rank <= 50 AND a.label = b.label),
peruser AS (SELECT e.vec_id, s.n, min(h.rank) AS first, """
    + ", ".join(
        f"count(*) FILTER (h.rank <= {k}) AS h{k}, coalesce(sum(1 / log2(h.rank + 1)) FILTER (h.rank <= {k}), 0) AS d{k}" for k in _LABEL_KS
    )
    + """ FROM embeddings e JOIN (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label) s ON s.label = e.label
  LEFT JOIN hits h ON h.user_id = e.vec_id GROUP BY ALL)""",
)


# Seeded samples: a number is drawn from the first 15 hex digits of an MD5 sum of the keys and the seed

def _drawn(*keys: str, seed: int) -> str:
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(keys) + f", {seed})), 1, 15) AS BIGINT)"


_KNOWN = "kn AS (SELECT DISTINCT user_id, job_id FROM sp WHERE level >= 2)"


def _uniform(pairs: str, per_pair: int, seed: int) -> str:
    """Named tables up to ``uniform(user_id, job_id, draw, negative_id)``; ``pairs`` holds (user_id, job_id)."""
    return f"""
{_KNOWN},
cat AS (SELECT job_id, row_number() OVER (ORDER BY {_drawn('job_id', seed=seed)}, job_id) - 1 AS place, count(*) OVER () AS n FROM jobs),
asks AS ({pairs}),
runs AS (SELECT w.user_id, least((SELECT max(n) FROM cat), w.wanted + coalesce(k.known, 0)) AS length
  FROM (SELECT user_id, count(*) * {per_pair} AS wanted FROM asks GROUP BY user_id) w
  LEFT JOIN (SELECT user_id, count(*) AS known FROM kn GROUP BY user_id) k ON k.user_id = w.user_id),
steps AS (SELECT user_id, unnest(range(length)) AS step FROM runs),
free AS (SELECT s.user_id, s.step, c.job_id FROM steps s
  JOIN cat c ON c.place = ({_drawn('s.user_id', seed=seed)} % c.n + s.step) % c.n
  ANTI JOIN kn k ON k.user_id = s.user_id AND k.job_id = c.job_id),
pool AS (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY step) - 1 AS slot, count(*) OVER (PARTITION BY user_id) AS size FROM free),
numbered AS (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY job_id) - 1 AS pair FROM asks),
uniform AS (SELECT p.user_id, p.job_id, CAST(d.draw AS INTEGER) AS draw, o.job_id AS negative_id
  FROM numbered p CROSS JOIN range({per_pair}) d(draw) JOIN pool o ON o.user_id = p.user_id AND o.slot = (p.pair * {per_pair} + d.draw) % o.size)"""


def _structural(keys: tuple[str, ...], seed: int, known: bool = True) -> str:
    """Named tables up to ``structural(user_id, job_id, negative_id)``."""
    names, same = ", ".join(keys), lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return f"""
{_KNOWN + ',' if known else ''}
placed AS (SELECT job_id, {names}, row_number() OVER (PARTITION BY {names} ORDER BY {_drawn('job_id', seed=seed)}, job_id) - 1 AS place,
  count(*) OVER (PARTITION BY {names}) AS size FROM jobs),
taken AS (SELECT k.user_id, {', '.join('p.' + k for k in keys)}, count(*) AS n FROM kn k JOIN placed p ON p.job_id = k.job_id GROUP BY ALL),
tries AS (SELECT t.user_id, t.job_id, p.size, {', '.join('p.' + k for k in keys)}, unnest(range(least(p.size, coalesce(n, 0) + 1))) AS draw
  FROM train t JOIN placed p ON p.job_id = t.job_id LEFT JOIN taken x ON x.user_id = t.user_id AND {same('x', 'p')}),
structural AS (SELECT t.user_id, t.job_id, f.negative_id FROM (SELECT DISTINCT user_id, job_id FROM tries) t LEFT JOIN (
  SELECT r.user_id, r.job_id, arg_min(m.job_id, r.draw) AS negative_id FROM tries r
  JOIN placed m ON {same('m', 'r')} AND m.place = ({_drawn('r.user_id', 'r.job_id', seed=seed)} + r.draw) % r.size
  ANTI JOIN kn k ON k.user_id = r.user_id AND k.job_id = m.job_id GROUP BY ALL) f ON f.user_id = t.user_id AND f.job_id = t.job_id)"""


SQL["uniform_negatives"] = sql("SELECT user_id, job_id, draw, negative_id FROM uniform", _uniform("SELECT user_id, job_id FROM train", 2, 7))
SQL["sampled_pool"] = sql("SELECT DISTINCT user_id, negative_id AS job_id FROM uniform", _uniform("SELECT user_id, CAST(NULL AS BIGINT) AS job_id FROM users", 10, 7))
SQL["structural_negatives"] = sql("SELECT user_id, job_id, negative_id FROM structural", _structural(("job_type",), 7))
SQL["structural_negatives_by_city"] = sql("SELECT user_id, job_id, coalesce(negative_id, -1) AS negative_id FROM structural", _structural(("job_type", "city"), 7))
SQL["mixed_negatives"] = sql(f"""
SELECT user_id, job_id, draw,
  CASE WHEN roll < 0.5 AND s IS NOT NULL THEN s WHEN roll < 0.7 AND t IS NOT NULL THEN t ELSE negative_id END AS negative_id,
  CASE WHEN roll < 0.5 AND s IS NOT NULL THEN 'semantic' WHEN roll < 0.7 AND t IS NOT NULL THEN 'structural' ELSE 'uniform' END AS source
FROM (SELECT u.user_id, u.job_id, u.draw, u.negative_id, n.job_id AS s, t.negative_id AS t,
    {_drawn('u.user_id', 'u.job_id', 'u.draw', seed=12)} % 1000000 / 1000000.0 AS roll
  FROM uniform u LEFT JOIN (SELECT user_id, max(rank) AS n FROM near GROUP BY user_id) z ON z.user_id = u.user_id
  LEFT JOIN near n ON n.user_id = u.user_id AND n.rank = {_drawn('u.user_id', 'u.job_id', 'u.draw', seed=6)} % z.n + 1
  LEFT JOIN structural t ON t.user_id = u.user_id AND t.job_id = u.job_id)""",
    _uniform("SELECT user_id, job_id FROM train", 2, 7).strip() + "," + _structural(("job_type",), 7, known=False) + """,
near AS (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS rank FROM (
  SELECT a.user_id, j.job_id, round(sum(x.v * y.v), 9) AS score FROM users a
  JOIN unitv x ON x.vec_id = a.user_id CROSS JOIN jobs j
  JOIN unitv y ON y.vec_id = (SELECT max(vec_id) FROM embeddings) - j.job_id AND y.dim = x.dim GROUP BY ALL) n
  ANTI JOIN seen s ON s.user_id = n.user_id AND s.job_id = n.job_id
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) <= 200)""")

_FACTS = sql("""
SELECT a.user_id, n.jobs - coalesce(h.hidden, 0) AS places, n.jobs - coalesce(h.hidden, 0) AS jobs, 1 AS first,
  CAST(n.jobs - coalesce(h.hidden, 0) AS INTEGER) AS last, CAST(0 AS BIGINT) AS hidden
FROM askers a CROSS JOIN (SELECT count(*) AS jobs FROM jobs) n
LEFT JOIN (SELECT user_id, count(*) AS hidden FROM hidden WHERE job_id IN (SELECT job_id FROM jobs) GROUP BY user_id) h ON h.user_id = a.user_id""")
for _name in ("als_ranking_facts", "pairwise_ranking_facts", "two_stage_ranking_facts", "pair_interaction_ranking_facts", "path_model_ranking_facts"):
    SQL[_name] = _FACTS

_PLACE = "CAST('0x' || substr(md5('{0}:' || i.{0}_code), 1, 15) AS BIGINT) % 64"
SQL["fused_encoding"] = sql("SELECT node, CAST(dim AS INTEGER) AS dim, round(v, 6) + 0.0 AS value FROM h1", CODES.strip() + f""",
inputs AS (
  SELECT 'c:' || u.user_id AS node, degree_rank / 8 AS s0, ln(1 + years) / 4 AS s1, coalesce(c.code, 0) AS city_code, coalesce(t.code, 0) AS type_code
  FROM users u LEFT JOIN (SELECT user_id, min(job_type) AS job_type FROM utype GROUP BY user_id) f ON f.user_id = u.user_id
  LEFT JOIN codes c ON c.kind = 'city' AND c.value = u.live_city LEFT JOIN codes t ON t.kind = 'type' AND t.value = f.job_type
  UNION ALL SELECT 'j:' || j.job_id, min_degree_rank / 8, ln(1 + min_years) / 4, coalesce(c.code, 0), coalesce(t.code, 0)
  FROM jobs j LEFT JOIN codes c ON c.kind = 'city' AND c.value = j.city LEFT JOIN codes t ON t.kind = 'type' AND t.value = j.job_type),
fz AS (SELECT i.node, d.dim, coalesce(n.v, 0) + CASE WHEN city_code > 0 AND {_PLACE.format('city')} = d.dim THEN 0.1 ELSE 0 END
    + CASE WHEN type_code > 0 AND {_PLACE.format('type')} = d.dim THEN 0.1 ELSE 0 END + 0.1 * CASE d.dim WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE 0 END AS v
  FROM inputs i CROSS JOIN range(64) d(dim) LEFT JOIN nodes n ON n.node = i.node AND n.dim = d.dim),
m1 AS (SELECT dst, dim, avg(v) AS v FROM edges JOIN fz ON edges.src = fz.node GROUP BY ALL),
p1 AS (SELECT n.node, n.dim, n.v + coalesce(0.5 * m.v * (1 + tanh(sqrt(2 / pi()) * (m.v + 0.044715 * m.v ** 3))), 0) AS v FROM fz n LEFT JOIN m1 m ON m.dst = n.node AND m.dim = n.dim),
h1 AS (SELECT node, dim, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS v FROM p1 WINDOW w AS (PARTITION BY node))""")
