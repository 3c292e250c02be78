"""SQL that the knowledge queries must agree with."""

from __future__ import annotations

from .matching_sql import SQL as SQL_MATCHING
from .matching_sql import sql

# Raw tables as the bindings lay them out.
RAW = """
ru AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS user_id, n_name AS live_city, 'NATION_' || (c_nationkey + 1) % 25 AS next_city, c_mktsegment AS seg,
    c_custkey % 3 AS t, [ '本科', '硕士', '', '大专'][c_custkey % 4 + 1] AS degree, '20' || lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') AS started,
    'Tier ' || CAST(floor(abs(c_acctbal) / 1000) AS BIGINT) AS tier
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
rj AS (
  SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS job_id, p_name AS title, coalesce(s_name, '') AS company, 'NATION_' || p_size % 25 AS city, p_type AS kind,
    p_brand AS brand, ['本科', '', '高中'][p_partkey % 3 + 1] AS degree, CAST(p_size % 10 AS VARCHAR) AS years,
    p_brand || '，' || p_type || '，熟练，' || p_name AS shown
  FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_partkey) x ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = sk),
uval AS (
  SELECT user_id, 'LIVES_IN_CITY' AS relation, 'city' AS type, live_city AS value, 'live_city_id' AS field FROM ru
  UNION SELECT user_id, 'DESIRES_CITY', 'city', unnest([live_city, next_city]), 'desire_jd_city_id' FROM ru
  UNION SELECT user_id, 'DESIRES_INDUSTRY', 'industry', lower(seg), 'desire_jd_industry_id' FROM ru
  UNION SELECT user_id, 'DESIRES_JOB_TYPE', 'job_type', unnest(CASE t WHEN 0 THEN ['ECONOMY', 'PROMO'] WHEN 1 THEN ['LARGE'] ELSE [] END), 'desire_jd_type_id' FROM ru
  UNION SELECT user_id, 'CURRENT_INDUSTRY', 'industry', seg, 'cur_industry_id' FROM ru
  UNION SELECT user_id, 'CURRENT_JOB_TYPE', 'job_type', 'SMALL', 'cur_jd_type' FROM ru
  UNION SELECT user_id, 'HAS_DEGREE', 'degree', degree, 'cur_degree_id' FROM ru WHERE degree <> ''),
usk AS (SELECT DISTINCT user_id, unnest([lower(seg), lower(replace(tier, ' ', '')), 'python', 'sql']) AS value FROM ru),
jval AS (
  SELECT job_id, 'LOCATED_IN_CITY' AS relation, 'city' AS type, city AS value, 'city' AS field FROM rj
  UNION SELECT job_id, 'BELONGS_TO_JOB_TYPE', 'job_type', kind, 'jd_sub_type' FROM rj
  UNION SELECT job_id, 'REQUIRES_DEGREE', 'degree', degree, 'min_edu_level' FROM rj WHERE degree <> ''),
jsk AS (SELECT DISTINCT job_id, unnest([replace(title, ' ', ''), lower(brand), lower(kind)]) AS value FROM rj),
dimv AS (SELECT type AS node_type, value FROM uval UNION SELECT type, value FROM jval UNION SELECT 'company', company FROM rj WHERE company <> ''),
skv AS (SELECT value FROM usk UNION SELECT value FROM jsk),
gedge AS (
  SELECT 'USER::' || user_id AS source_id, 'user' AS source_type, relation, upper(type) || '::' || value AS target_id, type AS target_type, 1.0::DOUBLE AS weight, 'table1_user.' || field AS evidence FROM uval
  UNION SELECT 'USER::' || user_id, 'user', 'HAS_SKILL', 'SKILL::' || value, 'skill', 1.0, 'table1_user.experience' FROM usk
  UNION SELECT 'JOB::' || job_id, 'job', relation, upper(type) || '::' || value, type, 1.0, 'table2_jd.' || field FROM jval
  UNION SELECT 'JOB::' || job_id, 'job', 'REQUIRES_SKILL', 'SKILL::' || value, 'skill', 1.0, 'table2_jd.jd_title+job_description' FROM jsk
  UNION SELECT 'USER::' || user_id, 'user', CASE event_type WHEN 'view' THEN 'BROWSED_JOB' WHEN 'click' THEN 'DELIVERED_JOB' ELSE 'SATISFIED_JOB' END,
    'JOB::' || json_extract_string(props, '$.k'), 'job', CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 5 ELSE 10 END, 'table3_action'
    FROM events WHERE event_type IN ('view', 'click', 'purchase')),
gstat AS (
  SELECT 'users' AS item, count(*) AS n FROM ru UNION ALL SELECT 'jobs', count(*) FROM rj
  UNION ALL SELECT i, (SELECT count(*) FROM dimv WHERE node_type = t) FROM (VALUES ('cities', 'city'), ('industries', 'industry'), ('job_types', 'job_type'), ('degrees', 'degree'), ('companies', 'company')) v(i, t)
  UNION ALL SELECT 'skills', count(*) FROM skv UNION ALL SELECT 'edges', count(*) FROM gedge)"""

NODES = """
SELECT 'USER::' || user_id AS node_id, 'user' AS node_type, user_id AS node_name, json_object('birthday', '', 'cur_degree_id', degree, 'cur_industry_id', seg,
  'cur_jd_type', 'SMALL', 'cur_salary_id', '', 'desire_jd_city_id', live_city || ',' || next_city, 'desire_jd_industry_id', lower(seg), 'desire_jd_salary_id', '',
  'desire_jd_type_id', CASE t WHEN 0 THEN 'ECONOMY/PROMO' WHEN 1 THEN 'LARGE' ELSE '' END, 'experience', seg || '|' || tier || '|团队|Python/SQL',
  'live_city_id', live_city, 'start_work_date', started)::VARCHAR AS attributes_json FROM ru
UNION ALL SELECT 'JOB::' || job_id, 'job', title, json_object('city', city, 'company_name', company, 'end_date', '', 'is_mangerial', '', 'is_travel', '', 'jd_sub_type', kind,
  'jd_title', title, 'job_description', shown, 'key', '', 'max_edu_level', '', 'max_salary', '', 'min_edu_level', degree, 'min_salary', '', 'min_years', years,
  'require_nums', '', 'resume_language_required', '', 'start_date', '')::VARCHAR FROM rj
UNION ALL SELECT upper(node_type) || '::' || value, node_type, value, json_object('name', value)::VARCHAR FROM dimv
UNION ALL SELECT 'SKILL::' || value, 'skill', value, json_object('name', value)::VARCHAR FROM skv"""

SPLIT_RAW = """
ract AS (SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(job_id AS VARCHAR) AS job_id, level, row_index, split FROM sp),
jobd AS (SELECT * FROM rj WHERE job_id IN (SELECT job_id FROM ract)),
tags AS (SELECT user_id, pos, tag FROM (
  SELECT user_id, 0 AS pos, lower(seg) AS tag FROM ru UNION ALL SELECT user_id, 1, lower(replace(tier, ' ', '')) FROM ru
  UNION ALL SELECT user_id, 2, '团队' FROM ru UNION ALL SELECT user_id, 3, 'python' FROM ru UNION ALL SELECT user_id, 4, 'sql' FROM ru)),
voc AS (SELECT tag AS skill, row_number() OVER (ORDER BY tag) - 1 AS skill_id FROM tags GROUP BY tag HAVING count(*) >= 2)"""

EVIDENCE = """
kp AS (SELECT user_id, job_id, CAST(sum(level) AS DOUBLE) AS score FROM lv GROUP BY ALL),
kf AS (SELECT p.*, k.score AS given FROM pairs p JOIN kp k ON k.user_id = p.user_id AND k.job_id = p.job_id),
ks AS (SELECT k.user_id, k.job_id, s.skill, s.pos, u.skill IS NOT NULL AS has FROM kp k JOIN jskill s ON s.job_id = k.job_id
       LEFT JOIN uskill u ON u.user_id = k.user_id AND u.skill = s.skill),
lg AS (SELECT s.skill, ln(((SELECT count(*) FROM jobs) + 1) / (count(*) + 1)) AS logit FROM jskill s JOIN jobs j ON j.job_id = s.job_id GROUP BY s.skill),
att AS (SELECT ks.user_id, ks.job_id, ks.skill, ks.pos, exp(logit - max(logit) OVER w) / sum(exp(logit)) OVER w * exp(max(logit) OVER w) AS weight
        FROM ks JOIN lg ON lg.skill = ks.skill WHERE has WINDOW w AS (PARTITION BY ks.user_id, ks.job_id)),
am AS (SELECT user_id, job_id, string_agg(skill, '|' ORDER BY round(weight, 12) DESC, skill) AS matched, count(*) AS n,
        array_to_string(list(skill ORDER BY round(weight, 12) DESC, skill), '、') AS top4 FROM att GROUP BY ALL),
mi AS (SELECT user_id, job_id, string_agg(skill, '|' ORDER BY pos) AS missing, string_agg(skill, '、' ORDER BY pos) AS listed FROM ks WHERE NOT has GROUP BY ALL),
ev2 AS (SELECT f.user_id, f.job_id, coalesce(am.matched, '') AS matched, coalesce(mi.missing, '') AS missing, coalesce(am.n, 0) AS n, coalesce(am.top4, '') AS top4, mi.listed,
  list_filter(['技能覆盖率 ' || CAST(round_even(100.0 * f.n / f.n_job, 0) AS INTEGER) || '%(' || f.n || '/' || f.n_job || ' 项要求技能匹配)',
   CASE WHEN f.city = 1 THEN '工作城市符合期望' END, CASE WHEN f.degree_rank >= f.min_degree_rank AND f.min_degree_rank > 0 THEN '学历满足岗位要求' END,
   CASE WHEN f.years >= f.min_years AND f.min_years > 0 THEN '工作年限满足岗位要求' END, CASE WHEN f.type = 1 THEN '岗位类型符合求职意向' END], lambda r: r IS NOT NULL) AS reasons
  FROM kf f LEFT JOIN am ON am.user_id = f.user_id AND am.job_id = f.job_id LEFT JOIN mi ON mi.user_id = f.user_id AND mi.job_id = f.job_id)"""

EXPLAINED = EVIDENCE + """,
tx AS (SELECT k.user_id, k.job_id, w1, 'Fits <you>: ' || w1 || ' & more.' || chr(10) || 'Good luck' AS given FROM kp k JOIN alljobs a ON a.job_id = k.job_id + 1),
ok AS (SELECT t.*, EXISTS (SELECT 1 FROM jskill s WHERE s.job_id = t.job_id AND s.skill = t.w1) OR t.w1 = (SELECT lower(title) FROM alljobs a WHERE a.job_id = t.job_id) AS fits FROM tx t),
exd AS (SELECT e.user_id, e.job_id, CASE WHEN o.fits THEN 'llm' WHEN o.given IS NOT NULL THEN 'template_fallback_unfaithful' ELSE 'template' END AS source,
  CASE WHEN o.fits THEN o.given ELSE '推荐岗位「' || a.title || '」:你的技能 ' || CASE WHEN e.top4 = '' THEN '(无直接技能重叠)' ELSE e.top4 END || ' 与该岗位要求匹配。'
    || '匹配依据:' || array_to_string(e.reasons, ';') || '。' || CASE WHEN e.missing = '' THEN '' ELSE '建议补充技能:' || e.listed || '。' END END AS text,
  CASE WHEN o.given IS NOT NULL AND NOT o.fits THEN o.given ELSE '' END AS rejected
  FROM ev2 e JOIN alljobs a ON a.job_id = e.job_id LEFT JOIN ok o ON o.user_id = e.user_id AND o.job_id = e.job_id)"""

REQUESTS = """
rq AS (SELECT 'r' || c_custkey AS request_id, c_custkey AS k, CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE c_custkey END AS user_id,
  ['rule', 'graph', 'bm25', 'semantic_hash', 'unknown'][c_custkey % 5 + 1] AS model, least(greatest(c_custkey % 7 * 20, 1), 100) AS top_k, c_custkey % 2 = 0 AS shown FROM customer),
good AS (SELECT * FROM rq WHERE model <> 'unknown' AND user_id IN (SELECT user_id FROM users)),
stored AS (SELECT user_id, job_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS rank FROM poprank WHERE rank <= 20 AND user_id % 2 = 0),
served AS (SELECT g.request_id, g.user_id, 'graph' AS model, s.rank, s.job_id, round(1 / s.rank, 6) AS score, g.shown, 0 AS warnings, g.top_k
  FROM good g JOIN stored s ON s.user_id = g.user_id WHERE g.model <> 'rule'),
ruled AS (SELECT g.request_id, g.user_id, 'rule' AS model, r.rank, r.job_id, r.score, g.shown, CASE WHEN g.model = 'rule' THEN 0 ELSE 1 END AS warnings, g.top_k
  FROM good g JOIN (SELECT user_id, CAST(job_id AS VARCHAR) AS job, job_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, CAST(job_id AS VARCHAR)) AS rank FROM rule1) r
  ON r.user_id = g.user_id WHERE g.request_id NOT IN (SELECT request_id FROM served)),
answered AS (SELECT * FROM served WHERE rank <= top_k UNION ALL SELECT * FROM ruled WHERE rank <= top_k)"""

SQL: dict[str, str] = {
    "graph_nodes": sql(NODES, RAW),
    "graph_edges": sql("SELECT * FROM gedge", RAW),
    "graph_stats": sql("SELECT item, n FROM gstat", RAW),
    "pruned_graph_edges": sql("""
SELECT relation, count(*) AS edges FROM gedge WHERE target_type <> 'skill' OR target_id IN (
  SELECT 'SKILL::' || value FROM usk GROUP BY value HAVING count(*) >= 100 UNION SELECT 'SKILL::' || value FROM jsk GROUP BY value HAVING count(*) >= 100)
GROUP BY relation""", RAW),
    "dimension_values": sql("SELECT node_type, value FROM dimv", RAW),
    "message_graph": sql("SELECT relation, src, dst FROM mg UNION ALL SELECT reverse(relation), dst, src FROM mg", """
mg AS (SELECT 'cs' AS relation, CAST(user_id AS VARCHAR) AS src, skill AS dst FROM uskill
  UNION ALL SELECT 'js', CAST(s.job_id AS VARCHAR), s.skill FROM jskill s JOIN jobs j ON j.job_id = s.job_id
  UNION ALL SELECT 'cj', CAST(user_id AS VARCHAR), CAST(job_id AS VARCHAR) FROM train
  UNION ALL SELECT DISTINCT 'cj', CAST(user_id AS VARCHAR), CAST(job_id AS VARCHAR) FROM sp WHERE level = 1)"""),
    "graph_export": sql(f"SELECT item, n FROM gstat UNION ALL SELECT 'node_type_' || node_type, count(*) FROM ({NODES}) GROUP BY node_type", RAW),
    "candidates_v1": sql("""
SELECT user_id, seg || '|' || tier || '|团队|Python/SQL' || CASE t WHEN 0 THEN ' economy promo' WHEN 1 THEN ' large' ELSE '' END || ' ' || lower(seg) || ' ' || lower(seg) || ' SMALL' AS text,
  lower(seg) || '|tier|' || CASE WHEN length(tier) > 6 THEN substr(tier, 6) || '|' ELSE '' END || '团队|python|sql' AS skills,
  live_city AS city_ids, live_city || '|' || next_city AS desired_city_ids, lower(seg) || '|' || lower(seg) AS industries,
  CASE t WHEN 0 THEN 'economy|promo' WHEN 1 THEN 'large' ELSE '' END AS desired_types, degree,
  CAST(CASE degree WHEN '本科' THEN 5 WHEN '硕士' THEN 6 WHEN '大专' THEN 4 ELSE 0 END AS INTEGER) AS degree_rank, CAST(2024 - CAST(started AS INTEGER) AS DOUBLE) AS years FROM ru""", RAW),
    "jobs_v1": sql("""
SELECT job_id, title, title || ' ' || kind || ' ' || shown AS text,
  array_to_string(list_sort(list_distinct(list_concat(string_split(title, ' '), [lower(kind), '熟练', lower(brand)]))), '|') AS skills,
  city, kind AS job_type, degree AS min_degree, CAST(CASE degree WHEN '本科' THEN 5 WHEN '高中' THEN 2 ELSE 0 END AS INTEGER) AS min_degree_rank, CAST(years AS DOUBLE) AS min_years FROM rj""", RAW),
    "processed_users": sql("""
SELECT u.user_id, coalesce(s.ids, '') AS skill_ids, live_city, CASE t WHEN 0 THEN 'economy|promo' WHEN 1 THEN 'large' ELSE '' END AS desired_types,
  lower(seg) || '|' || lower(seg) AS industries, CAST(CASE degree WHEN '本科' THEN 5 WHEN '硕士' THEN 6 WHEN '大专' THEN 4 ELSE 0 END AS INTEGER) AS degree_rank,
  CAST(2024 - CAST(started AS INTEGER) AS DOUBLE) AS years,
  lower(seg) || ' ' || lower(replace(tier, ' ', '')) || ' 团队 python sql' || CASE t WHEN 0 THEN ' economy promo' WHEN 1 THEN ' large' ELSE '' END || ' ' || lower(seg) || ' ' || lower(seg)
    || ' SMALL' || CASE WHEN degree = '' THEN '' ELSE ' ' || degree END AS text
FROM ru u LEFT JOIN (SELECT t.user_id, string_agg(CAST(v.skill_id AS VARCHAR), '|' ORDER BY t.pos) AS ids FROM tags t JOIN voc v ON v.skill = t.tag GROUP BY t.user_id) s ON s.user_id = u.user_id""", RAW + "," + SPLIT_RAW),
    "processed_jobs": sql("""
SELECT job_id, title, city, kind AS job_type, CAST(CASE degree WHEN '本科' THEN 5 WHEN '高中' THEN 2 ELSE 0 END AS INTEGER) AS min_degree_rank, CAST(years AS DOUBLE) AS min_years,
  CAST((SELECT count(*) FROM voc WHERE instr(lower(title), skill) > 0 OR instr(lower(shown), skill) > 0) AS INTEGER) AS n_skills, title || ' ' || kind || ' ' || shown AS text FROM jobd""", RAW + "," + SPLIT_RAW),
    "processed_run": sql("""
SELECT 'users' AS item, CAST(count(*) AS DOUBLE) AS value FROM ru UNION ALL SELECT 'jobs', count(*) FROM jobd UNION ALL SELECT 'interactions', count(*) FROM ract
UNION ALL SELECT 'positives', count(*) FROM ract WHERE level >= 2 UNION ALL SELECT 'train_pos', count(*) FROM ract WHERE level >= 2 AND split = 'train'
UNION ALL SELECT 'valid_pos', count(*) FROM ract WHERE split = 'valid' UNION ALL SELECT 'test_pos', count(*) FROM ract WHERE split = 'test'
UNION ALL SELECT 'skill_vocab', count(*) FROM voc
UNION ALL SELECT 'avg_user_skills', round((SELECT count(*) FROM tags t JOIN voc v ON v.skill = t.tag) / (SELECT count(*) FROM ru), 6)
UNION ALL SELECT 'avg_job_skills', round(avg((SELECT count(*) FROM voc WHERE instr(lower(title), skill) > 0 OR instr(lower(shown), skill) > 0)), 6) FROM jobd""", RAW + "," + SPLIT_RAW),
    "raw_scan": """
SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS jd_no, CASE WHEN event_type = 'view' THEN '1' ELSE '0' END AS browsed,
  CASE WHEN event_type = 'click' THEN '1' ELSE '0' END AS delivered, CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END AS satisfied,
  row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events""",
    "raw_preview": sql("""
SELECT unnest(['user_id', 'live_city_id', 'desire_jd_city_id', 'desire_jd_industry_id', 'desire_jd_type_id', 'cur_industry_id', 'cur_jd_type', 'cur_degree_id', 'start_work_date', 'experience']) AS "column",
  unnest([user_id, live_city, live_city || ',' || next_city, lower(seg), 'ECONOMY/PROMO', seg, 'SMALL', '本科', started, seg || '|' || tier || '|团队|Python/SQL']) AS sample
FROM ru WHERE k = 0""", RAW),
    "metrics_sink": sql("""
SELECT 'popularity' AS model, 1::BIGINT AS n_seeds, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, 0::BIGINT AS test_pairs
FROM test w LEFT JOIN poprank r ON r.user_id = w.user_id AND r.job_id = w.job_id
UNION ALL SELECT 'split', 0, 0, count(*) FROM test"""),
    "stored_rankings": sql("SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(job_id AS VARCHAR) AS job_id, CAST(rank AS INTEGER) AS rank FROM poprank WHERE rank <= 20"),
    "occupation_reference": """
SELECT DISTINCT 'category' AS kind, lower(n_name) AS term FROM nation UNION SELECT 'occupation', lower(p_brand || p_type) FROM part
UNION SELECT 'task', lower(p_brand || p_type) FROM part""",
    "match_evidence_v1": sql("""
SELECT f.user_id, f.job_id, round(r.score, 6) AS rule_score, coalesce(s.matched, '') AS matched, coalesce(s.missing, '') AS missing, coalesce(s.paths, '') AS paths,
  array_to_string(CASE WHEN len(why) = 0 THEN ['根据当前模型排序进入 Top-K'] ELSE why END, '|') AS reasons
FROM kf f JOIN rule1 r ON r.user_id = f.user_id AND r.job_id = f.job_id
JOIN (SELECT user_id, job_id, list_filter([CASE WHEN round(cov, 6) > 0 THEN '技能覆盖度 ' || printf('%.2f', cov) END, CASE WHEN city = 1 THEN '城市匹配' END, CASE WHEN edu = 1 THEN '学历满足岗位要求' END,
    CASE WHEN exp = 1 THEN '经验满足岗位要求' END, CASE WHEN type = 1 THEN '岗位类型符合期望' END], lambda x: x IS NOT NULL) AS why FROM feat1) y ON y.user_id = f.user_id AND y.job_id = f.job_id
LEFT JOIN (SELECT user_id, job_id, string_agg(skill, '|' ORDER BY skill) FILTER (has) AS matched, string_agg(skill, '|' ORDER BY skill) FILTER (NOT has) AS missing,
    string_agg('Candidate:' || user_id || ' -> Skill:' || skill || ' <- Job:' || job_id, '|' ORDER BY skill) FILTER (has) AS paths FROM ks GROUP BY ALL) s ON s.user_id = f.user_id AND s.job_id = f.job_id""", EVIDENCE),
    "match_evidence_v2": sql("""
SELECT user_id, job_id, matched, missing, array_to_string(reasons, '|') AS reasons, CAST(n AS INTEGER) AS paths,
  array_to_string(list_filter([matched, missing], lambda x: x <> ''), '|') AS allowed FROM ev2""", EVIDENCE),
    "path_attention": sql("SELECT user_id, job_id, skill, round(weight, 6) AS weight FROM att", EVIDENCE),
    "pooled_paths": sql("""
SELECT k.user_id, k.job_id, CAST(v.dim + p.part * 64 AS INTEGER) AS dim, round(coalesce(c.value, 0), 6) + 0.0 AS value
FROM kp k CROSS JOIN range(64) v(dim) CROSS JOIN range(2) p(part) LEFT JOIN (
  SELECT user_id, job_id, 0 AS part, dim, sum(weight * v) AS value FROM att JOIN sv ON sv.skill = att.skill GROUP BY ALL
  UNION ALL SELECT user_id, job_id, 1, dim, avg(v) FROM ks JOIN sv ON sv.skill = ks.skill WHERE NOT has GROUP BY ALL) c
ON c.user_id = k.user_id AND c.job_id = k.job_id AND c.part = p.part AND c.dim = v.dim""", EVIDENCE + """,
sv AS (SELECT skill, dim, v FROM (SELECT skill, row_number() OVER (ORDER BY skill) - 1 AS n FROM (SELECT DISTINCT skill FROM jskill)) JOIN vec ON vec.vec_id = n)"""),
    "subgraph_edges": sql("""
SELECT user_id, job_id, 'candidate:' || user_id AS source, 'job:' || job_id AS target, 'MATCHED_TO' AS relation, '' AS status FROM kp
UNION ALL SELECT user_id, job_id, 'candidate:' || user_id, 'skill:' || skill, 'HAS_SKILL', 'matched' FROM ks WHERE has
UNION ALL SELECT user_id, job_id, 'job:' || job_id, 'skill:' || skill, 'REQUIRES_SKILL', CASE WHEN has THEN 'matched' ELSE 'missing_for_candidate' END FROM ks
UNION ALL SELECT k.user_id, k.job_id, 'candidate:' || k.user_id, 'city:' || live_city, 'LIVES_IN', '' FROM kp k JOIN users u ON u.user_id = k.user_id
UNION ALL SELECT k.user_id, k.job_id, 'candidate:' || k.user_id, 'city:' || next_city, 'DESIRES_CITY', '' FROM kp k JOIN users u ON u.user_id = k.user_id
UNION ALL SELECT k.user_id, k.job_id, 'job:' || k.job_id, 'city:' || city, 'LOCATED_IN', '' FROM kp k JOIN jobs j ON j.job_id = k.job_id
UNION ALL SELECT k.user_id, k.job_id, 'candidate:' || k.user_id, 'job_type:' || job_type, 'DESIRES_TYPE', '' FROM kp k JOIN utype t ON t.user_id = k.user_id
UNION ALL SELECT k.user_id, k.job_id, 'job:' || k.job_id, 'job_type:' || job_type, 'OF_TYPE', '' FROM kp k JOIN jobs j ON j.job_id = k.job_id""", EVIDENCE),
    "subgraph_nodes": sql("""
SELECT user_id, job_id, 'candidate:' || user_id AS node, 'Candidate' AS type, CAST(user_id AS VARCHAR) AS label, 'query_candidate' AS role FROM kp
UNION ALL SELECT k.user_id, k.job_id, 'job:' || k.job_id, 'Job', title, 'recommended_job' FROM kp k JOIN jobs j ON j.job_id = k.job_id
UNION ALL SELECT user_id, job_id, 'skill:' || skill, 'Skill', skill, CASE WHEN has THEN 'matched_skill' ELSE 'missing_required_skill' END FROM ks
UNION ALL SELECT user_id, job_id, 'city:' || c, 'City', c, 'context_city' FROM (
  SELECT k.user_id, k.job_id, live_city AS c FROM kp k JOIN users u ON u.user_id = k.user_id UNION SELECT k.user_id, k.job_id, next_city FROM kp k JOIN users u ON u.user_id = k.user_id
  UNION SELECT k.user_id, k.job_id, city FROM kp k JOIN jobs j ON j.job_id = k.job_id)
UNION ALL SELECT user_id, job_id, 'job_type:' || t, 'JobType', t, 'context_job_type' FROM (
  SELECT k.user_id, k.job_id, job_type AS t FROM kp k JOIN utype u ON u.user_id = k.user_id UNION SELECT k.user_id, k.job_id, job_type FROM kp k JOIN jobs j ON j.job_id = k.job_id)""", EVIDENCE),
    "explanations": sql("""
SELECT user_id, job_id, text, '<div class="llm-explanation">' || array_to_string(['<p>' || replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' for p in string_split(text, chr(10))], '') || '</div>' AS html,
  source, rejected FROM exd""", EXPLAINED),
    "explanation_documents": sql("SELECT user_id, job_id, source, 'local_kg_v1' AS schema_version FROM exd", EXPLAINED),
    "requirement_explanations": sql("""
SELECT k.user_id, k.job_id, coalesce(string_agg(DISTINCT s.skill, '|' ORDER BY s.skill) FILTER (u.skill IS NOT NULL), '') AS matched,
  coalesce(string_agg(DISTINCT s.skill, '|' ORDER BY s.skill) FILTER (u.skill IS NULL AND s.kind = 'r'), '') AS missing,
  CAST(count(DISTINCT s.skill) FILTER (u.skill IS NOT NULL) AS INTEGER) AS paths,
  array_to_string(list_filter([CASE WHEN count(u.skill) > 0 THEN '技能覆盖度较高' END, CASE WHEN any_value(p.live_city) = any_value(j.city) THEN '城市匹配' END], lambda x: x IS NOT NULL), '|') AS reasons
FROM (SELECT DISTINCT user_id, job_id FROM lv) k JOIN users p ON p.user_id = k.user_id JOIN jobs j ON j.job_id = k.job_id
JOIN (SELECT job_id, w1 AS skill, 'r' AS kind FROM alljobs UNION SELECT job_id, w2, 'r' FROM alljobs
      UNION SELECT job_id, brand, 'p' FROM alljobs UNION SELECT job_id, job_type, 'p' FROM alljobs) s ON s.job_id = k.job_id
LEFT JOIN uskill u ON u.user_id = k.user_id AND u.skill = s.skill GROUP BY k.user_id, k.job_id"""),
    "recommendations_by_rule": sql("""
SELECT a.request_id, CAST(a.user_id AS VARCHAR) AS candidate_id, a.model, CAST(a.rank AS INTEGER) AS rank, CAST(a.job_id AS VARCHAR) AS job_id, round(a.score, 6) AS score,
  CASE WHEN a.shown THEN coalesce(m.matched, '') ELSE '' END AS matched, CAST(a.warnings AS INTEGER) AS warnings
FROM answered a LEFT JOIN (SELECT u.user_id, s.job_id, string_agg(s.skill, '|' ORDER BY s.skill) AS matched FROM uskill u JOIN jskill s ON s.skill = u.skill GROUP BY ALL) m
ON m.user_id = a.user_id AND m.job_id = a.job_id""", REQUESTS),
    "rejected_requests": sql("""
SELECT request_id, CASE WHEN model = 'unknown' THEN 'UNSUPPORTED_MODEL' WHEN user_id IS NULL THEN 'MISSING_CANDIDATE' ELSE 'CANDIDATE_NOT_FOUND' END AS error_code
FROM rq WHERE request_id NOT IN (SELECT request_id FROM good)""", REQUESTS),
    "candidate_pages": sql("""
SELECT job_id, user_id, match, 2 AS page, place, total, CAST(ceil(total / 10) AS BIGINT) AS total_pages FROM (
  SELECT f.job_id, f.user_id, match, row_number() OVER (PARTITION BY f.job_id ORDER BY match DESC, f.user_id) AS place, count(*) OVER (PARTITION BY f.job_id) AS total
  FROM (SELECT k.job_id, k.user_id, CAST(greatest(0, least(100, round(100 * r.score))) AS INTEGER) AS match FROM kp k JOIN rule1 r ON r.user_id = k.user_id AND r.job_id = k.job_id) f)
WHERE place > 10 AND place <= 20""", EVIDENCE),
    "candidate_pages_by_experience": sql("""
SELECT user_id, job_id, years, 1 AS page, place, total, CAST(ceil(total / 5) AS BIGINT) AS total_pages FROM (
  SELECT k.job_id, k.user_id, u.years, row_number() OVER (PARTITION BY k.job_id ORDER BY u.years DESC, k.user_id) AS place, count(*) OVER (PARTITION BY k.job_id) AS total
  FROM kp k JOIN users u ON u.user_id = k.user_id JOIN jobs j ON j.job_id = k.job_id) WHERE place <= 5""", EVIDENCE),
    "job_candidate_pages": sql("""
SELECT job_id, sort_by, page, place, user_id, match, round(value, 2) + 0.0 AS value, total, CAST(ceil(total / 20) AS BIGINT) AS total_pages FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, sort_by ORDER BY value DESC, user_id) AS place, count(*) OVER (PARTITION BY job_id, sort_by) AS total
  FROM (SELECT r.job_id, s.sort_by, CAST(r.job_id // 100 * 13 % 60 + 1 AS INTEGER) AS page, r.user_id,
      CAST(greatest(0, least(100, round(100 * r.score))) AS INTEGER) AS match,
      CASE s.sort_by WHEN 'match' THEN greatest(0, least(100, round(100 * r.score))) WHEN 'salary' THEN CAST(c.c_acctbal AS DOUBLE) ELSE CAST(u.years AS DOUBLE) END AS value
    FROM judged r JOIN users u ON u.user_id = r.user_id JOIN customer c ON c.c_custkey = r.user_id
    CROSS JOIN (SELECT unnest(['match', 'salary', 'experience']) AS sort_by) s))
WHERE place > (page - 1) * 20 AND place <= page * 20""", """
judged AS (
  SELECT user_id, job_id, 0.5 * n / n_job + 0.1 * (1 - (n_job - n) / n_job) + 0.15 * city + 0.1 * edu + 0.1 * exp + 0.05 * type + 0.03 * ln(1.0 + n) AS score FROM (
    SELECT u.user_id, j.job_id, coalesce(s.n, 0) AS n, jn.n_job, CASE WHEN j.city IN (u.live_city, u.next_city) THEN 1 ELSE 0 END AS city,
      CASE WHEN min_degree_rank > 0 AND degree_rank >= min_degree_rank THEN 1 ELSE 0 END AS edu,
      CASE WHEN min_years > 0 AND years >= min_years THEN 1 ELSE 0 END AS exp, CASE WHEN t.user_id IS NOT NULL THEN 1 ELSE 0 END AS type
    FROM users u CROSS JOIN (SELECT * FROM alljobs WHERE job_id % 100 = 0) j JOIN jn ON jn.job_id = j.job_id
    LEFT JOIN sharedn s ON s.user_id = u.user_id AND s.job_id = j.job_id
    LEFT JOIN utype t ON t.user_id = u.user_id AND t.job_type = j.job_type))"""),
    "user_ndcg_sink": SQL_MATCHING["user_ndcg"],
    "vector_tables": sql("""
SELECT 'user' AS side, u.user_id AS id, 64 AS places, round(v, 6) + 0.0 AS first FROM users u JOIN vec ON vec.vec_id = u.user_id WHERE dim = 0
UNION ALL SELECT 'job', j.job_id, 64, round(v, 6) FROM jobs j JOIN vec ON vec.vec_id = (SELECT max(vec_id) FROM embeddings) - j.job_id WHERE dim = 0
UNION ALL SELECT 'skill', vec_id, 64, round(v, 6) FROM vec WHERE dim = 0"""),
    "invalid_jobs": """
SELECT CAST(p_partkey AS VARCHAR) AS jd_no, CASE WHEN p_partkey % 10 = 0 THEN 'job_id is required' ELSE 'title is required' END AS reason
FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 13 = 0""",
    "health": sql("SELECT 'candidates' AS item, count(*) AS n FROM users UNION ALL SELECT 'jobs', count(*) FROM jobs"),
    "invalid_profiles": "SELECT CAST(c_custkey AS VARCHAR) AS user_id, 'candidate_id is required' AS reason FROM customer WHERE c_custkey % 10 = 0",
    "taxonomy_tree": """
SELECT 'R' || r_regionkey AS career_code, r_name AS name, '' AS parent_code, r_name AS path, r_regionkey IN (SELECT n_regionkey FROM nation) AS has_children FROM region
UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey, r_name || '/' || n_name, n_nationkey IN (SELECT c_nationkey FROM customer) FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 'C' || c_custkey, c_name, 'N' || c_nationkey, r_name || '/' || n_name || '/' || c_name, false FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "latest_occupations": """
SELECT CAST(user_id AS VARCHAR) AS career_code, CAST(length(event_type) AS INTEGER) AS version_id, arg_max(event_type, event_id) AS name, arg_max(value, event_id) AS value, max(event_id) AS row_index
FROM events GROUP BY user_id, length(event_type)""",
}
