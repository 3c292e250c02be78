"""SQL that the text queries must agree with."""

from __future__ import annotations

from ..operators.vocabulary import DROP_TERMS, SHORT_ENGLISH, TRANSVERSAL_TERMS

SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
EDGES = " ：:;；,，。.!！？?()（）[]【】{}<>《》\"''“”‘’"
MISSING = r"('', '-', '-1', '\N', 'null', 'none', 'nan', '\n')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def _value(x: str) -> str:
    return f"CASE WHEN lower({_strip(x)}) IN {MISSING} THEN '' ELSE {_strip(x)} END"


def _clean(x: str) -> str:
    return f"regexp_replace(trim({_value(x)}, '{EDGES}'), '[{SPACES}]+', '', 'g')"


def _names(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def tokens_cte(name: str, table: str, key: str) -> str:
    """Token rows (id, term) of a text table, repeats kept."""
    return f"""
{name}_part AS (SELECT id, {_clean('p')} AS part FROM (
  SELECT {key} AS id, unnest(regexp_split_to_array(lower({_value('text')}), '[|,，、;；/{SPACES}]+')) AS p FROM {table})),
{name}_found AS (SELECT id, part, regexp_extract_all(part, '[a-z0-9+.#\\-]{{2,}}') AS latin,
  regexp_extract_all(part, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') AS runs FROM {name}_part WHERE part <> ''),
{name} AS (
  SELECT id, unnest(latin) AS term FROM {name}_found
  UNION ALL SELECT id, unnest(flatten([CASE WHEN length(r) <= 6 THEN [r] ELSE
      list_concat([r[i:i + 1] for i in range(1, length(r))], [r[i:i + 2] for i in range(1, length(r) - 1)]) END for r in runs])) FROM {name}_found
  UNION ALL SELECT id, part FROM {name}_found WHERE len(latin) = 0 AND len(runs) = 0 AND length(part) BETWEEN 2 AND 32)"""


DOC = tokens_cte("doc", "documents", "doc_id")
ASK = tokens_cte("ask", "benchmark", "item_id")


def bm25_sql(distinct: bool, topn: int = 1000) -> str:
    d = "SELECT DISTINCT id, term FROM doc" if distinct else "SELECT id, term FROM doc"
    q = "SELECT DISTINCT id, term FROM ask" if distinct else "SELECT id, term FROM ask"
    return f"""WITH {DOC.strip()},{ASK},
dt AS ({d}), qt AS (SELECT id, term, count(*) AS qtf FROM ({q}) GROUP BY ALL),
tf AS (SELECT id, term, count(*) AS tf FROM dt GROUP BY ALL),
len AS (SELECT x.doc_id AS id, greatest(1, coalesce(l.n, 0)) AS n FROM documents x LEFT JOIN (SELECT id, count(*) AS n FROM dt GROUP BY id) l ON l.id = x.doc_id),
st AS (SELECT count(*) AS docs, avg(n) AS average FROM len),
idf AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY term, docs),
sc AS (SELECT qt.id AS user_id, tf.id AS job_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len.n / average))) AS score
  FROM qt JOIN tf ON tf.term = qt.term JOIN idf ON idf.term = qt.term JOIN len ON len.id = tf.id CROSS JOIN st GROUP BY ALL),
al AS (SELECT user_id, job_id, round(score, 9) AS score FROM sc WHERE round(score, 9) > 0)
SELECT user_id, job_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS INTEGER) AS rank
FROM al QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) <= {topn}"""


HASHED = f"""WITH {DOC.strip()},{ASK},
dt AS (SELECT DISTINCT id, term FROM doc), qt AS (SELECT DISTINCT id, term FROM ask),
idf AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM dt GROUP BY term),
bk AS (SELECT term, v % 512 AS bucket, CASE WHEN v % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (
  SELECT term, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS v FROM (SELECT term FROM dt UNION SELECT term FROM qt))),
dv AS (SELECT id, bucket, sum(sign * coalesce(idf, 1)) AS v FROM dt JOIN bk USING (term) LEFT JOIN idf USING (term) GROUP BY ALL),
qv AS (SELECT id, bucket, sum(sign * coalesce(idf, 1)) AS v FROM qt JOIN bk USING (term) LEFT JOIN idf USING (term) GROUP BY ALL),
dn AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id), qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM qv GROUP BY id),
sc AS (SELECT q.id AS user_id, d.id AS job_id, sum(q.v * d.v) / any_value(qn.n * dn.n) AS score FROM qv q JOIN dv d ON d.bucket = q.bucket
  JOIN qn ON qn.id = q.id JOIN dn ON dn.id = d.id WHERE qn.n > 0 AND dn.n > 0 GROUP BY ALL),
al AS (SELECT b.item_id AS user_id, x.doc_id AS job_id, round(coalesce(s.score, 0), 9) + 0.0 AS score FROM benchmark b CROSS JOIN documents x
  LEFT JOIN sc s ON s.user_id = b.item_id AND s.job_id = x.doc_id)
SELECT user_id, job_id, round(score, 6) + 0.0 AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) AS INTEGER) AS rank
FROM al QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, job_id) <= 1000"""


GATED = f"""{DOC.strip()},{ASK},
ref AS (SELECT DISTINCT 'occupation' AS kind, lower(role) AS term FROM conversations UNION SELECT 'task', term FROM ask),
tok AS (SELECT term AS token, count(DISTINCT id) AS freq, lower({_clean('term')}) AS key FROM doc GROUP BY term),
rule AS (SELECT token, freq, CASE
    WHEN key = '' THEN 1
    WHEN regexp_full_match(key, '[a-z0-9+.#\\-]+') AND length(key) < 3 AND key NOT IN {_names(SHORT_ENGLISH)} THEN 2
    WHEN key IN {_names(DROP_TERMS)} THEN 3
    WHEN key IN (SELECT term FROM ref WHERE kind = 'occupation') THEN 4
    WHEN key IN {_names(TRANSVERSAL_TERMS)} THEN 5
    WHEN key IN (SELECT term FROM ref WHERE kind = 'task') THEN 6 ELSE 7 END AS r FROM tok),
gate AS (SELECT token, freq, r >= 5 AS keep,
  ['empty', 'english_noise', 'generic_non_skill', 'occupation_or_job_type', 'transversal', 'reference_task', 'hard_or_knowledge'][r] AS skill_type,
  CAST([0, 0, 0, 0, 0.35, 1, 1][r] AS DOUBLE) AS weight,
  ['empty', 'short_english', 'drop_term', 'occupation_reference', 'transversal_downweight', 'standard_reference', ''][r] AS reason FROM rule),
vocab AS (SELECT token AS skill, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS skill_id, freq, weight FROM gate WHERE keep AND freq >= 5),
terms AS (SELECT lower(skill) AS term, max(skill_id) AS skill_id, arg_max(weight, skill_id) AS weight,
  regexp_full_match(lower(skill), '[a-z0-9+.#\\-]+') AS ascii FROM vocab GROUP BY lower(skill)),
low AS (SELECT item_id AS id, lower(text) AS t FROM benchmark),
spots AS (SELECT id, t, unnest(range(1, length(t))) AS p FROM low),
hits AS (SELECT id, t, p, l, substr(t, p, l) AS term FROM spots CROSS JOIN (SELECT DISTINCT length(term) AS l FROM terms) WHERE p + l - 1 <= length(t)),
found AS (SELECT h.id, m.skill_id, sum(m.weight * (1 + 0.1 * h.l)) AS score FROM hits h JOIN terms m ON m.term = h.term
  WHERE NOT m.ascii OR (NOT regexp_full_match(CASE WHEN p > 1 THEN substr(t, p - 1, 1) ELSE '' END, '[a-z0-9+#.]')
    AND NOT regexp_full_match(substr(t, p + l, 1), '[a-z0-9+#.]')) GROUP BY ALL)"""


def _sorted_values(x: str, separators: str, condition: str, lower: bool) -> str:
    cleaned = _clean("p")
    value = f"CASE WHEN regexp_full_match({cleaned}, '[A-Za-z0-9+.#\\-]+') THEN lower({cleaned}) ELSE {cleaned} END" if lower else cleaned
    return (
        f"coalesce(array_to_string(list_sort(list_distinct(list_filter("
        f"[{value} for p in regexp_split_to_array({_value(x)}, '{separators}')], lambda v: {condition}))), '|'), '')"
    )


SQL: dict[str, str] = {
    "document_frequency": f"WITH {DOC.strip()}\nSELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM doc GROUP BY term",
    "corpus_statistics": f"""WITH {DOC.strip()}
SELECT count(*) AS documents, round(avg(greatest(1, coalesce(n, 0))), 6) AS average_length
FROM documents x LEFT JOIN (SELECT id, count(*) AS n FROM doc GROUP BY id) l ON l.id = x.doc_id""",
    "bm25_ranking_v1": bm25_sql(True),
    "bm25_ranking_v2": bm25_sql(False),
    "bm25_ranking_top_10": bm25_sql(False, 10),
    "hashed_ranking": HASHED,
    "encoder_hook": """
SELECT doc_id, round(c / n, 6) AS chars, round(s / n, 6) AS blanks, round(e / n, 6) AS letters_e FROM (
  SELECT *, sqrt(c * c + s * s + e * e) AS n FROM (
    SELECT doc_id, CAST(length(t) AS DOUBLE) AS c, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS s,
      CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS e
    FROM (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN ' ' ELSE text END AS t FROM documents)))""",
    "squeezed_texts": f"""
SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM (
  SELECT doc_id, regexp_replace({_strip('text')}, '[{SPACES}]+', ' ', 'g') AS t FROM documents)""",
    "url_values": f"""
SELECT page_id, {_sorted_values('url', '[|,，、;；/\\n\\r\\t]+', "v <> ''", True)} AS multi_values,
  {_sorted_values('url', '[|,，、;；/]+', 'length(v) >= 2', True)} AS tags,
  {_sorted_values('url', '[|,，、;；\\n\\r\\t/／]+', "v <> '' AND (length(v) >= 2 OR regexp_matches(v, '[A-Za-z0-9]')) AND length(v) <= 32", True)} AS skills
FROM pages""",
    "field_parsers": """
SELECT c_custkey, CAST([1, 2, 3, 4, 5, 6, 7, 8, 0, 0][c_custkey % 10 + 1] AS INTEGER) AS degree_rank,
  round(CASE WHEN c_custkey % 5 = 3 THEN 0 WHEN n BETWEEN 1900 AND 2100 THEN greatest(0, 2024 - n) WHEN n > 100 THEN n / 100 ELSE n END, 6) AS years
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN a WHEN 1 THEN a % 10 WHEN 2 THEN 1950 + c_custkey % 100 ELSE a % 900 + 101 END AS n
  FROM (SELECT c_custkey, floor(abs(c_acctbal)) AS a FROM customer))""",
    "standard_names": """
SELECT p_partkey, replace(p_name, ' ', '') AS standard, replace(p_name, ' ', '') || '|' || lower(p_type) || '|' || lower(p_brand) AS phrases FROM part""",
    "gate_decisions": f"WITH {GATED}\nSELECT token, keep, skill_type, weight, reason FROM gate",
    "gate_summary": f"""WITH {GATED}
SELECT 'reference_' || kind AS item, count(*) AS n FROM ref GROUP BY kind
UNION ALL SELECT 'reference_' || kind, 0 FROM (VALUES ('category'), ('work_type'), ('standard')) k(kind) UNION ALL SELECT 'enabled', 1
UNION ALL SELECT 'drop_terms', {len(DROP_TERMS)} UNION ALL SELECT 'transversal_terms', {len(TRANSVERSAL_TERMS)} UNION ALL SELECT 'english_min_len', 3""",
    "skill_vocabulary": f"WITH {GATED}\nSELECT skill, skill_id, freq FROM vocab",
    "dictionary_matches": f"WITH {GATED}\nSELECT id, skill_id, round(score, 6) AS score FROM found",
    "top_text_skills": f"""WITH {GATED}
SELECT id, CAST(place AS INTEGER) AS place, skill_id, round(score, 3) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, skill_id) - 1 AS place FROM (SELECT id, skill_id, round(score, 9) AS score FROM found)) WHERE place < 20""",
    "tag_ids": f"WITH {GATED}\nSELECT DISTINCT doc.id AS user_id, vocab.skill_id FROM doc JOIN vocab ON vocab.skill = doc.term",
}
