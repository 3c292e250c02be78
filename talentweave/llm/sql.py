"""SQL with the same rows as the registered document queries, where plain SQL can express them on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_BLANK = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
spread AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM spread)),
placed AS (SELECT d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS i FROM docs d, (SELECT DISTINCT n FROM wanted) l WHERE len(d.w) >= l.n),
hits AS (SELECT p.doc_id, p.i, p.n, x.item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM placed) p
  JOIN wanted x ON x.win = p.win AND x.n = p.n),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN met m ON m.doc_id = d.doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
reached AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.component_id = d.doc_id AS kept
FROM docs d JOIN lowest l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK}) AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
first AS (SELECT win, min(doc_id) AS doc_id FROM wins GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM (SELECT w.doc_id, w.i FROM wins w JOIN first f ON f.win = w.win WHERE f.doc_id < w.doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.pos) AS text FROM words x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.pos = x.pos GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

LINES = r"""
WITH lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
seen AS (SELECT *, length(line) AS size FROM lines WHERE regexp_matches(line, '[^\x09-\x0D\x20]')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS copy, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM seen),
first AS (SELECT * FROM ranked WHERE copy = 1),
halves AS (SELECT DISTINCT place, line, size, kind, m // 2 AS a, CASE WHEN kind = 0 THEN left(line, m // 2) ELSE right(line, m // 2) END AS half
  FROM (SELECT *, size AS m FROM first WHERE size >= 20 UNION ALL SELECT *, size - 1 FROM first WHERE size >= 20) CROSS JOIN range(2) k(kind)),
near AS (SELECT DISTINCT y.place FROM halves x JOIN halves y ON x.kind = y.kind AND x.a = y.a AND x.half = y.half AND x.place < y.place
  WHERE abs(x.size - y.size) <= 1 AND levenshtein(x.line, y.line) <= 1),
gone AS (SELECT doc_id, line_no, copy = 1 AS near FROM ranked WHERE copy > 1 OR place IN (SELECT place FROM near))
SELECT d.doc_id, coalesce(s.n, 0) AS n_lines, coalesce(g.n_copies, 0) AS n_copies, coalesce(g.n_near, 0) AS n_near, coalesce(g.places, '') AS removed_lines
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM seen GROUP BY doc_id) s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) FILTER (NOT near) AS n_copies, count(*) FILTER (near) AS n_near,
  string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS places FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id"""

# states of a conversation: nothing yet, after system, user, assistant; the state a new or reroled row leads to; its role
_EXPECTED = {"st": "us", "sy": "us", "us": "ai", "ai": "us"}
_KEPT = {"st": {"s": "sy", "u": "us"}, "sy": {"u": "us"}, "us": {"a": "ai"}, "ai": {"u": "us"}}
_ROLES = {"us": "user", "ai": "assistant"}


def _before(rest: str, cost: str, letter: str, line: str) -> str:
    """An edit in front of ``rest``, a struct of cost, audit and repaired lines; such structs compare in this order."""
    return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'b': {line} || {rest}.b}}"


def _edits(q: str) -> str:
    """The best of deleting, keeping and reroling row x in state q, by what p says of the rows after it."""
    keep = " ".join(f"WHEN '{initial}' THEN {_before('p.' + to, 'x.extra', 'K', 'x.line')}" for initial, to in _KEPT[q].items())
    rerole = _before("p." + _EXPECTED[q], "1 + x.extra", "R", f"'{_ROLES[_EXPECTED[q]]}:' || x.text || chr(10)")
    delete = _before("p." + q, "2", "D", "''")
    return f"CASE WHEN x.gone THEN {delete} ELSE list_min([{delete}, {rerole}, CASE x.initial {keep} END]) END"


def _insert(q: str, suffix: str) -> str:
    return f"list_min([{q}, {_before(_EXPECTED[q] + suffix, '5', 'I', chr(39) + _ROLES[_EXPECTED[q]] + ':' + chr(39) + ' || chr(10)')}])"


_STEP = ", ".join(f"{_edits(q)} AS {q}" for q in _EXPECTED)
_ONE_MORE = ", ".join(f"{_insert(q, '')} AS {q}_1" for q in _EXPECTED)
_TWO_MORE = ", ".join(f"CASE WHEN gone THEN {q} ELSE {_insert(q, '_1')} END AS {q}" for q in _EXPECTED)

CONVERSATIONS = rf"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS k FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(k, lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, b: xor(r >> 8, t[(xor(r, b) & 255) + 1])), 4294967295) % 20 AS fault FROM keyed, crcs),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
placed AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prior,
  regexp_replace(text, '[ 	-
]+$', '') AS ends
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
faults AS (SELECT *, ends = '' AS blank, ends <> '' AND said > 1 AS dup, ends <> '' AND said = 1 AND right(ends, 1) NOT IN ('.', '!', '?') AS cut
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS said FROM placed)),
live AS (SELECT conv_id, i, initial, text, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra, role || ':' || text || chr(10) AS line FROM faults),
best AS (SELECT conv_id, max(i) + 1 AS i, {{'c': 0, 'a': '', 'b': ''}} AS st, {{'c': 10, 'a': 'II', 'b': 'user:' || chr(10) || 'assistant:' || chr(10)}} AS sy,
    {{'c': 5, 'a': 'I', 'b': 'assistant:' || chr(10)}} AS us, {{'c': 0, 'a': '', 'b': ''}} AS ai FROM live GROUP BY conv_id
  UNION ALL SELECT conv_id, i, {_TWO_MORE} FROM (SELECT *, {_ONE_MORE} FROM (
    SELECT p.conv_id, x.i, x.gone, {_STEP} FROM best p JOIN live x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.i = p.i - 1))),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT g.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, CAST(coalesce(b.st.c, 0) AS BIGINT) AS cost, coalesce(b.st.a, '') AS audit,
  sha256(coalesce(left(b.st.b, length(b.st.b) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id AND b.i = 1"""

SQL: dict[str, str] = {
    "op2_benchmark_decontamination": DECONTAMINATION,
    "op3_minhash_near_dedup": NEAR_DUPLICATES,
    "op5_substring_dedup": SUBSTRINGS,
    "op6_line_dedup": LINES,
    "op11_conversation_repair": CONVERSATIONS,
}
