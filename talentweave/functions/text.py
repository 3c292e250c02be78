"""Text expressions: cleaning, splitting, tokenizing. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
# Cell values that stand for "missing" (compared without case).
MISSING_MARKERS = ["", "-", "-1", "null", "none", "nan"]
# The database NULL marker; dropped unless a caller asks to keep it.
NULL_MARKER = r"\N"
# Characters stripped from both ends of a token.
TOKEN_EDGE_CHARS = " ：:;；,，。.!！？?()（）[]【】{}<>《》\"'“”‘’"
# Separators of multi-value fields, tag fields, free text and skill lists.
MULTI_VALUE_SEPARATORS = r"[|,，、;；/\n\r\t]+"
TAG_SEPARATORS = r"[|,，、;；/]+"
SKILL_SEPARATORS = r"[|,，、;；\n\r\t/／]+"
# White space of any script.
SPACE = r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = "".join(chr(n) for n in range(0x10000) if chr(n).isspace())
TEXT_SEPARATORS = rf"[|,，、;；/{SPACE}]+"
TASK_SEPARATORS = r"[;；,，、。.\n\r\t]+"
# Tokens made of these characters only count as Latin-script technical terms.
ASCII_TOKEN = r"^[A-Za-z0-9+.#\-]+$"
ASCII_TERMS = r"([a-z0-9+.#\-]{2,})"
CHINESE_RUNS = r"([一-鿿]{2,})"
# Words that never become a skill when a skill list is read from a knowledge-graph source field.
SKILL_STOPWORDS = [
    "岗位职责", "任职要求", "任职资格", "职位要求", "岗位要求", "职责", "要求", "其他", "工作", "岗位",
    "能力", "经验", "相关", "以上", "良好", "熟练", "较强", "具有", "具备", "优先",
    "优先考虑", "优先录用", "完成", "负责", "协助", "支持", "配合", "管理", "处理", "执行",
    "学习", "学习能力", "自我评价", "团队", "团队领导", "团队协作", "团队合作",
]
# ---------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space; NULL becomes the empty string."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(SPACE_CHARS))


def normalize_value(c: Column, keep_null_marker: bool = False) -> Column:
    """Trimmed cell value, with missing markers turned into the empty string."""
    markers = [m for m in MISSING_MARKERS if m] + ([] if keep_null_marker else [r"\\N"])
    return F.regexp_replace(strip(c), "(?i)^(?:" + "|".join(markers) + ")$", "")


def _lower_ascii(c: Column) -> Column:
    return F.when(c.rlike(ASCII_TOKEN), F.lower(c)).otherwise(c)


def clean_token(c: Column, lower_ascii: bool = True, keep_null_marker: bool = False) -> Column:
    """Token without edge punctuation and inner white space.

    ``lower_ascii`` lower-cases Latin-script technical terms (record building); the graph build
    keeps their case.
    """
    trimmed = F.btrim(normalize_value(c, keep_null_marker), F.lit(TOKEN_EDGE_CHARS))
    token = F.regexp_replace(trimmed, rf"[{SPACE}]+", "")
    return F.transform(F.array(token), _lower_ascii)[0] if lower_ascii else token


def _clean_parts(text: Column, separators: str, lower_ascii: bool) -> Column:
    parts = F.transform(F.split(text, separators), lambda p: clean_token(p, False))
    return F.transform(parts, _lower_ascii) if lower_ascii else parts


def split_multi_value(c: Column, lower_ascii: bool = True) -> Column:
    """Distinct cleaned values of a multi-value field, in order of first occurrence."""
    parts = _clean_parts(normalize_value(c), MULTI_VALUE_SEPARATORS, lower_ascii)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def split_tags(c: Column) -> Column:
    """Distinct tags of at least two characters, in order of first occurrence."""
    parts = _clean_parts(normalize_value(c), TAG_SEPARATORS, True)
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2))


def extract_skill_tokens(c: Column, max_tokens: int | None = None) -> Column:
    """Skill-like tokens of a semi-structured field: no stop-words, at most 32 characters, distinct."""
    parts = _clean_parts(normalize_value(c), SKILL_SEPARATORS, False)
    kept = F.filter(
        parts,
        lambda p: (p != "")
        & ~p.isin(SKILL_STOPWORDS)
        & ((F.length(p) >= 2) | p.rlike("[A-Za-z0-9]"))
        & (F.length(p) <= 32),
    )
    return _capped(F.array_distinct(F.transform(kept, _lower_ascii)), max_tokens)


def _grams(run: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (size - 1)), lambda i: F.substring(run, i, F.lit(size)))


def _part_candidates(part: Column) -> Column:
    """Terms of one cleaned part: Latin terms, then short Chinese runs whole or long ones as 2- and 3-grams.

    Most parts are one Latin term, so that case is settled by a single pattern.
    """
    runs = F.transform(
        F.regexp_extract_all(part, F.lit(CHINESE_RUNS), F.lit(1)),
        lambda run: F.when(F.length(run) <= 6, F.array(run)).otherwise(F.concat(_grams(run, 2), _grams(run, 3))),
    )
    mixed = F.concat(F.regexp_extract_all(part, F.lit(ASCII_TERMS), F.lit(1)), F.flatten(runs))
    whole = F.when(F.length(part).between(2, 32), F.array(part)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(part.rlike(f"^{ASCII_TERMS}$"), F.array(part))
        .when(part.rlike(f"{ASCII_TERMS}|{CHINESE_RUNS}"), mixed)
        .otherwise(whole)
    )


def tokenize_text(c: Column, max_tokens: int | None = None, distinct: bool = True) -> Column:
    """Mixed Chinese / Latin tokens of a text; ``distinct=False`` keeps repeats for term counts."""
    # parts hold neither white space nor capitals, so cleaning is a marker test and an edge trim
    present = F.filter(F.split(F.lower(normalize_value(c)), TEXT_SEPARATORS), lambda p: ~p.isin([*MISSING_MARKERS, NULL_MARKER.lower()]))
    parts = F.filter(F.transform(present, lambda p: F.btrim(p, F.lit(TOKEN_EDGE_CHARS))), lambda p: p != "")
    tokens = F.flatten(F.transform(parts, _part_candidates))
    return _capped(F.array_distinct(tokens) if distinct else tokens, max_tokens)


def _capped(tokens: Column, limit: int | None) -> Column:
    return tokens if limit is None else F.slice(tokens, 1, limit)


def squeeze_whitespace(c: Column) -> Column:
    """Single spaces between words; NULL becomes the empty string."""
    return F.regexp_replace(strip(c), rf"[{SPACE}]+", " ")


def join_non_empty(*parts: Column) -> Column:
    """Parts joined by one space, skipping empty ones."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def node_id(node_type: str | Column, value: Column) -> Column:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat(F.upper(kind), F.lit("::"), value)


def standard_name(c: Column) -> Column:
    """Standard title without bracketed text, edition or file suffix, and leading code."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)|（[^）]*）", "")
    text = F.regexp_replace(text, r"(?i)[-_]?(\d{4}年版|\d{6}|更新说明|\.pdf)$", "")
    text = F.regexp_replace(text, r"^\d-\d{2}-\d{2}-\d{2}-?", "")
    return F.lower(clean_token(text))


def task_phrases(c: Column) -> Column:
    """Phrases of 2 to 32 characters in a task description."""
    parts = _clean_parts(F.coalesce(c, F.lit("")), TASK_SEPARATORS, True)
    return F.filter(F.transform(parts, F.lower), lambda p: F.length(p).between(2, 32))


def escape_html(c: Column) -> Column:
    """The five characters that must not reach a page unescaped; the ampersand goes first."""
    for plain, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c
