"""Field parsers: degree ordinal, work years, behaviour level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_value

# ---- fixed values ---------------------------------------------------------------------------
# Degree labels in rank order, 1 to 8; the first one found in the text wins.
DEGREE_LABELS = ["初中", "高中", "中专", "大专", "本科", "硕士", "MBA", "博士"]
# Flag values that mean "yes".
TRUTHY_FLAGS = ["1", "1.0", "true", "True"]
STRICT_FLAGS = ["1"]
# Behaviour edge weights.
BEHAVIOUR_WEIGHTS = {"browsed": 1.0, "delivered": 5.0, "satisfied": 10.0}
# ---------------------------------------------------------------------------------------------


def degree_rank(c: Column) -> Column:
    """Ordinal of a degree label, 0 when none is named."""
    text = F.lower(normalize_value(c))
    rank = F.lit(0)
    for position in range(len(DEGREE_LABELS), 0, -1):
        rank = F.when(F.instr(text, DEGREE_LABELS[position - 1].lower()) > 0, position).otherwise(rank)
    return rank.cast("int")


def parse_years(c: Column, as_of_year: int) -> Column:
    """Work years: a calendar year becomes an age in years, numbers above 100 are hundredths."""
    digits = F.regexp_extract(F.translate(normalize_value(c), "０１２３４５６７８９", "0123456789"), r"(\d+)", 1)
    raw = F.nullif(digits, F.lit("")).cast("double")
    years = (
        F.when(raw.between(1900, 2100), F.greatest(F.lit(0.0), F.lit(float(as_of_year)) - raw))
        .when(raw > 100, raw / 100.0)
        .otherwise(raw)
    )
    return F.coalesce(years, F.lit(0.0))


def flag_is_set(c: Column, strict: bool = False) -> Column:
    """Strict flags accept the raw cell ``1`` only; otherwise the cell is normalized first."""
    if strict:
        return F.coalesce(c, F.lit("")).isin(STRICT_FLAGS)
    return normalize_value(c).isin(TRUTHY_FLAGS)


def behaviour_level(browsed: Column, delivered: Column, satisfied: Column, strict: bool = False) -> Column:
    """3 satisfied, 2 delivered, 1 browsed, else 0."""
    return (
        F.when(flag_is_set(satisfied, strict), 3)
        .when(flag_is_set(delivered, strict), 2)
        .when(flag_is_set(browsed, strict), 1)
        .otherwise(0)
        .cast("int")
    )
