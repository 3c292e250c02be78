"""Skill vocabulary: quality gate, vocabulary build, dictionary matching of job texts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_token, split_tags
from ..session import broadcast_if_small, cut_lineage, spread
from .ordering import first_occurrence, global_position, top_per_group

# ---- fixed values ---------------------------------------------------------------------------
# Latin-script skills that may be shorter than the minimum length.
SHORT_ENGLISH = [
    "ai", "bi", "c", "c#", "c++", "cv", "go", "hr", "js", "ml",
    "nlp", "oa", "os", "pm", "qa", "qc", "r", "ts", "ui", "ux",
]
# Words that are never a skill.
DROP_TERMS = [
    "or", "ex", "cc", "em", "自我评价", "协助", "客户", "材料", "资料", "学历",
    "经理", "员工", "福利", "管理", "管理工作", "工作", "岗位", "职位", "职责", "任职",
    "要求", "经验", "相关", "以上", "优先", "熟悉", "负责", "参与", "完成",
]
# Soft skills that are kept with a lower weight.
TRANSVERSAL_TERMS = [
    "沟通", "沟通能力", "协调", "协调能力", "组织", "组织能力", "计划", "计划能力", "团队", "团队合作",
    "团队协作", "团队领导", "领导", "执行", "执行力", "责任心", "服务意识", "学习能力", "抗压能力", "表达能力",
    "办公",
]
TYPE_WEIGHTS = {"hard_or_knowledge": 1.0, "reference_task": 1.0, "transversal": 0.35, "unknown": 0.7}
ENGLISH_MIN_LENGTH = 3
# Latin-script tokens after lower-casing, and the characters that may not touch a match of one.
ASCII_SKILL = r"^[a-z0-9+.#\-]+$"
BOUNDARY_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789+#."
# ---------------------------------------------------------------------------------------------

OCCUPATION_KINDS = ["occupation", "category", "work_type"]
TASK_KINDS = ["task", "standard"]


@dataclass(frozen=True)
class SkillGate:
    """Rules that decide which tokens are skills and how much a match weighs."""

    enabled: bool = True
    english_min_len: int = ENGLISH_MIN_LENGTH
    strict_ascii_boundaries: bool = True
    drop_occupation_terms: bool = True
    short_english: list[str] = field(default_factory=lambda: list(SHORT_ENGLISH))
    drop_terms: list[str] = field(default_factory=lambda: list(DROP_TERMS))
    transversal_terms: list[str] = field(default_factory=lambda: list(TRANSVERSAL_TERMS))
    type_weights: dict[str, float] = field(default_factory=lambda: dict(TYPE_WEIGHTS))

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any] | None) -> SkillGate:
        """Gate from a configuration section; an empty section switches it off."""
        if not raw:
            return cls(enabled=False)
        names = {"short_english_allowlist": "short_english"}
        known = {names.get(k, k): v for k, v in raw.items() if names.get(k, k) in cls.__dataclass_fields__}
        if "type_weights" in known:
            known["type_weights"] = {**TYPE_WEIGHTS, **known["type_weights"]}
        return cls(**known)


def gate_terms(spark: SparkSession, gate: SkillGate) -> DataFrame:
    """(kind, term) rows of the configured lists, cleaned the same way as the tokens they meet."""
    lists = {"short_english": gate.short_english, "drop": gate.drop_terms, "transversal": gate.transversal_terms}
    rows = [(kind, term) for kind, terms in lists.items() for term in terms]
    return spark.createDataFrame(rows, "kind string, term string").select("kind", F.lower(clean_token(F.col("term"))).alias("term"))


def gate_decisions(tokens: DataFrame, gate: SkillGate, reference: DataFrame | None = None) -> DataFrame:
    """Add keep, skill_type, weight and reason to distinct ``token`` rows.

    ``reference`` holds (kind, term). Rules apply in a fixed order and the first that fits decides.
    """
    terms = gate_terms(tokens.sparkSession, gate)
    if reference is not None:
        terms = terms.unionByName(reference.select("kind", "term"))
    groups = {"_short": ["short_english"], "_drop": ["drop"], "_transversal": ["transversal"], "_occupation": OCCUPATION_KINDS, "_task": TASK_KINDS}
    flags = [F.max(F.col("kind").isin(kinds)).alias(name) for name, kinds in groups.items()]
    known = terms.groupBy(F.col("term").alias("_key")).agg(*flags)
    rows = tokens.withColumn("_key", F.lower(clean_token(F.col("token"))))
    rows = rows.join(broadcast_if_small(known), "_key", "left").fillna(False, list(groups))
    key, w = F.col("_key"), gate.type_weights
    short = key.rlike(ASCII_SKILL) & (F.length(key) < gate.english_min_len) & ~F.col("_short")

    def decision(keep: bool, skill_type: str, weight: float, reason: str = "") -> Column:
        return F.struct(
            F.lit(keep).alias("keep"), F.lit(skill_type).alias("skill_type"),
            F.lit(float(weight)).alias("weight"), F.lit(reason).alias("reason"),
        )

    rules = [
        (F.lit(not gate.enabled), decision(True, "unknown", 1.0)),
        (key == "", decision(False, "empty", 0.0, "empty")),
        (short, decision(False, "english_noise", 0.0, "short_english")),
        (F.col("_drop"), decision(False, "generic_non_skill", 0.0, "drop_term")),
        (F.lit(gate.drop_occupation_terms) & F.col("_occupation"),
         decision(False, "occupation_or_job_type", 0.0, "occupation_reference")),
        (F.col("_transversal"), decision(True, "transversal", w.get("transversal", 0.35), "transversal_downweight")),
        (F.col("_task"), decision(True, "reference_task", w.get("reference_task", 1.0), "standard_reference")),
    ]
    verdict = decision(True, "hard_or_knowledge", w.get("hard_or_knowledge", 1.0))
    for condition, outcome in reversed(rules):
        verdict = F.when(condition, outcome).otherwise(verdict)
    return rows.withColumn("_d", verdict).select(*tokens.columns, "_d.*")


REFERENCE_KINDS = ("occupation", "category", "work_type", "standard", "task")


def gate_summary(gate: SkillGate, reference: DataFrame) -> DataFrame:
    """(item, count): whether the gate is on, reference terms of every kind, and sizes of the configured lists."""
    counted = reference.groupBy("kind").agg(F.count(F.lit(1)).alias("_n"))
    kinds = reference.sparkSession.createDataFrame([(k,) for k in REFERENCE_KINDS], "kind string").join(counted, "kind", "full")
    terms = kinds.select(F.concat(F.lit("reference_"), F.col("kind")).alias("item"), F.coalesce("_n", F.lit(0)).alias("count"))
    sizes = {"enabled": int(gate.enabled), "drop_terms": len(gate.drop_terms), "transversal_terms": len(gate.transversal_terms),
             "english_min_len": gate.english_min_len}
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.lit(v).cast("long").alias("count")) for k, v in sizes.items()]))
    return terms.union(reference.sparkSession.range(1).select(listed.alias("_s")).select("_s.*"))


def user_tags(users: DataFrame, experience: str = "experience") -> DataFrame:
    """(user_id, pos, tag) rows of a tag field."""
    return users.select("user_id", F.posexplode_outer(split_tags(F.col(experience))).alias("pos", "tag")).where("tag is not null")


def weighted_vocabulary(tags: DataFrame, min_count: int = 2, gate: SkillGate | None = None,
                        reference: DataFrame | None = None) -> DataFrame:
    """(skill, skill_id, freq, weight): tags of at least ``min_count`` rows that pass the gate, with its weight; ids in
    lexicographic order.

    The gate judges each distinct frequent tag once.
    """
    frequent = tags.groupBy(F.col("tag").alias("token")).agg(F.count(F.lit(1)).alias("freq"))
    frequent = frequent.where(F.col("freq") >= min_count)
    if gate is not None and gate.enabled:
        frequent = gate_decisions(frequent, gate, reference).where("keep")
    else:
        frequent = frequent.withColumn("weight", F.lit(1.0))
    numbered = global_position(frequent.select(F.col("token").alias("skill"), "freq", "weight"), ["skill"], "skill_id")
    return numbered.select("skill", F.col("skill_id").cast("int").alias("skill_id"), "freq", "weight")


def build_vocabulary(tags: DataFrame, min_count: int = 2, gate: SkillGate | None = None,
                     reference: DataFrame | None = None) -> DataFrame:
    """(skill, skill_id, freq): the vocabulary without the gate's weights."""
    return weighted_vocabulary(tags, min_count, gate, reference).drop("weight")


def ids_of_tags(tags: DataFrame, vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    """(user_id, skill_ids): vocabulary ids of a user's tags in tag order, all of them or at most ``limit``."""
    found = tags.join(broadcast_if_small(vocabulary.select(F.col("skill").alias("tag"), "skill_id")), "tag")
    if limit is not None:
        found = top_per_group(found, ["user_id"], [F.asc("pos")], limit, "_n")
    return found.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "skill_id"))), lambda e: e["skill_id"]).alias("skill_ids")
    )


# Positions of a text whose fingerprints are held at once.
PIECE_CHARS = 1 << 16
# Odd base of the polynomial fingerprints modulo 2**64, and its inverse.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Fingerprints:
    """Fingerprints of all substrings of a text, from prefix sums of a polynomial over its code points."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def prefixes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(self.up) <= len(codes):
            size = 1 << len(codes).bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b), dtype=np.uint64)]) for b in (_BASE, _INVERSE))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.up[: len(codes)], out=sums[1:])
        return sums

    def of_length(self, sums: np.ndarray, n: int, bits: int) -> np.ndarray:
        """The upper bits of the fingerprint of each substring of ``n`` characters."""
        count = max(len(sums) - n, 0)
        value = (sums[n:] - sums[:count]) * self.down[:count]
        value ^= value >> np.uint64(32)
        return value * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)


def _term_bitmaps(terms: DataFrame) -> tuple[dict[int, np.ndarray], int]:
    """A bitmap of the terms' fingerprints for each term length, and the bits of a place in it.

    A bitmap has about 16 bits a term, at most 2**26; as many rows of 64 bits at most reach the driver for each length.
    """
    bits = min(max((16 * terms.count()).bit_length(), 16), 26)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Fingerprints()
        for batch in batches:
            found = [(len(t), int(own.of_length(own.prefixes(t), len(t), bits)[0])) for t in batch.column("term").to_pylist()]
            if found:
                n, place = (np.array(c, np.int64) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(place >> 6), pa.array(place & 63)], ["n", "word", "bit"])

    rows = terms.select("term").mapInArrow(places, "n int, word bigint, bit bigint")
    words = rows.groupBy("n", "word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("mask")).toPandas()
    bitmaps = {}
    for n, own in words.groupby("n"):
        bitmaps[int(n)] = np.zeros(1 << bits - 6, np.uint64)
        bitmaps[int(n)][own["word"].to_numpy()] = own["mask"].to_numpy(np.int64).view(np.uint64)
    return bitmaps, bits


def match_dictionary(fields: DataFrame, vocabulary: DataFrame, strict_boundaries: bool = True) -> DataFrame:
    """(id, skill_id, score): weighted occurrences of every vocabulary term in every text field.

    ``fields`` holds (id, text, field_weight), one row per field; ``vocabulary`` (skill, skill_id, weight).
    All occurrences count, overlapping ones too, at ``weight * field_weight * (1 + 0.1 * length)``. A
    Latin-script term must not touch a Latin letter, a digit or one of ``+ # .``.

    Prefix sums of a polynomial give the fingerprint of every substring of a text. Only substrings whose fingerprint is in
    the bitmap of their length leave their text, by themselves; they meet the vocabulary on the whole term, which settles
    chance hits. No text is carried along, and a frequent prefix costs nothing. Fingerprints of a long text are made for
    stretches of ``PIECE_CHARS`` positions at a time.
    """
    terms = vocabulary.select(F.lower("skill").alias("term"), "skill_id", "weight").where(F.length("skill") > 0)
    terms = cut_lineage(first_occurrence(terms, ["term"], "skill_id", last=True).withColumn("ascii", F.col("term").rlike(ASCII_SKILL)))
    bitmaps, bits = _term_bitmaps(terms)
    shared = fields.sparkSession.sparkContext.broadcast(bitmaps)
    piece, longest = PIECE_CHARS, max(bitmaps, default=1)
    lowered = spread(fields, "id").select("id", F.col("field_weight").cast("double").alias("field_weight"), F.lower("text").alias("text")).where(F.length("text") >= 2)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table, touching = _Fingerprints(), shared.value, frozenset(BOUNDARY_CHARS)
        for batch in batches:
            row, found, free = [], [], []
            stretches = ((i, text, start) for i, text in enumerate(batch.column("text").to_pylist()) for start in range(0, len(text), piece))
            for i, text, start in stretches:
                sums = own.prefixes(text[start : start + piece + longest - 1])
                for n, bitmap in table.items():
                    place = own.of_length(sums, n, bits)[:piece]
                    hits = np.flatnonzero(bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)) + start
                    for at in hits.tolist():
                        row.append(i)
                        found.append(text[at : at + n])
                        free.append((at == 0 or text[at - 1] not in touching) and (at + n == len(text) or text[at + n] not in touching))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("field_weight").take(take), pa.array(found, pa.string()), pa.array(free, pa.bool_())], ["id", "field_weight", "term", "free"])

    kind = lowered.schema["id"].dataType.simpleString()
    met = lowered.mapInArrow(candidates, f"id {kind}, field_weight double, term string, free boolean")
    # each term is one vocabulary row, so the join never yields more rows than there are candidates
    matched = met.join(broadcast_if_small(terms.select("term", "skill_id", "weight", "ascii")), "term")
    if strict_boundaries:
        matched = matched.where(~F.col("ascii") | F.col("free"))
    value = F.col("weight") * F.col("field_weight") * (1.0 + 0.1 * F.length("term"))
    return matched.groupBy("id", "skill_id").agg(F.round(F.sum(value), 9).alias("score"))


def text_fields(jobs: DataFrame, title_weight: float = 2.0, max_chars: int | None = None) -> DataFrame:
    """(id, text, field_weight) rows of job titles and descriptions."""
    description = F.col("description") if max_chars is None else F.substring("description", 1, max_chars)
    parts = F.array(
        F.struct(F.col("title").alias("text"), F.lit(float(title_weight)).alias("field_weight")),
        F.struct(description.alias("text"), F.lit(1.0).alias("field_weight")),
    )
    return jobs.select(F.col("job_id").alias("id"), F.explode(parts).alias("_f")).select("id", "_f.*")


def top_skills(matches: DataFrame, max_skills: int | None = None) -> DataFrame:
    """(id, skill_ids, skill_weights): skills of each text, best first, all or ``max_skills``; weights have 3 digits."""
    best = matches
    if max_skills is not None:
        best = top_per_group(matches, ["id"], [F.desc("score"), F.asc("skill_id")], max_skills)
    listed = best.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("place"), "skill_id", F.round("score", 3).alias("weight")))).alias("_s")
    )
    return listed.select("id", F.col("_s.skill_id").alias("skill_ids"), F.col("_s.weight").alias("skill_weights"))
