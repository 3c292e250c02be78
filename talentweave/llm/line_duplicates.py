"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line is equal or at most one character edit away (a substitution, insertion or deletion);
earlier means smaller (doc_id, place in the text). What an earlier line's own fate is does not matter.

* Equal lines meet through 128 bits of hash; one aggregate finds each line's earliest place.
* One edit leaves a deletion variant in common: two lines of equal length that differ at place i are equal without their
  i-th character; a line is equal to another without its i-th character if that is the one inserted. The key of a variant
  is the hash of (kind, length, i, what is left of i, what is right of i).
* Emitting a variant for every character of every line would multiply the corpus. The same key is therefore taken first
  with a stretch of places in the place of i: first halves of the line, then parts of what remains, ``FAN`` at a time.
  A line whose key no other line shares has no neighbour with an edit in that stretch. Only the stretches left at
  ``LEAST`` places emit all their variants. No neighbour is lost by this.
* Equal variants are joined through their earliest line, never pair by pair, and each match is verified with
  ``levenshtein`` on the lines themselves.

Only lines of at least ``min_chars`` characters are matched by edits; shorter ones must be equal. Lines without a
visible character are left alone.

Defined cases: a null text has no lines and stays null; an empty text stays empty. Rows that repeat a doc_id and a text
are one document and lose the same lines; with other texts they are told apart by a checksum. A row without doc_id keeps
its lines and takes none from others. Extra columns come through ``without_duplicate_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FAN = 8
LEAST = 24
PLACE = "struct(doc_id, row, line_no)"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line) of lines with a visible character."""
    exploded = docs.where("doc_id is not null").select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.where(F.col("line").rlike(r"[^\x09-\x0D\x20]"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row", F.crc32(F.col("text").cast("binary")))


def _halves(lines: DataFrame, min_chars: int) -> DataFrame:
    """Keys of half lines: lines one edit apart share the first or the last half, by the shorter one's length."""
    size = F.col("size")
    keys = F.array_distinct(F.flatten(F.transform(
        F.array(F.floor(size / 2), F.floor((size - 1) / 2)),
        lambda n: F.array(
            F.struct(F.lit(0).alias("side"), F.xxhash64(F.lit("p"), n, F.substring(F.col("line"), F.lit(1), n.cast("int"))).alias("key")),
            F.struct(F.lit(1).alias("side"), F.xxhash64(F.lit("s"), n, F.substring(F.col("line"), (size - n + 1).cast("int"), n.cast("int"))).alias("key")),
        ),
    )))
    long = lines.withColumn("size", F.length("line")).where(F.col("size") >= min_chars)
    return long.select("doc_id", "row", "line_no", F.xxhash64("line").alias("a"), F.explode(keys).alias("k")).select("doc_id", "row", "line_no", "a", "k.side", "k.key")


def _key(start: Column, end: Column) -> Column:
    """Hash of a line without the places from start to end of the longer line's ``total`` places."""
    tail = (F.col("total") - end).cast("int")
    return F.xxhash64(
        F.col("role") == 0, F.col("total"), start, end, F.substring(F.col("line"), F.lit(1), (start - 1).cast("int")),
        F.when(tail > 0, F.substring(F.col("line"), (F.length("line") - tail + 1).cast("int"), tail)).otherwise(F.lit("")),
    )


def _candidates(lines: DataFrame, min_chars: int) -> DataFrame:
    """Earliest places of lines that share a half with another line: (doc_id, row, line_no, side)."""
    halves = _halves(lines, min_chars)
    shared = halves.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("key")
    met = halves.join(shared, "key").groupBy("a", "side").agg(F.expr(f"min({PLACE})").alias("p"))
    return met.select("p.*", "side")


def _stretches(found: DataFrame) -> DataFrame:
    """A row for each role a line can have: 0 substituted, 1 the longer, 2 the shorter line of an insertion."""
    size, side = F.length("line"), F.col("side")
    shorter = lambda total, cut: F.when(side == 0, F.floor(cut / 2) + 1).otherwise(1)
    role = lambda code, total, n: F.struct(
        F.lit(code).alias("role"), total.cast("long").alias("total"), shorter(total, n).cast("long").alias("lo"),
        F.when(side == 0, total).otherwise(total - F.floor(n / 2)).cast("long").alias("hi"),
    )
    roles = F.array(role(0, size, size), role(1, size, size - 1), role(2, size + 1, size))
    return found.withColumn("r", F.explode(roles)).select("doc_id", "row", "line_no", "line", "a", "r.*")


def _met(keyed: DataFrame) -> DataFrame:
    """Keys that can hold a pair: two lines of equal length, or a longer and a shorter one."""
    return keyed.groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.min("role").alias("few"), F.max("role").alias("many")).where(
        "low <> high and (few = 0 or few <> many)"
    ).select("key")


def _narrowed(rows: DataFrame) -> DataFrame:
    """Cut each stretch into FAN parts and keep the parts whose keys are met elsewhere."""
    width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / FAN))
    parts = rows.withColumn("width", width).withColumn("from", F.explode(F.sequence("lo", "hi", "width")))
    parts = parts.withColumn("lo", F.col("from")).withColumn("hi", F.least(F.col("hi"), F.col("from") + F.col("width") - 1)).drop("from", "width")
    keyed = parts.withColumn("key", _key(F.col("lo"), F.col("hi")))
    return keyed.join(_met(keyed), "key").drop("key")


def near_matches(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, row, line_no, earlier): earliest places of lines with an earlier line one edit away, that line's place."""
    lines = _lines(docs)
    found = cut_lineage(_candidates(lines, min_chars))
    wanted = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line_no", "side")).alias("wanted"))
    texts = docs.join(wanted, ["doc_id", "row"]).select("doc_id", "row", F.split("text", "\n").alias("own"), F.explode("wanted").alias("w"))
    texts = texts.select("doc_id", "row", "w.line_no", "w.side", F.element_at("own", F.col("w.line_no") + 1).alias("line"))
    rows = cut_lineage(_stretches(texts.distinct().withColumn("a", F.xxhash64("line"))))
    known = rows.select("doc_id", "row", "line_no", "line").distinct()
    widest = rows.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    while widest > LEAST:
        rows, widest = cut_lineage(_narrowed(rows)), -(-widest // FAN)
    variants = rows.select("doc_id", "row", "line_no", "a", "role", "total", "line", F.explode(F.sequence("lo", "hi")).alias("i"))
    variants = variants.select(F.expr(f"{PLACE} as p"), "a", "role", _key(F.col("i"), F.col("i")).alias("key")).distinct()
    kept = cut_lineage(variants.join(_met(variants), "key"))
    # a line's earliest match: among lines of its length, or among lines of the other length
    role = F.col("role")
    first = kept.groupBy("key").agg(*[F.min(F.when(role == r, F.col("p"))).alias(f"p{r}") for r in (0, 1, 2)])
    other = F.when(role == 0, F.col("p0")).when(role == 1, F.col("p2")).otherwise(F.col("p1"))
    pairs = kept.join(first, "key").withColumn("earlier", other).where("earlier < p").select("p", "earlier").distinct()
    one, two = known.alias("one"), known.select(F.expr(f"{PLACE} as earlier"), F.col("line").alias("earlier_line"))
    checked = pairs.select("p.*", "earlier").join(one, ["doc_id", "row", "line_no"]).join(two, "earlier")
    checked = checked.where(F.levenshtein("line", "earlier_line", 1).between(0, 1))
    return checked.groupBy("doc_id", "row", "line_no").agg(F.min("earlier").alias("earlier"))


def duplicate_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, row, line_no, near): the lines to go, with false for copies and true for lines one edit from an earlier one."""
    lines = _lines(docs).select("doc_id", "row", "line_no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"))
    first = lines.groupBy("a", "b").agg(F.expr(f"min({PLACE})").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    first = cut_lineage(first)  # so that the join is between two shuffles and a hot line's copies can be split
    copies = lines.join(first, ["a", "b"]).where(F.expr(f"first < {PLACE}")).select("doc_id", "row", "line_no", F.lit(False).alias("near"))
    return copies.union(near_matches(docs, min_chars).select("doc_id", "row", "line_no", F.lit(True)))


def _removals(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, lines): the places of a text's lines to go, and whether each is a near match."""
    # repeated rows name the same places
    gone = duplicate_lines(docs, min_chars).groupBy("doc_id", "row", "line_no").agg(F.min("near").alias("near"))
    return gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("line_no", "near"))).alias("gone"))


def line_report(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """doc_id, n_lines, n_copies, n_near and removed_lines (places from 0) of every row."""
    keyed = _keyed(docs.select("doc_id", "text"))
    gone = _removals(keyed, min_chars)
    rows = keyed.select("doc_id", "row", F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))), F.lit(0)).cast("long").alias("n_lines"))
    some = F.coalesce("gone", F.array().cast("array<struct<line_no:int,near:boolean>>"))
    return rows.join(gone, ["doc_id", "row"], "left").select(
        "doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"),
        F.size(F.filter(some, lambda x: ~x["near"])).cast("long").alias("n_copies"), F.size(F.filter(some, lambda x: x["near"])).cast("long").alias("n_near"),
        F.transform(some, lambda x: x["line_no"]).alias("removed_lines"),
    )


def without_duplicate_lines(docs: DataFrame, min_chars: int = 20, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with their duplicate lines taken out of ``text``; the other columns stay as they are.

    A text that loses every visible line becomes null, or its row goes where ``drop_emptied``; an untouched text stays.
    """
    inner = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in inner]).alias("_rest")) if inner else docs
    keyed = _keyed(packed)
    gone = _removals(keyed, min_chars)
    both = keyed.join(gone, ["doc_id", "row"], "left")
    left = F.filter(
        F.transform(F.split("text", "\n"), lambda line, i: F.when(~F.array_contains(F.transform("gone", lambda g: g["line_no"]), i), line)),
        lambda line: line.isNotNull(),
    )
    text = F.when(F.col("gone").isNull(), F.col("text")).when(F.exists(left, lambda x: x.rlike(r"[^\x09-\x0D\x20]")), F.array_join(left, "\n"))
    out = both.withColumn("text", text)
    if drop_emptied:
        out = out.where("text is not null or gone is null")
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])
