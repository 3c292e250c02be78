import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from talentweave.llm import conversation_repair as repair
from talentweave.llm.queries import QUERIES

LEGAL = {"s", "u", "a"}
BLANK = re.compile(r"[^\x20\x09-\x0d]")


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits: rows are (role, text, must go, truncated)."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (last, role[0]) in follow:
                    c, a, r = best(i, role[0], inserts + 1)
                    options.append((5 + c, "I" + a, ((role, ""), *r)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, r = best(i + 1, last, 0)
            options.append((2 + c, "D" + a, r))
            if not gone:
                if (last, role[:1]) in follow:
                    c, a, r = best(i + 1, role[0], 0)
                    options.append((5 * cut + c, "K" + a, ((role, text), *r)))
                for new in ("user", "assistant"):
                    if (last, new[0]) in follow:
                        c, a, r = best(i + 1, new[0], 0)
                        options.append((1 + 5 * cut + c, "R" + a, ((new, text), *r)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    return best(0, "", 0)


def expected(rows):
    """What the report should say about one conversation's rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, counts, marked = set(), [0, 0, 0], []
    for _, role, text in rows:
        ends = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not BLANK.search(text) else 1 if (role, text) in seen else 2 if ends[-1] not in ".!?" else None
        if fault is not None:
            counts[fault] += 1
        seen.add((role, text))
        marked.append((role, text, fault in (0, 1), fault == 2))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
    cost, audit, kept = cheapest(tuple(marked))
    text = "\n".join(f"{r}:{x}" for r, x in kept)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), kept


def conversation(rng, n):
    texts = ["Yes.", "No!", "why", "", " \n", "Same.", "A long one?  ", "unfinished", "x. \t", None, "\x85", "Ünï."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    return [(rng.choice([None, 3, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def made(seed, n=60):
    rng = random.Random(seed)
    out = {None: conversation(rng, 9)}
    for conv in range(n):
        out[conv] = conversation(rng, rng.choice([1, 1, 2, 3, 5, 8, 12]))
    for conv in (100, 101):  # well-formed, with some faults
        out[conv] = [(0, "system", "Be good.")] + [(t, ("assistant", "user")[t % 2], f"Turn {t}." if t % 7 else "cut") for t in range(1, 31)]
    return out


def check(spark, groups, partitions):
    rows = [(c, t, r, x, "clash") for c, g in groups.items() for t, r, x in g]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, audit string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(frame).collect()}
        repaired = {}
        for r in repair.repaired_rows(frame).orderBy("place").collect():
            repaired.setdefault(r.conv_id, []).append((r.role, r.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found.keys() == groups.keys()
    for conv, group in groups.items():
        want, kept = expected(group)
        assert found[conv] == want, (conv, group)
        assert repaired.get(conv, []) == list(kept)


@pytest.mark.parametrize(("seed", "partitions"), [(1, 3), (2, 40)])
def test_report_equals_all_edits_tried(spark, seed, partitions):
    check(spark, made(seed), partitions)


def test_a_conversation_over_many_parts(spark):
    # one conversation holds most rows; long stretches without a live row or with an undecided parity let shapes travel far
    rng = random.Random(7)
    hot = [(t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Ok.", "ok", f"Say {t}.", f"say {t}", ""])) for t in range(90)]
    other = [(t, "tool", f"Call {t}.") for t in range(70)]
    check(spark, {0: [(0, "user", "Hi.")], 1: hot, 2: other, 3: [(t, "user", f"cut {t}") for t in range(40)], 4: [(5, "user", "Same.")] * 50}, 25)


def test_pieces_run_again_only_until_they_agree():
    shapes, rng = repair.Shapes(), random.Random(3)
    for _ in range(200):
        kinds = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9, 17]) for _ in range(rng.randrange(1, 40)))
        guess = shapes.number(repair.FINAL)
        front = shapes.behind(kinds, guess)[-1]
        for vector in (repair.FINAL, (0, 0, 0, 0), (0, 5, 5, 1), (3, 1, 0, 2)):
            end = shapes.number(vector)
            assert shapes.again(kinds, end, guess, front) == shapes.behind(kinds, end)[-1]


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 0, 1, 2) for t, r, x in [(None, "user", None), *[(t, None if t == 4 else "assistant", f"Line. {t}?!") for t in range(30)]]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if fault:
            x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
            want += [(c, t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in repair.damaged(frame).collect()))) == sorted(map(str, want))


def test_query_on_the_given_table(spark, small_dir):
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, small_dir).collect()}
    given = spark.read.parquet(f"{small_dir}/conversations.parquet")
    groups = {r.conv_id: [] for r in given.select("conv_id").distinct().collect()}
    for r in repair.damaged(given).collect():
        groups[r.conv_id].append((r.turn, r.role, r.text))
    assert found == {c: expected(g)[0] for c, g in groups.items()}


def test_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(repair.damaged(none), none).count() == 0
    ids = none.sparkSession.range(2).select(F.col("id").alias("conv_id"))
    assert {tuple(r) for r in repair.repair_report(none, ids).collect()} == {(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in range(2)}
