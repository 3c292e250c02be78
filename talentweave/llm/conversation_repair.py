"""Repair of conversation structure by least-cost edits: Viterbi decoding in pieces that start from guessed cost vectors.

A conversation should read ``(s?(ua)+)?`` in role initials (system, user, assistant). Edits: Keep costs 0, Rerole (to user
or assistant) 1, Delete 2 (a blank row or a duplicate must go), Insert an empty user or assistant row 5; a truncated row
that stays adds 5. The audit is the initials of the cheapest edits, the least in ASCII order among equally cheap ones.

* Costs run backwards: a vector of four costs, one for each state of the pattern, says what the rest of a conversation
  costs. Only differences within a vector decide, and few shapes (vectors without their constant) ever occur, so a step is
  a look-up by shape and row kind.
* Rows lie in range partitions by conversation and turn, so a conversation of any length is spread over many tasks. A
  conversation inside one partition is decoded there. One that lies across partitions has a piece in each: all its pieces
  start side by side from a speculative vector, that of a conversation's end. Fix-up passes then hand each piece its
  right neighbour's vector; a piece runs again from its end until its vector and that of its earlier run differ only by a
  constant, from where the earlier run holds. A shape that still travels is asked of all pieces to its left at once, so
  there are about as many passes as shapes, not pieces. What the driver stitches is at most two pieces a partition.
* With the vectors stitched, the pieces map states to states, which gives each piece its first state, and a last pass
  traces: at each place the least of D, I, K, R that keeps to the cheapest cost.

Order of rows: by turn (null first), then role, then MD5 of the text; equal rows are adjacent. Equal rows are one row with
a number of copies, so one that is repeated without end is no hot key.

Defined cases: a null role or text is one space; a role is taken by its first character, as written. Rows of a null
conversation id form one conversation. An empty text is blank. Empty tables give no rows; extra columns are ignored.
SHA-256 is a chain, so one task hashes a conversation, but it streams sorted rows and holds none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (0, 10, 5, 0)  # cheapest end from each state: by inserted rows alone
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_EXPECTED = (USER, USER, ASSISTANT, USER)
_BLANKS = " \t\n\x0b\x0c\r"
# bits of a row's kind, above the two of its role's initial (0 system, 1 user, 2 assistant, 3 other)
_CUT, _LATER, _BLANK = 4, 8, 16
_KEPT_AS = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})


class Shapes:
    """Cost vectors without their constant, numbered; steps and decisions are worked out once for each shape and kind."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.before: dict[tuple[int, int], int] = {}
        self.moves: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def number(self, vector: tuple[int, ...]) -> int:
        vector = tuple(v - min(vector) for v in vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    @staticmethod
    def _step(after: tuple[int, ...], kind: int) -> list[int]:
        """Costs in front of a live row from the costs behind it."""
        extra = TRUNCATED if kind & _CUT else 0
        costs = [DELETE + v for v in after]
        for state, expected in enumerate(_EXPECTED):
            costs[state] = min(costs[state], REROLE + extra + after[expected])
            if state in (keeps := _KEPT_AS[kind & 3]):
                costs[state] = min(costs[state], KEEP + extra + after[keeps[state]])
        for _ in range(2):  # two inserted rows lead from any state to any useful one
            costs = [min(c, INSERT + costs[e]) for c, e in zip(costs, _EXPECTED, strict=True)]
        return costs

    def step(self, after: int, kind: int) -> int:
        """The shape in front of a row. A row that must go adds the same to all costs."""
        if kind & (_LATER | _BLANK):
            return after
        found = self.before.get((after, kind))
        if found is None:
            found = self.before[after, kind] = self.number(tuple(self._step(self.vectors[after], kind)))
        return found

    def move(self, after: int, kind: int, state: int) -> tuple[str, int, int]:
        """(edits at a row in this state, next state, their cost): the least audit among the cheapest."""
        if kind & (_LATER | _BLANK):
            return "D", state, DELETE
        key = (after, kind, state)
        if key not in self.moves:
            behind, audit, cost = self.vectors[after], "", 0
            costs, extra = self._step(behind, kind), TRUNCATED if kind & _CUT else 0
            while True:
                expected, kept = _EXPECTED[state], _KEPT_AS[kind & 3].get(state)
                if costs[state] == DELETE + behind[state]:
                    found = (audit + "D", state, cost + DELETE)
                elif costs[state] == INSERT + costs[expected]:
                    audit, state, cost = audit + "I", expected, cost + INSERT
                    continue
                elif kept is not None and costs[state] == KEEP + extra + behind[kept]:
                    found = (audit + "K", kept, cost + KEEP + extra)
                else:
                    found = (audit + "R", expected, cost + REROLE + extra)
                self.moves[key] = found
                break
        return self.moves[key]

    def behind(self, kinds: bytes, end: int) -> list[int]:
        """The shape behind each row, and in front of the first one last."""
        out = [end]
        for kind in reversed(kinds):
            out.append(self.step(out[-1], kind))
        return out

    def again(self, kinds: bytes, end: int, earlier_end: int, earlier_front: int) -> int:
        """Front shape for another end: run until it meets the earlier run, which holds from there."""
        for kind in reversed(kinds):
            if end == earlier_end:
                return earlier_front
            end, earlier_end = self.step(end, kind), self.step(earlier_end, kind)
        return end

    def trace(self, kinds: bytes, copies: list[int], end: int, state: int) -> tuple[str, int, int]:
        """(audit, last state, cost) of a piece that is entered in ``state`` and followed by shape ``end``."""
        after, audit, cost = self.behind(kinds, end), [], 0
        after.pop()
        for kind, n in zip(kinds, copies, strict=True):
            letters, state, own = self.move(after.pop(), kind, state)
            audit.append(letters)
            cost += own
            if n > 1:  # further copies are duplicates
                audit.append("D" * (n - 1))
                cost += DELETE * (n - 1)
        return "".join(audit), state, cost


def closing(state: int) -> tuple[str, int]:
    """Inserted rows that end a conversation left in this state, and their cost."""
    n = FINAL[state] // INSERT
    return "I" * n, n * INSERT


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    ``[.!?]``, 3 repeats it, 4 makes it the user's. Nulls are one space there and in role and text."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault, text = F.crc32(key.cast("binary")) % 20, F.coalesce(F.col("text"), space)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")


def _plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, said (MD5 of the text) of every row, without nulls in the last three."""
    space = F.lit(" ")
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return own.withColumn("said", F.unhex(F.md5(F.col("text").cast("binary"))))


def _kinds(plain: DataFrame) -> DataFrame:
    """Distinct rows in order, with ``kind`` and ``copies``, in range partitions; ``part`` numbers the partitions."""
    ends = _trimmed(F.col("text"))
    flags = plain.select("conv_id", "turn", "role", "said", (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"))
    rows = cut_lineage(flags.groupBy("conv_id", "turn", "role", "said").agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    # only texts said in several turns are looked up; written, so that the join is between two shuffles and can be split
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    several = rows.where("not blank").groupBy("conv_id", "role", "said").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    several = cut_lineage(several.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("said").alias("_said"), "_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("said") == F.col("_said"))
    later = F.coalesce(~F.col("_first.turn").eqNullSafe(F.col("turn")), F.lit(False)) & F.col("_first").isNotNull()
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = kind + F.when(F.col("cut"), _CUT).otherwise(0) + F.when(later, _LATER).otherwise(0) + F.when(F.col("blank"), _BLANK).otherwise(0)
    found = rows.join(several, same, "left").select("conv_id", "turn", "role", "said", kind.cast("int").alias("kind"), "copies")
    keys = ("conv_id", "turn", "role", "said")
    found = found.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "kind", "copies")
    return cut_lineage(found).withColumn("part", F.spark_partition_id())


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """(conv_id, kinds, the other columns' values) of each run of rows of one conversation; rows come in order."""
    now, kinds, rest, none = None, bytearray(), [[] for _ in columns], True
    for batch in batches:
        ids, own = batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist()
        others = [batch.column(c).to_pylist() for c in columns]
        cuts = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
        for low, high in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if low == high:
                continue
            if not none and ids[low] != now:
                yield now, bytes(kinds), *rest
                kinds, rest = bytearray(), [[] for _ in columns]
            now, none = ids[low], False
            kinds += bytes(own[low:high])
            for have, more in zip(rest, others, strict=True):
                have += more[low:high]
    if not none:
        yield now, bytes(kinds), *rest


def _spread(kinds: DataFrame) -> list[list[tuple[int, object]]]:
    """The pieces (part, conv_id) of each conversation that lies in several parts, in order; from two rows a part."""
    order = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")
    ends = sorted(kinds.groupBy("part").agg(F.min(order).alias("low"), F.max(order).alias("high")).collect(), key=lambda r: r.part)
    runs: list[list[tuple[int, object]]] = []
    open_run: list[tuple[int, object]] = []
    for row in ends:
        low, high = row.low.conv_id, row.high.conv_id
        if open_run and open_run[-1][1] == low:
            open_run.append((row.part, low))
        if not open_run or open_run[-1] != (row.part, high):
            if len(open_run) > 1:
                runs.append(open_run)
            open_run = [(row.part, high)]
    if len(open_run) > 1:
        runs.append(open_run)
    return runs


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of a schema of longs and strings."""
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return [(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))]


def _of_pieces(kinds: DataFrame, pieces: list[tuple], work: Callable, schema: str) -> list:
    """``work(conv_id, kinds, turns, note)`` of the named pieces (part, conv_id, note); what it yields is collected."""
    kind = kinds.schema["conv_id"].dataType.simpleString()
    named = F.broadcast(kinds.sparkSession.createDataFrame(pieces, f"_part int, _conv {kind}, note string"))
    own = kinds.join(named, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")))

    fields = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, codes, turns, parts, notes in _grouped(batches, ("turn", "part", "note")):
            found = work(conv, codes, turns, parts[0], notes[0])
            yield pa.RecordBatch.from_arrays([pa.array([found[name]], kind) for name, kind in fields], [name for name, _ in fields])

    return own.select("conv_id", "turn", "kind", "part", "note").mapInArrow(run, schema).collect()


def _text(vector: tuple[int, ...]) -> str:
    return ",".join(map(str, vector))


def _vector(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def _stitched(kinds: DataFrame) -> list[tuple]:
    """(part, conv_id, end shape, first state, last initial and turn before, whether it ends the conversation) of each piece.

    Every collected list is of pieces: at most two a part, however long a conversation is.
    """
    runs = _spread(kinds)
    if not runs:
        return []
    guess = _text(FINAL)

    def speculative(conv, codes, turns, part, note) -> dict:
        shapes = Shapes()
        front = shapes.behind(codes, shapes.number(FINAL))[-1]
        return {"part": part, "front": _text(shapes.vectors[front]), "turn": turns[-1], "initial": codes[-1] & 3, "first": turns[0]}

    schema = "part bigint, front string, turn bigint, initial bigint, first bigint"
    # a part's first piece ends a run, its last one starts one; a part inside a run has one piece, so (part, run) is unique
    place = {}
    for run in runs:
        for i, (part, conv) in enumerate(run):
            place[part, "last" if i == 0 else "first"] = (part, conv)
    named = [(part, conv, side) for (part, side), (_, conv) in place.items()]

    def with_side(work):
        def run(conv, codes, turns, part, note):
            return {"side": note.split(";")[0], **work(conv, codes, turns, part, note)}

        return run

    found = {(r.part, r.side): r for r in _of_pieces(kinds, named, with_side(speculative), "side string, " + schema)}
    side = lambda i: "last" if i == 0 else "first"
    fronts = {key: {guess: r.front} for key, r in found.items()}
    while True:
        wanted: dict[tuple[int, str], str] = {}
        ends: dict[tuple[int, str], str] = {}
        for run in runs:
            need, missing = guess, False
            for i in range(len(run) - 1, -1, -1):
                key = (run[i][0], side(i))
                if not missing:
                    ends[key] = need
                if need in fronts[key]:
                    need = need if missing else fronts[key][need]
                else:  # ask this piece and all to its left for this shape
                    wanted[key], missing = need, True
        if not wanted:
            break

        def fix_up(conv, codes, turns, part, note) -> dict:
            _, end, earlier_end, earlier_front = note.split(";")
            shapes = Shapes()
            front = shapes.again(codes, *(shapes.number(_vector(v)) for v in (end, earlier_end, earlier_front)))
            return {"part": part, "front": _text(shapes.vectors[front])}

        asked = [(key[0], place[key][1], ";".join((key[1], end, guess, fronts[key][guess]))) for key, end in wanted.items()]
        for r in _of_pieces(kinds, asked, with_side(fix_up), "side string, part bigint, front string"):
            fronts[r.part, r.side][wanted[r.part, r.side]] = r.front

    def states(conv, codes, turns, part, note) -> dict:
        shapes = Shapes()
        end, one = shapes.number(_vector(note.split(";")[1])), [1] * len(codes)
        return {"part": part, "out": ",".join(str(shapes.trace(codes, one, end, s)[1]) for s in range(4))}

    asked = [(key[0], place[key][1], f"{key[1]};{end}") for key, end in ends.items()]
    maps = {(r.part, r.side): _vector(r.out) for r in _of_pieces(kinds, asked, with_side(states), "side string, part bigint, out string")}
    out = []
    for run in runs:
        state, initial, turn = START, None, None
        for i, (part, conv) in enumerate(run):
            key = (part, side(i))
            out.append((part, conv, ends[key], state, initial, turn, i == len(run) - 1))
            state, initial, turn = maps[key][state], found[key].initial, found[key].turn
    return out


def _counts(kinds: bytes, copies: list[int], turns: list, before: int | None, turn_before) -> dict:
    """Faults of a piece; ``before`` and ``turn_before`` belong to the row in front of it."""
    blank = duplicate = truncated = illegal = n_turns = 0
    for kind, n, turn in zip(kinds, copies, turns, strict=True):
        if kind & _BLANK:
            blank += n
        else:
            duplicate += n if kind & _LATER else n - 1
            truncated += 1 if kind & _CUT and not kind & _LATER else 0
        initial = kind & 3
        illegal += n - 1
        if before is not None and (before, initial) not in ((0, 1), (1, 2), (2, 1)):
            illegal += 1
        before = initial
        if turn is not None and turn != turn_before:
            n_turns += 1
        turn_before = turn
    return {"blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "n_turns": n_turns}


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def audits(plain: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation with rows."""
    kinds = _kinds(plain)
    kind = kinds.schema["conv_id"].dataType.simpleString()
    pieces = _stitched(kinds)
    named = f"_part int, _conv {kind}, shape string, state int, initial int, turn_before bigint, ends boolean"
    note = F.broadcast(kinds.sparkSession.createDataFrame(pieces, named))  # at most two rows a part
    own = kinds.join(note, (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    columns = ("copies", "turn", "part", "shape", "state", "initial", "turn_before", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, rows, id_type = Shapes(), [], None

        def typed(batches):
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("conv_id").type
                yield batch

        def emitted():
            names = ("conv_id", "part", "audit", "cost", "blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high")
            types = (id_type, pa.int32(), pa.string(), *[pa.int64()] * 8)
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for conv, codes, copies, turns, parts, shape, state, initial, turn_before, ends in _grouped(typed(batches), columns):
            whole = shape[0] is None
            end = shapes.number(FINAL if whole else _vector(shape[0]))
            audit, last, cost = shapes.trace(codes, copies, end, START if whole else state[0])
            if whole or ends[0]:
                letters, more = closing(last)
                audit, cost = audit + letters, cost + more
            known = [t for t in (turns[-1], next((t for t in turns if t is not None), None)) if t is not None]
            counts = _counts(codes, copies, turns, initial[0], turn_before[0])
            rows.append({"conv_id": conv, "part": parts[0], "audit": audit, "cost": cost, **counts, "low": min(known, default=None), "high": max(known, default=None)})
            if len(rows) == 4096:
                yield emitted()
                rows = []
        if rows:
            yield emitted()

    schema = f"conv_id {kind}, part int, audit string, " + ", ".join(f"{c} bigint" for c in ("cost", "blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high"))
    found = own.select("conv_id", "kind", *columns).mapInArrow(run, schema)
    parts = F.array_sort(F.collect_list(F.struct("part", "audit")))  # a conversation's pieces: one a part
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("n_turns"), F.lit(0)).alias("gaps")
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    return found.groupBy("conv_id").agg(gaps, *sums, F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))


def _applied(rows: DataFrame, notes: DataFrame, begin: Callable, schema: str) -> DataFrame:
    """Stream each conversation's rows behind its audit and hand the repaired rows to ``begin(batch row of the audit)``.

    ``begin`` gives (take(role, text), end()) for a conversation; both yield output rows as tuples.
    """
    extra = [c for c in notes.columns if c != "conv_id"]
    keys = ("conv_id", "_kind", "turn", "role", "said")
    marks = notes.select("conv_id", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("said"), F.lit(None).cast("string").alias("text"), *extra)
    said = rows.select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "said", "text", *[F.lit(None).cast(notes.schema[c].dataType).alias(c) for c in extra])
    dealt = marks.unionByName(said).repartition("conv_id").sortWithinPartitions(*keys).drop("turn", "said")
    roles = {USER: "user", ASSISTANT: "assistant"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, take, end, out, types = "", 0, START, None, None, [], None

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, _EXPECTED[state]
                out.extend(take(roles[state], ""))

        def emitted():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        names = [f.split(" ")[0] for f in schema.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, held = batch.column("_kind").to_pylist(), {c: batch.column(c) for c in ["conv_id", *extra]}
            if types is None:
                types = [batch.column("conv_id").type, *[kind for _, kind in _fields(", ".join(schema.split(", ")[1:]))]]
            for i, (kind, role, text) in enumerate(zip(kinds, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if kind == 0:
                    if end is not None:
                        inserted()
                        out.extend(end())
                    note = {c: v[i].as_py() for c, v in held.items()}
                    audit, at, state = note["audit"], 0, START
                    take, end = begin(note)
                else:
                    inserted()
                    letter, at = audit[at], at + 1
                    if letter == "R":
                        state = _EXPECTED[state]
                        out.extend(take(roles[state], text))
                    elif letter == "K":
                        state = _KEPT_AS["sua".index(role[0])][state]
                        out.extend(take(role, text))
                if len(out) >= 2048:
                    yield emitted()
                    out.clear()
        if end is not None:
            inserted()
            out.extend(end())
        if out:
            yield emitted()

    return dealt.mapInArrow(run, schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, places counted from 0."""
    plain = _plain(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def begin(note):
        place = -1

        def take(role, text):
            nonlocal place
            place += 1
            return [(note["conv_id"], place, role, text)]

        return take, lambda: []

    return _applied(plain, audits(plain).select("conv_id", "audit"), begin, f"conv_id {kind}, place bigint, role string, text string")


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows``, or per conv_id of ``conversations`` where that is given.

    conv_id, gaps (missing turn numbers), blank, duplicate, truncated, illegal (neighbours that don't follow one another),
    cost, audit and repaired_sha256 (of the lines ``role:text``). A conversation without rows has zeros, an empty audit and
    the hash of an empty text.
    """
    plain = _plain(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    counts = ("gaps", *_COUNTS)

    def begin(note):
        digest, first = hashlib.sha256(), True

        def take(role, text):
            nonlocal first
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
            return []

        return take, lambda: [(note["conv_id"], *(note[c] for c in counts), note["audit"], digest.hexdigest())]

    schema = f"conv_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"
    found = _applied(plain, audits(plain).select("conv_id", *counts, "audit"), begin, schema)
    if conversations is None:
        return found
    known = conversations.select(F.col("conv_id").alias("_id")).distinct()
    all_of_them = known.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    nothing = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return all_of_them.select(F.col("_id").alias("conv_id"), *nothing, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
