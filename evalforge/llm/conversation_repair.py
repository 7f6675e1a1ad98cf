"""Conversation structure repair by square-root checkpointed dynamic programming.

A conversation is its rows in order of turn. Blank and repeated rows must go; the others are
kept, given another role or deleted, and empty turns are inserted, so that the role initials
read `(s?(ua)+)?` at the least cost; of equally cheap edit lists the ASCII-least wins.

The state after a row is what the output ends with (nothing, s, u or a), so the costs of all
ways to finish from a row on are a vector of four. Such backward vectors are stored only at
checkpoints, every square root of the longest conversation's rows; a walk forward recomputes
the vectors of one block at a time and takes the ASCII-least edit that is tight (its cost plus
the cost of the rest equals the vector's entry).

Scale: one conversation may hold a third of all rows, so nothing is grouped by conversation
but checkpoints and blocks of bounded size. Rows are sorted by ranges of (conversation, turn),
which cuts a long conversation into many tasks. A block's effect on the vector is a 4 x 4
matrix of costs; matrices of the blocks of one conversation (the square root of its rows) are
combined backward, the blocks' state maps forward, and then all blocks are walked at once. A
forced deletion is always tight and the least letter, so blank and repeated rows need no
state at all. The digest reads the sorted rows as a stream: a hash over a whole conversation is
sequential, but only one batch of rows is in memory.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, small

BLANKS = " \t\n\x0b\x0c\r"
#: Blocks have at least so many rows.
MIN_BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, s, u, a. The one role that an inserted or rerolled turn may have next.
NEXT = (2, 2, 3, 2)
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
#: Letters of the edits inside: an inserted u or a, a row rerolled to U or A, K, D.
AUDIT = str.maketrans("uaUA", "IIRR")
COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
LEGAL = ("su", "ua", "au")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32(`conv:turn`) % 20: 0 goes, 1 loses its text, 2 its `[.!?]`, 3 is
    there twice, 4 gets the role user. A null counts as one space (in the checked string too); turn and
    conversation stay null. Other columns are ignored."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said(conv), said(turn)).cast("binary")) % 20
    return (
        rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), kind.alias("kind"))
        .filter("kind <> 0")
        .select(
            F.col("conv").alias(conv), F.col("turn").alias(turn), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias(role),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias(text),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def relaxed(g: list[int]) -> list[int]:
    """The vector after any insertions."""
    u, a = min(g[2], INSERT + g[3]), min(g[3], INSERT + g[2])
    return [min(g[0], INSERT + u), min(g[1], INSERT + u), u, a]


#: What it costs to end in each state.
END = relaxed([0, FAR, FAR, 0])


def kept(q: int, initial: str) -> int | None:
    """The state after a row is kept, None if it may not be."""
    if initial == "s":
        return 1 if q == 0 else None
    return NEXT[q] if initial == "?ua"[NEXT[q] - 1] else None


#: Codes of rows that need not go: initial, and whether the text is truncated.
CODES = {c: (i, TRUNCATED * t) for c, (i, t) in zip("abcdefgh", [(i, t) for i in "suax" for t in (0, 1)], strict=True)}
KEPT = {c: [kept(q, i) for q in range(4)] for c, (i, _) in CODES.items()}


def back(code: str, v: list[int]) -> list[int]:
    """The vector before a row from the one after it."""
    cut = CODES[code][1]
    g = [min(DELETE + v[q], REROLE + cut + v[NEXT[q]]) for q in range(4)]
    for q, to in enumerate(KEPT[code]):
        if to is not None and KEEP + cut + v[to] < g[q]:
            g[q] = KEEP + cut + v[to]
    return relaxed(g)


def matrix(codes: str) -> list[int]:
    """Costs from each state before the rows to each after them, by rows of 4."""
    columns = []
    for end in range(4):
        v = [0 if q == end else FAR for q in range(4)]
        for c in reversed(codes):
            v = [min(x, FAR) for x in back(c, v)]
        columns.append(v)
    return [columns[end][q] for q in range(4) for end in range(4)]


def walk(codes: str, end: list[int], q: int) -> tuple[list[str], int]:
    """The edits of each row (insertions before it and its own) and the state after all, given the
    vector at the checkpoint behind the rows and the state before them."""
    vectors = [end]
    for c in reversed(codes):
        vectors.append(back(c, vectors[-1]))
    edits = []
    for c in codes:
        here = vectors.pop()
        after, cut, done = vectors[-1], CODES[c][1], ""
        while True:
            to = KEPT[c][q]
            if DELETE + after[q] == here[q]:
                done += "D"
            elif INSERT + here[NEXT[q]] == here[q]:
                q = NEXT[q]
                done += "?ua"[q - 1]
                continue
            elif to is not None and KEEP + cut + after[to] == here[q]:
                q, done = to, done + "K"
            else:
                q = NEXT[q]
                done += "?UA"[q - 1]
            break
        edits.append(done)
    return edits, q


def tail(q: int) -> str:
    """Insertions after the last row."""
    out = ""
    while END[q]:
        q = NEXT[q]
        out += "?ua"[q - 1]
    return out


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered(rows: DataFrame, scratch: Scratch, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, turn, role, text, n, fault): distinct rows in order of pos, n copies of each; fault
    is blank, duplicate, truncated or empty, of the first of them."""
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(k) for c, k in ((role, "role"), (text, "text"))])
    merged = base.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    core = merged.withColumn("core", F.rtrim(F.col("text"), F.lit(BLANKS)))
    merged = scratch.save(core.select("conv", "turn", "role", "text", "n", (F.col("core") == "").alias("blank"), F.substring("core", -1, 1).isin(*".!?").alias("ended"), F.unhex(F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))).alias("h")), "rows")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # Texts said at more than one turn, with the first of them: few rows, and one for each text.
    again = merged.filter(~F.col("blank")).select("conv", "h", at.alias("at")).groupBy("conv", "h").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first <> last")
    again = scratch.save(again.select(F.col("conv").alias("c2"), F.col("h").alias("h2"), "first"), "again")
    found = merged.join(small(again), F.col("conv").eqNullSafe(F.col("c2")) & (F.col("h") == F.col("h2")), "left").withColumn("at", at)
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNotNull() & (F.col("first") != F.col("at")), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    found = found.select("conv", "turn", "role", "text", "n", fault.alias("fault"))
    up = lambda *names: [F.col(c).asc_nulls_first() for c in names]
    cut = found.repartitionByRange(*up("conv", "turn", "role"), F.substring("text", 1, 64).asc()).sortWithinPartitions(*up("conv", "turn", "role", "text"))
    return scratch.save(cut.withColumn("pos", F.monotonically_increasing_id()), "ordered")


def edits(rows: DataFrame, scratch: Scratch, block_rows: int | None = None) -> DataFrame:
    """(conv, pos, op) for the rows of `ordered` that need not go, and one row for insertions at the end
    of a conversation (pos: the largest long)."""
    live = rows.filter("fault IN ('', 'truncated')")
    if block_rows is None:
        longest = live.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
        block_rows = max(MIN_BLOCK, math.isqrt(longest) + 1)
    # Position inside the task that sorted the rows; the upper bits are the task.
    block = F.shiftright("pos", 33) * F.lit(1 << 33) + F.floor(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)
    place = F.array_position(F.array(*map(F.lit, "sua")), _initial(F.col("role")))
    code = F.substring(F.lit("abcdefgh"), (F.when(place == 0, 4).otherwise(place) * 2 - F.when(F.col("fault") == "", 1).otherwise(0)).cast("int"), F.lit(1))
    blocks = live.select("conv", block.alias("block"), F.struct("pos", code.alias("code")).alias("x")).groupBy("conv", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    one = Window.partitionBy("conv")
    blocks = blocks.select("conv", "block", F.col("xs.pos").alias("at"), F.array_join("xs.code", "").alias("codes"))
    blocks = blocks.withColumns({"of": F.count("*").over(one), "key": F.min(F.col("at")[0]).over(one), "last": F.max("block").over(one) == F.col("block")})
    blocks = scratch.save(blocks, "blocks")

    vectors = "key long, block long, end array<long>, start int"
    many = blocks.filter("of > 1").select("key", "block", "codes")

    def matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[["key", "block"]].assign(m=[matrix(c) for c in p["codes"]])

    def backward(p: pd.DataFrame) -> pd.DataFrame:
        """Checkpoint vectors of one conversation, from its blocks' matrices."""
        p, v, ends = p.sort_values("block"), END, []
        for m in reversed(p["m"].tolist()):
            ends.append(v)
            v = [min(int(m[4 * q + e]) + v[e] for e in range(4)) for q in range(4)]
        return p[["key", "block"]].assign(end=ends[::-1])

    def maps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p[["key", "block", "end"]].assign(to=[[walk(c, [int(x) for x in e], q)[1] for q in range(4)] for c, e in zip(p["codes"], p["end"], strict=True)])

    def forward(p: pd.DataFrame) -> pd.DataFrame:
        p, q, starts = p.sort_values("block"), 0, []
        for to in p["to"]:
            starts.append(q)
            q = int(to[q])
        return p[["key", "block", "end"]].assign(start=starts)

    checkpoints = scratch.save(many.mapInPandas(matrices, "key long, block long, m array<long>").groupBy("key").applyInPandas(backward, "key long, block long, end array<long>"), "vectors")
    states = many.join(checkpoints, ["key", "block"]).mapInPandas(maps, "key long, block long, end array<long>, to array<int>").groupBy("key").applyInPandas(forward, vectors)
    placed = blocks.join(scratch.save(states, "checkpoints"), ["key", "block"], "left").select("conv", "at", "codes", "last", "end", "start")
    schema = T.StructType([placed.schema["conv"], T.StructField("at", T.ArrayType(T.LongType())), T.StructField("ops", T.ArrayType(T.StringType()))])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ats, ops = [], []
            for at, codes, last, end, start in zip(*[b.column(c).to_pylist() for c in ("at", "codes", "last", "end", "start")], strict=True):
                done, q = walk(codes, end or END, start or 0)
                extra = tail(q) if last else ""
                ats.append(at + [(1 << 63) - 1] * bool(extra))
                ops.append(done + [extra] * bool(extra))
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(ats, pa.list_(pa.int64())), pa.array(ops, pa.list_(pa.string()))], ["conv", "at", "ops"])

    return placed.mapInArrow(walked, schema).select("conv", F.inline(F.arrays_zip("at", "ops"))).toDF("conv", "pos", "op")


#: Position of what follows the last row of a conversation, and kinds of rows of the stream.
LAST = (1 << 63) - 1
MARK, EDIT, ROW = 0, 1, 2


def _stream(rows: DataFrame, ops: DataFrame, convs: DataFrame) -> DataFrame:
    """A mark of each conversation, then its rows in order, each after its edits if it has any."""
    types = {"turn": "long", "role": "string", "text": "string", "n": "long", "fault": "string", "op": "string"}
    part = lambda df, kind, *own: df.select("conv", "pos", F.lit(kind).alias("kind"), *[c if c in own else F.lit(None).cast(t).alias(c) for c, t in types.items()])
    out = part(convs.withColumn("pos", F.lit(-1).cast("long")), MARK).union(part(ops, EDIT, "op")).union(part(rows, ROW, "turn", "role", "text", "n", "fault"))
    return out.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos", "kind")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The stream with edits joined to their row: (conv, kind, turn, role, text, n, fault, op)."""
    before = None
    for b in batches:
        for conv, pos, kind, turn, role, text, n, fault, op in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if kind == EDIT and pos < LAST:
                before = op
            else:
                yield conv, kind, turn, role, text, n, fault, op if kind == EDIT else before or "D"
                before = None


def _lines(kind: int, role: str, text: str, n: int, op: str) -> Iterator[tuple]:
    """(edit, role, text) of a step: of its insertions, its row and the row's copies; deleted rows have
    the role and text they had."""
    for x in op if kind == EDIT else op[:-1]:
        yield "I", NAMES[x], ""
    if kind == ROW:
        own = op[-1]
        yield own.translate(AUDIT), NAMES.get(own.lower(), role), text
        for _ in range(n - 1):
            yield "D", role, text


class _Digest:
    """What is known of one conversation so far."""

    def __init__(self, conv):
        self.conv, self.turns, self.first, self.last, self.initial = conv, 0, None, None, None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = 0
        self.audit, self.sha, self.begun = [], hashlib.sha256(), False

    def add(self, kind: int, turn: int | None, role: str, text: str, n: int, fault: str, op: str) -> None:
        if kind == ROW:
            if turn is not None and turn != self.last:
                self.turns, self.first, self.last = self.turns + 1, turn if self.first is None else self.first, turn
            if fault:
                self.count[fault] += n if fault == "blank" else 1
            if fault != "blank":
                self.count["duplicate"] += n - 1
            initial = role[:1]
            self.illegal += (self.initial is not None and self.initial + initial not in LEGAL) + (n - 1)
            self.initial = initial
            self.cost += TRUNCATED * (fault == "truncated" and op[-1] != "D")
        for edit, new_role, new_text in _lines(kind, role, text, n, op):
            self.audit.append(edit)
            self.cost += COST[edit]
            if edit != "D":
                self.sha.update(f"{chr(10) * self.begun}{new_role}:{new_text}".encode("utf-8", "surrogatepass"))
                self.begun = True

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.count.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _in_batches(made: Iterator[tuple], schema: T.StructType, size: int = 2000) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    while rows := list(itertools.islice(made, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _prepared(rows: DataFrame, convs: DataFrame, conv: str, turn: str, role: str, text: str, block_rows: int | None) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "repair")
    found = ordered(rows, scratch, conv, turn, role, text)
    return _stream(found, edits(found, scratch, block_rows), convs.select(F.col(conv).alias("conv")).distinct())


def digests(rows: DataFrame, convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int | None = None) -> DataFrame:
    """A row for each distinct conversation of convs (which holds all of rows): conv, COLUMNS.

    Rows of a conversation are taken by turn (nulls first), then role and text; equal rows are copies,
    of which all but the first are duplicates. A null role or text is one space, a null conversation is one
    of its own. A role's initial is its first character; a row whose initial is no s, u or a can only be
    given another role or deleted. Texts of any length are read whole; duplicates are told by a 128-bit
    fingerprint. A conversation without rows has zeros, an empty audit and the hash of an empty
    string. Empty tables give no rows; other columns are ignored.
    """
    stream = _prepared(rows, convs, conv, turn, role, text, block_rows)
    schema = T.StructType([T.StructField(conv, stream.schema["conv"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = None
        for c, kind, *step in _steps(batches):
            if kind == MARK:
                if now is not None:
                    yield now.row()
                now = _Digest(c)
            else:
                now.add(kind, *step)
        if now is not None:
            yield now.row()

    return stream.mapInArrow(lambda batches: _in_batches(each(batches), schema), schema)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int | None = None) -> DataFrame:
    """The turns after repair and the rows that went: (conv, place, turn, role, text, fault, edit). place
    counts a conversation's lines from 1, deleted ones too; turn is null for inserted ones; edit is K,
    R, D or I. Rules as in `digests`."""
    stream = _prepared(rows, rows, conv, turn, role, text, block_rows)
    schema = T.StructType([T.StructField(conv, stream.schema["conv"].dataType), T.StructField("place", T.LongType()), T.StructField(turn, T.LongType()), *[T.StructField(c, T.StringType()) for c in (role, text, "fault", "edit")]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for c, kind, t, r, x, n, fault, op in _steps(batches):
            place = 0 if kind == MARK else place
            for i, (edit, new_role, new_text) in enumerate(() if kind == MARK else _lines(kind, r, x, n, op), 1):
                place += 1
                own = i > len(op) - 1 and kind == ROW
                yield c, place, t if own else None, new_role, new_text, (fault if i == len(op) or fault == "blank" else "duplicate") if own else None, edit

    return stream.mapInArrow(lambda batches: _in_batches(each(batches), schema), schema)
