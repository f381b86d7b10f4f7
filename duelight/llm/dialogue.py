"""Repair of damaged conversations at least cost, by a square-root checkpointed DP.

A conversation is a sequence of turns whose role initials should read (s?(ua)+)?. Edits
keep a turn (0), give it the role that is due (3), delete it (4) or insert an empty
turn of the role that is due (3); blank and duplicate turns must go, and a truncated
turn that stays adds 3. What role is due depends on the automaton's state alone, so an
edit script is the string of its edits' initials.

`repair` reduces a conversation to one byte per turn. Costs to the end, a vector over
the four states, are computed backwards and kept only at every sqrt(n)-th turn; the
walk forward recomputes one block of vectors at a time, and takes at each step the
ASCII-least edit that is tight. So n turns need n bytes, two blocks' vectors of sqrt(n)
and the script.

Stages: first places of each (role, text) of a conversation are found by a grouped
minimum and join the turns' stream as markers, not by a join; turns without their texts
are dealt out by conversation, sorted, and streamed through the DP; its result then leads
the texts of its conversation through a second sorted stream, which digests what the
script makes of them. Both streams hold one row of text at most, besides the script,
which is itself one value of the result. A conversation's digest has to run over its
texts in order, so one that holds a third of all turns is streamed by one task, from
sorted files on disk.

Defined cases: a null role or text is one space, as are null ids in the damage's key; a
null conv_id is a conversation; null turns come first; turns of one number are ordered
by the MD5 of their role and text before damage, and repeated rows are neighbours (all
but the first are duplicates); an initial is a role's first character, and one that is
none of s, u, a is kept nowhere; a conversation without a turn left has zeros, an empty
audit and the digest of nothing; texts of any length pass whole; other columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Characters that are no content of a turn, as the contract names them.
BLANKS = " \t\n\x0b\x0c\r"
S, U, A, OTHER = range(4)
FINE, BLANK, DUPLICATE, CUT = range(4)
#: States: at the start, after s, after u, after a; by state the role that is due, and the state after it.
DUE, AFTER = (U, U, A, U), (2, 2, 3, 2)
#: state and kept role -> state
KEPT = {(0, S): 1, (0, U): 2, (1, U): 2, (2, A): 3, (3, U): 2}
LEGAL = {(S, U), (U, A), (A, U)}
ROLE = {U: "user", A: "assistant"}
INFINITE = 1 << 60
Vector = tuple[int, int, int, int]


def _closed(b0: int, b1: int, b2: int, b3: int) -> Vector:
    """Costs once turns may be inserted too."""
    b2, b3 = min(b2, b3 + INSERT), min(b3, b2 + INSERT)
    return min(b0, b2 + INSERT), min(b1, b2 + INSERT), b2, b3


END: Vector = _closed(0, INFINITE, INFINITE, 0)


def back(code: int, b: Vector) -> Vector:
    """Costs from before a turn on, given those from after it."""
    b0, b1, b2, b3 = b
    role, fault = divmod(code, 4)
    if fault in (BLANK, DUPLICATE):
        return b0 + DELETE, b1 + DELETE, b2 + DELETE, b3 + DELETE
    extra = TRUNCATED if fault == CUT else 0
    to_u, to_a = b2 + extra, b3 + extra
    due_u, due_a = to_u + (KEEP if role == U else REROLE), to_a + (KEEP if role == A else REROLE)
    c0 = min(b0 + DELETE, due_u, b1 + extra if role == S else INFINITE)
    return _closed(c0, min(b1 + DELETE, due_u), min(b2 + DELETE, due_a), min(b3 + DELETE, due_u))


def script(codes: bytes) -> tuple[int, str]:
    """Least cost, and the ASCII-least of the cheapest scripts."""
    n = len(codes)
    step = isqrt(n) + 1
    marks = {n: END}
    b = END
    for i in range(n - 1, -1, -1):
        b = back(codes[i], b)
        if i % step == 0:
            marks[i] = b
    cost, state, out = b[0], 0, []
    for begin in range(0, n, step):
        end = min(begin + step, n)
        vectors = [marks[end]]
        for i in range(end - 1, begin - 1, -1):
            vectors.append(back(codes[i], vectors[-1]))
        vectors.reverse()
        for i in range(begin, end):
            here, after = vectors[i - begin], vectors[i - begin + 1]
            role, fault = divmod(codes[i], 4)
            extra = TRUNCATED if fault == CUT else 0
            while True:
                if after[state] + DELETE == here[state]:
                    out.append("D")
                    break
                if here[AFTER[state]] + INSERT == here[state]:
                    out.append("I")
                    state = AFTER[state]
                    continue
                kept = KEPT.get((state, role))
                if kept is not None and after[kept] + extra == here[state]:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = AFTER[state]
                break
    while END[state]:
        out.append("I")
        state = AFTER[state]
    return cost, "".join(out)


@dataclass
class _Turns:
    """What is kept of a conversation while its turns pass."""

    codes: bytearray = field(default_factory=bytearray)
    faults: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    role: int | None = None
    least: int | None = None
    most: int | None = None
    distinct: int = 0
    marker: tuple | None = None

    def add(self, turn: int | None, tie: bytes, role: int, blank: bool, ends: bool) -> None:
        first = self.marker == (turn, tie)
        if first:
            self.marker = None  # repeated rows follow, and are no first place
        fault = BLANK if blank else DUPLICATE if not first else FINE if ends else CUT
        self.codes.append(role * 4 + fault)
        self.faults[fault] += 1
        if self.role is not None and (self.role, role) not in LEGAL:
            self.illegal += 1
        self.role = role
        if turn is not None:
            self.distinct += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def row(self) -> list:
        cost, audit = script(bytes(self.codes))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return [gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, cost, audit]


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in batch.columns])


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over turns and markers (sorted): one row per conversation."""
    names = ["conv_id", *RESULT]
    now, held, kind = None, None, None
    for batch in batches:
        done, kind = [], batch.schema.field("conv_id").type
        for conv, turn, tie, marker, role, blank, ends in _rows(batch):
            if held is None or conv != now:
                if held is not None:
                    done.append([now, *held.row()])
                now, held = conv, _Turns()
            if marker:
                held.marker = (turn, tie)
            elif role is not None:
                held.add(turn, tie, role, blank, ends)
        yield _batch(done, names, kind)
    if held is not None:
        yield _batch([[now, *held.row()]], names, kind)


def _batch(rows: list[list], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind] + [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names[1:]]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


class _Digest:
    """SHA-256 of the repaired turns of one conversation, fed turn by turn."""

    def __init__(self, result: tuple):
        self.result, self.audit = list(result), result[-1]
        self.at = self.state = 0
        self.some, self.sha = False, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.some else "").encode() + role.encode() + b":" + text.encode())
        self.some = True

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._due("")

    def _due(self, text: str) -> None:
        self._line(ROLE[DUE[self.state]], text)
        self.state, self.at = AFTER[self.state], self.at + 1

    def turn(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        if edit == "R":
            self._due(text)
            return
        self.at += 1
        if edit == "K":
            self._line(role, text)
            self.state = KEPT[self.state, "sua".index(role[0])]

    def row(self) -> list:
        self._inserted()
        return [*self.result, self.sha.hexdigest()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: each conversation's result, then its turns' texts in order."""
    names = ["conv_id", *RESULT, "repaired_sha256"]
    held, kind = None, None
    for batch in batches:
        done, kind = [], batch.schema.field("conv_id").type
        for row in _rows(batch):
            conv, role, text, result = row[0], row[4], row[5], row[6:]
            if result[0] is not None:
                if held is not None:
                    done.append(held.row())
                held = _Digest((conv, *result))
            else:
                held.turn(role, text)
        yield _batch(done, names, kind)
    if held is not None:
        yield _batch([held.row()], names, kind)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, tie, role, text of turns after the damage; a dropped turn has a null role and text."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    base = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"), fate.alias("fate"))
    tie = F.unhex(F.md5(F.concat("role", F.lit(":"), "text").cast("binary")))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    there = lambda c: F.when(F.col("fate") != 0, c)
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return base.select("conv_id", "turn", tie.alias("tie"), there(role).alias("role"), there(text).alias("text"), twice.alias("copy")).drop("copy")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, RESULT and repaired_sha256 of every conversation of turns (conv_id, turn, tie, role, text; a null role is no turn)."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    first = F.left("role", F.lit(1))
    code = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).when(F.col("role").isNotNull(), OTHER)
    blank, ends = rest == "", F.right(rest, F.lit(1)).isin(".", "!", "?")
    place = ["conv_id", "turn", "tie"]
    compact = turns.select(*place, F.lit(False).alias("marker"), code.alias("role"), blank.alias("blank"), ends.alias("ends"))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    spoken = turns.where(F.col("role").isNotNull() & ~blank).select(*place, F.unhex(said).alias("said"))
    least = spoken.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "tie")).alias("m"))
    null = lambda kind: F.lit(None).cast(kind)
    markers = least.select("conv_id", "m.turn", "m.tie", F.lit(True).alias("marker"), null("int").alias("role"), null("boolean").alias("blank"), null("boolean").alias("ends"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie")]
    stream = compact.union(markers).repartition(parts, "conv_id").sortWithinPartitions(*order, F.col("marker").desc())
    conv = turns.schema["conv_id"].dataType
    kinds = [T.StructField(n, T.StringType() if n == "audit" else T.LongType()) for n in RESULT]
    fixed = stream.mapInArrow(_repairs, T.StructType([T.StructField("conv_id", conv), *kinds]))
    heads = fixed.select("conv_id", null("long").alias("turn"), null("binary").alias("tie"), F.lit(0).alias("kind"), null("string").alias("role"), null("string").alias("text"), *RESULT)
    kept = turns.where(F.col("role").isNotNull()).select(*place, F.lit(1).alias("kind"), "role", "text", *[null(f.dataType).alias(f.name) for f in kinds])
    both = heads.union(kept).repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("kind"), *order[1:])
    return both.mapInArrow(_digests, T.StructType([T.StructField("conv_id", conv), *kinds, T.StructField("repaired_sha256", T.StringType())]))
