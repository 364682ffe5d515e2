"""Cheapest repair of conversations whose turns are out of order, repeated, blank or cut off.

A conversation is good when it is empty, or when its roles go user, assistant, user, assistant ... to
an assistant at the end, with at most one system row in front. Its rows may be kept, given the other
role, deleted, and rows without text may be inserted, each at a cost; blank and repeated rows must be
deleted, and a truncated row that stays costs more.

1. Rows with equal turn, role and text become one row with a count. The first turn of every (role,
   text) of a conversation comes from a grouped minimum, so repeated rows are known without a task
   seeing a whole conversation's texts. The digest of a text stands for it from here on.
2. Slim rows are sorted by conversation and stream through the tasks. A row is a symbol of role and
   fault; equal consecutive symbols are one run. What a symbol does to the cost of being before or
   after each kind of row is a 4 x 4 min-plus matrix; a run advances by the binary powers of its
   matrix, which are computed once a symbol and kept.
3. Costs to the end are kept once every ``BLOCK`` runs; going forward, a block's own costs are
   found again and the least letter whose cost is still the best is taken: that is the audit,
   one letter an edit: (K)eep, (R)erole, (D)elete, (I)nsert. The letter fixes the next state, so the
   first least letters give the least audit of all cheapest ones.
4. The texts stream once more, behind the audit of their conversation, which says row by row what
   becomes of them. Texts are never gathered.

Per conversation a task holds some ten bytes a run and the audit itself, a letter an edit, never
its rows; its report is one row, so the audit must fit a cell. One digest over a conversation's text has to
read it in order, which one task does as a stream.

Defined cases: a null role or text counts as one space, so such a text is blank; a null
conversation is one as any other; null turns come first and are no part of the gaps. Rows of one
turn are taken by role, then by digest of the text. Empty texts are blank. Very long texts are digested
where they lie and pass through in batches of bounded bytes. Repeated rows count as often as they
stand. A conversation without rows has zeros and an empty audit; an empty table gives an empty result. Other columns are
left out, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import NO_SPACE, SPACE, settle
from .wordhash import by_bytes

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)    # what the last row was
OTHER = 0                                    # class of a role that has no place
NEXT = (USER, USER, ASSISTANT, USER)         # the only row that may be inserted, by state
NAMES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 50
BLOCK = 512     # runs between two kept costs
PIECE = 1024    # rows of a run that are unrolled together
ROWS = 2048     # report rows a batch

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


# --- min-plus steps ----------------------------------------------------------------------------

Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(r[k] + b[k][j] for k in range(4)) for j in range(4)) for r in a)


def advance(m: Matrix, to_go: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a step, from those after it."""
    a, b, c, d = to_go
    return tuple(min(r[0] + a, r[1] + b, r[2] + c, r[3] + d) for r in m)


def symbol(role: int, fault: int) -> int:
    """Roles do not matter where the row must go."""
    return 0 if fault in (BLANK, DUPLICATE) else 1 + 2 * role + (fault == TRUNCATED)


class Steps:
    """Matrices of the symbols and their binary powers, each computed once."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.inserts = tuple(
            tuple(self._inserts(s, t) for t in range(4)) for s in range(4))
        ends = tuple(0 if s in (START, ASSISTANT) else NEVER for s in range(4))
        self.end = advance(self.inserts, ends)
        self.power = cache(self._power)
        self.moves = [self._moves(s) for s in range(9)]

    def _inserts(self, s: int, t: int) -> int:
        cost = 0
        for _ in range(4):
            if s == t:
                return cost
            s, cost = NEXT[s], cost + self.costs.insert
        return NEVER

    def _moves(self, sym: int) -> list[list[tuple[str, int, int]]]:
        """Edits of a row, by state: letter, cost, next state; letters ascend."""
        role, more = (sym - 1) // 2, self.costs.truncated * ((sym - 1) % 2)
        out = []
        for state in range(4):
            edits = [("D", self.costs.delete, state)]
            if sym:
                if role == SYSTEM and state == START or role in (USER, ASSISTANT) and NEXT[state] == role:
                    edits.append(("K", more, role))
                edits.append(("R", self.costs.rerole + more, NEXT[state]))
            out.append(edits)
        return out

    def _power(self, sym: int, k: int) -> Matrix:
        """The matrix of 2 ** k rows of one symbol."""
        if k:
            half = self.power(sym, k - 1)
            return product(half, half)
        row = [[NEVER] * 4 for _ in range(4)]
        for state in range(4):
            for _, cost, to in self.moves[sym][state]:
                row[state][to] = min(row[state][to], cost)
        return product(self.inserts, tuple(map(tuple, row)))

    def run(self, sym: int, n: int, to_go: tuple[int, ...]) -> tuple[int, ...]:
        k = 0
        while n:
            if n & 1:
                to_go = advance(self.power(sym, k), to_go)
            n >>= 1
            k += 1
        return to_go

    def solve(self, symbols: bytearray, counts: array) -> tuple[int, str]:
        """Least cost and least audit of a conversation given as runs."""
        n = len(symbols)
        kept, to_go = [self.end], self.end
        for first in range((n - 1) // BLOCK * BLOCK if n else -1, -1, -BLOCK):
            for i in range(min(n, first + BLOCK) - 1, first - 1, -1):
                to_go = self.run(symbols[i], counts[i], to_go)
            kept.append(to_go)
        cost, state, audit = to_go[START], START, bytearray()
        for b, first in enumerate(range(0, n, BLOCK)):
            last = min(n, first + BLOCK)
            after = [kept[len(kept) - 2 - b]]
            for i in range(last - 1, first, -1):
                after.append(self.run(symbols[i], counts[i], after[-1]))
            for i in range(first, last):
                state = self._unroll(symbols[i], counts[i], after.pop(), state, audit)
        while self.end[state]:
            audit += b"I"
            state = NEXT[state]
        return cost, audit.decode()

    def _unroll(self, sym: int, n: int, after: tuple[int, ...], state: int, audit: bytearray) -> int:
        moves, step, insert = self.moves[sym], self.power(sym, 0), self.costs.insert
        for done in range(0, n, PIECE):
            size = min(PIECE, n - done)
            to_go = [self.run(sym, n - done - size, after)]
            for _ in range(size):
                to_go.append(advance(step, to_go[-1]))
            while size:
                now, then = to_go[size], to_go[size - 1]
                while True:
                    for letter, cost, to in moves[state]:
                        # The only letter between a deletion and the others is the insertion.
                        if letter != "D" and insert + now[NEXT[state]] == now[state]:
                            letter = "I"
                            break
                        if cost + then[to] == now[state]:
                            break
                    else:
                        letter = "I"
                    audit += letter.encode()
                    if letter != "I":
                        state = to
                        break
                    state = NEXT[state]
                size -= 1
        return state


# --- rows ------------------------------------------------------------------------------------------

def prepare(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """Distinct rows ``conv_id, turn, role, text, copies, digest, look``, stored in the shared folder.

    ``copies`` names a column that says how often a row stands; rows with 0 only make their
    conversation known. ``look`` is the fault that the text alone shows.
    """
    count = F.lit(1) if copies is None else F.col(copies)
    known = count > 0
    rows = df.select(
        F.col(conv).alias("conv_id"), F.when(known, F.col(turn)).alias("turn"),
        F.when(known, F.coalesce(role, F.lit(" "))).alias("role"),
        F.when(known, F.coalesce(text, F.lit(" "))).alias("text"), count.cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    look = F.when(~F.col("text").rlike(NO_SPACE), BLANK).when(
        ~F.col("text").rlike(f"[.!?]{SPACE}*\\z"), TRUNCATED).otherwise(FINE)
    return settle(rows.withColumns({"digest": F.unhex(F.md5("text")), "look": look}))


def _faults(prepared: DataFrame) -> DataFrame:
    """Slim rows with the first fault of the first copy."""
    slim = prepared.select("conv_id", "turn", "role", "digest", "copies", "look")
    first = slim.where("copies > 0").groupBy("conv_id", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("null_turn"), F.min("turn").alias("first_turn"))
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id"))
    same &= (F.col("r.role") == F.col("f.role")) & (F.col("r.digest") == F.col("f.digest"))
    later = F.when(F.col("null_turn"), F.col("turn").isNotNull()).otherwise(F.col("turn") != F.col("first_turn"))
    fault = F.when((F.col("look") != BLANK) & later, DUPLICATE).otherwise(F.col("look"))
    return slim.alias("r").join(first.alias("f"), same, "left").select(
        *[f"r.{c}" for c in ("conv_id", "turn", "role", "digest", "copies")],
        role_class(F.col("r.role")).alias("class"), fault.alias("fault"))


def role_class(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)


def _stream(df: DataFrame, order: list[str], step: Callable, schema: StructType) -> DataFrame:
    """Rows of whole conversations in order through a generator of output rows, in small batches."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row, weight in step(_rows(batches)):
            rows.append(row)
            size += weight
            if len(rows) >= ROWS or size > 4 << 20:
                yield _batch(rows, arrow)
                rows, size = [], 0
        if rows:
            yield _batch(rows, arrow)

    return df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for whole in batches:
        for batch in by_bytes(whole, "text") if "text" in whole.schema.names else (whole,):
            yield from zip(*(c.to_pylist() for c in batch.columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Case:
    """What is known of the conversation that streams by."""

    def __init__(self):
        self.symbols, self.counts = bytearray(), array("q")
        self.faults = [0, 0, 0, 0]
        self.illegal, self.turns, self.low, self.high, self.role = 0, 0, None, None, None

    def add(self, turn, role: int, fault: int, copies: int) -> None:
        self._run(symbol(role, fault), 1)
        self.faults[fault] += 1
        if copies > 1:
            again = BLANK if fault == BLANK else DUPLICATE
            self._run(0, copies - 1)
            self.faults[again] += copies - 1
        if self.role is not None and (self.role, role) not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1     # a role never follows itself
        self.role = role
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def _run(self, sym: int, n: int) -> None:
        if self.symbols and self.symbols[-1] == sym:
            self.counts[-1] += n
        else:
            self.symbols.append(sym)
            self.counts.append(n)

    def report(self, steps: Steps) -> tuple:
        gaps = 0 if self.high is None else int(self.high - self.low + 1 - self.turns)
        return (gaps, *self.faults[BLANK:], self.illegal, *steps.solve(self.symbols, self.counts))


LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def judge(prepared: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``conv_id`` and the report of every conversation: gaps, faults, cost and audit."""
    def step(rows):
        steps, case, now = Steps(costs), None, None
        for conv, turn, _, _, copies, role, fault in rows:
            if case is None or conv != now:
                if case is not None:
                    yield (now, *case.report(steps)), 64 + len(case.symbols)
                case, now = _Case(), conv
            if copies:
                case.add(turn, role, fault, copies)
        if case is not None:
            yield (now, *case.report(steps)), 64

    schema = StructType([prepared.schema["conv_id"], *StructType.fromDDL(REPORT)])
    return _stream(_faults(prepared), ["conv_id", "turn", "role", "digest"], step, schema)


def _edited(rows, fields: int):
    """(conversation, report fields or an edit) in order: the report opens a conversation and None
    closes it; an edit is letter, turn, role, text of a row that stays or is inserted."""
    audit, place, state, now = "", 0, START, None

    def inserted():
        nonlocal place, state
        while place < len(audit) and audit[place] == "I":
            place, state = place + 1, NEXT[state]
            yield now, ("I", None, NAMES[state], "")

    for conv, kind, turn, role, _, copies, cls, text, *report in rows:
        if kind == 0:
            if place or audit:
                yield from inserted()
            audit, place, state, now = text, 0, START, conv
            yield conv, [*report, audit]
            continue
        for _ in range(copies):
            yield from inserted()
            letter, place = audit[place], place + 1
            if letter == "K":
                state = cls
                yield conv, ("K", turn, role, text)
            elif letter == "R":
                state = NEXT[state]
                yield conv, ("R", turn, NAMES[state], text)
    yield from inserted()


def _behind_reports(prepared: DataFrame, report: DataFrame) -> tuple[DataFrame, list[str]]:
    """Texts behind the report of their conversation, which carries the audit as its text."""
    fields = [c for c in report.columns if c not in ("conv_id", "audit")]
    null = lambda c: F.lit(None).cast(prepared.schema[c].dataType).alias(c)
    heads = report.select(
        "conv_id", F.lit(0).alias("kind"), null("turn"), null("role"), null("digest"), F.lit(1).cast("long").alias("copies"),
        F.lit(0).alias("class"), F.col("audit").alias("text"), *fields)
    rows = prepared.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "copies", role_class(F.col("role")).alias("class"),
        "text", *[F.lit(None).cast("long").alias(c) for c in fields])
    return heads.unionByName(rows), fields


ORDER = ["conv_id", "kind", "turn", "role", "digest"]


def repaired_rows(prepared: DataFrame, report: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text`` of the repaired conversations; place counts from 0."""
    both, fields = _behind_reports(prepared, report)

    def step(rows):
        place = 0
        for conv, what in _edited(rows, len(fields)):
            if isinstance(what, list):
                place = 0
                continue
            yield (conv, place, *what), 64 + len(what[3])
            place += 1

    types = prepared.schema
    schema = StructType([types["conv_id"], *StructType.fromDDL("place long, edit string"), types["turn"],
                         *StructType.fromDDL("role string, text string")])
    return _stream(both, ORDER, step, schema)


def repaired_digests(prepared: DataFrame, report: DataFrame) -> DataFrame:
    """The report with ``repaired_sha256``: the digest of the repaired rows as ``role:text`` lines."""
    both, fields = _behind_reports(prepared, report)

    def step(rows):
        head, digest, any_row = None, None, False
        for conv, what in _edited(rows, len(fields)):
            if isinstance(what, list):
                if head is not None:
                    yield (*head, digest.hexdigest()), 128
                head, digest, any_row = (conv, *what), hashlib.sha256(), False
                continue
            if any_row:
                digest.update(b"\n")
            digest.update(f"{what[2]}:".encode())
            digest.update(what[3].encode())
            any_row = True
        if head is not None:
            yield (*head, digest.hexdigest()), 128

    schema = StructType([prepared.schema["conv_id"], *StructType.fromDDL(
        ", ".join(f"{c} long" for c in fields) + ", audit string, repaired_sha256 string")])
    return _stream(both, ORDER, step, schema)


def repair(df: DataFrame, copies: str | None = None, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation, stored, and the prepared rows for ``repaired_rows``."""
    prepared = prepare(df, copies=copies)
    return settle(judge(prepared, costs)), prepared


def damage(df: DataFrame) -> DataFrame:
    """Rows spoilt by a hash of conversation and turn, with ``copies``: dropped rows have none."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return df.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
