"""Repair of conversation structure by weighted interval parsing.

A sound conversation has the role initials ``(s?(ua)+)?``. The repair grammar, in Chomsky normal form, has one symbol X(p, q) for every pair of
states of that pattern: what takes it from p to q. Its rules are X(p, q) -> X(p, r) X(r, q), and per turn the edits Keep 0, Rerole 2, Delete 3,
with 1 more for a truncated turn that stays; X(p, q) also derives turns that aren't there (Insert, 2 each), and that closure is worked
into every cell. A cell of the chart holds, for every symbol, the least (cost, audit) over a span of turns. Two audits of one span and
equal cost are never a prefix of each other, since the turns fix all letters but I and every I costs, so the least audit of a span
is made of least audits of its parts.

Any cut of a span gives the same cell, because every state is a cut of a derivation. So the chart needs no other spans than those of 1, 2, 4, ...
turns: it is filled bottom-up by span length, with as many cells as turns. Turns are dealt by ranges of (conversation, turn), so a conversation
may lie in many partitions: each partition leaves one cell per conversation, and rounds join the cells of neighbouring partitions.

Turns are ordered by turn, NULL first, those of one turn by role, the first 64 characters and a hash of the text; rows alike in all are in the
conversation as often as they are given. A NULL conv_id is a conversation of its own. NULL role or text is one space, so a blank turn. Roles with other
initials than s, u and a can't be kept. An empty table gives no rows. The hash of a repaired conversation runs over its turns as they
stream by, so no task holds a whole one, although the turns of one conversation pass through one task there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import bounded, cut

STATES = 4  # nothing yet, after the system turn, after a user turn, after an assistant turn
ENDS = (0, 3)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # the only role that may be put in after a state
OK, CUT_OFF, GONE = 0, 1, 2
LEAVES = 16  # turns whose chart is remembered
FAN = 8  # neighbouring cells joined in one round

Cell = tuple  # per symbol p * STATES + q: (cost, audit) or None


# ---- chart

def joined(x: Cell, y: Cell) -> Cell:
    """Cell of a span from those of its two parts."""
    out = []
    for p in range(STATES):
        for q in range(STATES):
            least, ways = None, []
            for r in range(STATES):
                a, b = x[p * STATES + r], y[r * STATES + q]
                if a is not None and b is not None:
                    cost = a[0] + b[0]
                    if least is None or cost < least:
                        least, ways = cost, [(a[1], b[1])]
                    elif cost == least:
                        ways.append((a[1], b[1]))
            out.append(None if least is None else (least, min(a + b for a, b in ways)))
    return tuple(out)


def _cell(entries: Iterable[tuple[int, int, int, str]]) -> Cell:
    out: list = [None] * STATES**2
    for p, q, cost, audit in entries:
        at = p * STATES + q
        if out[at] is None or (cost, audit) < out[at]:
            out[at] = (cost, audit)
    return tuple(out)


def _insertions() -> Cell:
    """Least insertions from state to state; chains are longer than the pattern has states only if they cost more."""
    one = _cell([(p, p, 0, "") for p in range(STATES)] + [(p, q, INSERT, "I") for c in "ua" for p, q in NEXT[c].items()])
    every = one
    for _ in range(STATES):
        every = joined(every, one)
    return every


INSERTIONS = _insertions()


@lru_cache(None)
def turn_cell(kind: str) -> Cell:
    """Cell of one turn; ``kind`` is the letter of ``kind_of``."""
    initial, status = KINDS[kind]
    edits = [(p, p, DELETE, "D") for p in range(STATES)]
    if status != GONE:
        more = TRUNCATED if status == CUT_OFF else 0
        edits += [(p, q, more, "K") for p, q in NEXT.get(initial, {}).items()]
        edits += [(p, q, REROLE + more, "R") for c in "ua" for p, q in NEXT[c].items()]
    return joined(joined(INSERTIONS, _cell(edits)), INSERTIONS)


INITIALS = "sua?"
KINDS = {chr(65 + 3 * i + status): (c, status) for i, c in enumerate(INITIALS) for status in (OK, CUT_OFF, GONE)}
KIND = {v: k for k, v in KINDS.items()}


@lru_cache(1 << 16)
def short_cell(kinds: str) -> Cell:
    """Cell of a short span, by halves."""
    if len(kinds) == 1:
        return turn_cell(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return joined(short_cell(kinds[:half]), short_cell(kinds[half:]))


class Chart:
    """Cells of a run of turns that come one by one: spans of equal length join as soon as both are there."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []
        self.waiting: list[str] = []

    def add(self, kind: str) -> None:
        self.waiting.append(kind)
        if len(self.waiting) == LEAVES:
            self.push(LEAVES, short_cell("".join(self.waiting)))
            self.waiting = []

    def push(self, length: int, cell: Cell) -> None:
        while self.spans and self.spans[-1][0] == length:
            cell = joined(self.spans.pop()[1], cell)
            length *= 2
        self.spans.append((length, cell))

    def cell(self) -> Cell:
        """Cell of all turns; shorter spans lie at the end and join first."""
        out = short_cell("".join(self.waiting)) if self.waiting else None
        for _, x in reversed(self.spans):
            out = x if out is None else joined(x, out)
        return INSERTIONS if out is None else out


def best(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    return min(cell[q] for q in ENDS if cell[q] is not None)


# ---- spans of conversations

def _key(column: Column) -> Column:
    """conv_id as a name that isn't NULL."""
    return F.coalesce(F.concat(F.lit("/"), column.cast("string")), F.lit(""))


_ORDER = ["turn", "role", "_head", "_h"]


def _ordered(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("_head", F.substring("text", 1, 64)).withColumn("_h", F.unhex(F.md5(F.col("text").cast("binary"))))


def marked(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, _head, _h, initial, blank, cut_off, again) per turn; again: role and text are in an earlier turn number."""
    rows = _ordered(rows)
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)  # empty for a blank text
    first = F.substring("role", 1, 1)
    narrow = rows.select("conv", *_ORDER, F.when(first.isin("s", "u", "a"), first).otherwise("?").alias("initial"),
                         (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"))
    seen = narrow.groupBy("conv", "role", "_h").agg(F.min(F.struct("turn")).alias("_first"))
    return narrow.join(seen, ["conv", "role", "_h"]).withColumn("again", ~F.col("turn").eqNullSafe(F.col("_first.turn"))).drop("_first")


_SPAN = ("conv string, part bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
         "lo bigint, hi bigint, turns bigint, costs array<bigint>, audits array<string>")
_LEGAL = {"su", "ua", "au"}


class Span:
    """What is known of successive turns of one conversation."""

    def __init__(self, conv: str, part: int):
        self.conv, self.part, self.chart = conv, part, Chart()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.lo = self.hi = None

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut_off: bool) -> None:
        status = GONE if blank or again else CUT_OFF if cut_off else OK
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += status == CUT_OFF
        self.follow(initial, initial, turn, turn, turn is not None)
        self.chart.add(KIND[initial, status])

    def follow(self, first: str, last: str, lo: int | None, hi: int | None, turns: int) -> None:
        """Turns from initial ``first`` to ``last`` and numbers from ``lo`` to ``hi`` come next."""
        if self.first is None:
            self.first = first
        else:
            self.illegal += self.last + first not in _LEGAL
        self.last = last
        if lo is not None:
            self.turns += turns - (self.hi == lo)
            self.lo, self.hi = lo if self.lo is None else self.lo, hi

    def extend(self, row: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, k, getattr(self, k) + row[k])
        self.follow(row["first"], row["last"], row["lo"], row["hi"], row["turns"])

    def row(self, cell: Cell) -> dict:
        return {"conv": self.conv, "part": self.part, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "first": self.first, "last": self.last, "lo": self.lo, "hi": self.hi, "turns": self.turns,
                "costs": [c and c[0] for c in cell], "audits": [c and c[1] for c in cell]}


def _schema() -> pa.Schema:
    types = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, types[t]) for name, t in (x.split() for x in _SPAN.split(", "))])


_CHARS = 8 << 20  # of audits in one batch


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(a) for a in row["audits"] if a)
        if size > _CHARS:
            yield pa.RecordBatch.from_pylist(held, _schema())
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _schema())


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def spans():
        span, before = None, None
        for batch in batches:
            for conv, turn, role, h, initial, blank, cut_off, again in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if span is None or span.conv != conv:
                    if span is not None:
                        yield span.row(span.chart.cell())
                    span, before = Span(conv, part), None
                same, before = (turn, role, h) == before, (turn, role, h)
                span.add(turn, initial, blank, again or same, cut_off)
        if span is not None:
            yield span.row(span.chart.cell())

    yield from _batches(spans())


def _join_spans(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One span of those that follow each other."""
    rows = table.sort_by("part").to_pylist()
    out = Span(key[0].as_py(), key[1].as_py())
    cells = []
    for row in rows:
        out.extend(row)
        cells.append(tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])))
    while len(cells) > 1:  # neighbours first
        cells = [joined(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return pa.Table.from_pylist([out.row(cells[0])], _schema())


def whole_spans(rows: DataFrame) -> DataFrame:
    """One span per conversation that has turns."""
    dealt = marked(rows).repartitionByRange("conv", *_ORDER).sortWithinPartitions("conv", *_ORDER)
    spans = cut(dealt.select("conv", "turn", "role", "_h", "initial", "blank", "cut_off", "again").mapInArrow(_spans, _SPAN))
    several = spans.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv")
    rest = cut(spans.join(several, "conv", "left_semi"))
    done = spans.join(several, "conv", "left_anti")
    while not rest.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rest = cut(rest.groupBy("conv", F.floor(F.col("part") / FAN).alias("_to")).applyInArrow(_join_spans, _SPAN))
    return done.unionByName(rest)


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [best(tuple(None if c is None else (c, a) for c, a in zip(costs, audits)))
                 for costs, audits in zip(batch["costs"].to_pylist(), batch["audits"].to_pylist())]
        kept = [c for c in batch.schema.names if c not in ("costs", "audits")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                                         [*kept, "cost", "audit"])


def parsed(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation that has turns."""
    spans = whole_spans(rows).mapInArrow(_best, _SPAN.replace("costs array<bigint>, audits array<string>", "cost bigint, audit string"))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    return cut(spans.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


# ---- applying an audit

def edited(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, in order; ``turns`` are the given (role, text)."""
    letters, state = iter(audit), 0

    def put(edit: str, role: str, text: str):
        nonlocal state
        state = NEXT[role[0]][state]
        return edit, role, text

    for role, text in turns:
        letter = next(letters)
        while letter == "I":
            yield put("I", ROLE[state], "")
            letter = next(letters)
        if letter == "K":
            yield put("K", role, text)
        elif letter == "R":
            yield put("R", ROLE[state], text)
    for _ in letters:
        yield put("I", ROLE[state], "")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, str, str]]]]:
    """Per conversation its repaired turns; a row with an audit opens a conversation."""

    def rows():
        for batch in bounded(batches, "text"):
            yield from zip(*(batch[c].to_pylist() for c in ("conv", "audit", "role", "text")))

    todo = rows()
    head = next(todo, None)

    def turns():
        nonlocal head
        for row in todo:
            if row[1] is not None:
                head = row
                return
            yield row[2], row[3]
        head = None

    while head is not None:
        conv, audit = head[:2]
        yield conv, edited(audit, turns())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, found = [], []
    for conv, turns in _streams(batches):
        h = hashlib.sha256()
        for k, (_, role, text) in enumerate(turns):
            h.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        names.append(conv)
        found.append(h.hexdigest())
        if len(names) == 4096:
            yield pa.RecordBatch.from_pydict({"conv": names, "repaired_sha256": found})
            names, found = [], []
    if names:
        yield pa.RecordBatch.from_pydict({"conv": names, "repaired_sha256": found})


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, turns in _streams(batches):
        held, size = [], 0
        for k, (edit, role, text) in enumerate(turns):
            held.append({"conv": conv, "place": k, "edit": edit, "role": role, "text": text})
            size += len(text)
            if size > _CHARS or len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held)


def _with_audits(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Turns of each conversation in order, behind a row with its audit."""
    none = F.lit(None).cast("string")
    turns = _ordered(rows).select("conv", none.alias("audit"), F.lit(1).alias("_kind"), *_ORDER, "text")
    heads = plan.select("conv", "audit", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("turn"), none.alias("role"), none.alias("_head"),
                        F.lit(None).cast("binary").alias("_h"), none.alias("text"))
    return turns.unionByName(heads).repartition("conv").sortWithinPartitions("conv", "_kind", *_ORDER).select("conv", "audit", "role", "text")


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the turns of the repaired conversations; ``plan`` is that of ``parsed``."""
    return _with_audits(rows, plan).mapInArrow(_turns, "conv string, place bigint, edit string, role string, text string")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost, audit and hash of the repaired turns per conversation of ``rows`` (conv_id, turn, role, text); ``ids`` has conv_id of those to
    report also if they have no turn."""
    plan = parsed(rows)
    digests = _with_audits(rows, plan).mapInArrow(_digests, "conv string, repaired_sha256 string")
    found = plan.join(digests, "conv")
    every = (rows if ids is None else ids).select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    none = hashlib.sha256().hexdigest()
    return every.join(found, "conv", "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults drawn by a checksum of ``conv_id:turn``: dropped, emptied, without sentence marks, repeated, or said to be the user's."""
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    draw = F.crc32(name.cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), draw.alias("_draw")).filter("_draw <> 0")
    text = F.when(F.col("_draw") == 1, F.lit("")).when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_draw") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")
