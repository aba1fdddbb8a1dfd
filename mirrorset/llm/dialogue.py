"""Cheapest repair of conversations, by iterative-deepening A*.

A conversation is a sequence of rows; a repair keeps, reroles or deletes each row and inserts empty
ones, so that role initials read ``(s?(ua)+)?``. Initials of the edits in order are the audit. The
search goes depth first through edits in ASCII order (D, I, K, R) under a cost bound that rises to
the least cost that went beyond it. A table keeps, for each state that failed, how much budget it
needs at least; a state with less is not entered again. So the first accepting path is the cheapest,
and of equally cheap ones the ASCII-least.

Rows are dealt out by ranges of (conversation, turn), so that a long conversation lies in many
tasks. A conversation inside one range is repaired there. One that may go on in the next range is
cut into pieces of ``PIECE`` rows: each piece is searched from every automaton state to every other
where it lies, and the few best paths are then joined along the conversation. Equal costs compare
by audit there too: within a piece, no audit is the beginning of an equally dear one, as both use
all rows. Only the digest, which runs through a text from its start, is taken in one stream.

Results that are defined here: null text and role are one space (so blank, and of no known
initial); null turns come first and count in no gap; rows of one turn go by a hash of role and text,
then role and text; null ids are one conversation; a conversation without rows has zeros, no audit
and the digest of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged, tidy

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows that are searched at once.
PIECE = 32
#: Pieces of a conversation that a task holds before it knows whether the conversation ends in its range.
HELD = 128
FOUND = -1

START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
#: The role that an inserted or reroled row takes in each state, and the state after it.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {"user": USER, "assistant": ASSISTANT}
#: The state after a kept row, by state and initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Line:
    """One row: a blank or repeated one must go."""

    role: str
    text: str
    blank: bool
    repeated: bool

    @property
    def initial(self) -> str:
        return self.role[:1]

    @property
    def doomed(self) -> bool:
        return self.blank or self.repeated

    @property
    def truncated(self) -> bool:
        return not self.doomed and self.text.rstrip(BLANKS)[-1] not in ".!?"


def line(role: str, text: str, repeated: bool) -> Line:
    return Line(role, text, not text.strip(BLANKS), repeated)


def least_costs(lines: list[Line]) -> list[int]:
    """For each row, a cost that the rows from there on need at least.

    Doomed rows cost their deletion, truncated ones their mark (a deletion costs more). An edit
    beyond these, which undoes at most two illegal neighbours, costs 3, or 1 more where a truncated
    row is deleted.
    """
    bounds = [0] * (len(lines) + 1)
    forced, bad, dear, following = 0, 0, REROLE, None
    for i in range(len(lines) - 1, -1, -1):
        if lines[i].doomed:
            forced += DELETE
        else:
            if lines[i].truncated:
                forced, dear = forced + TRUNCATED, DELETE - TRUNCATED
            if following is not None and lines[i].initial + following not in LEGAL:
                bad += 1
            following = lines[i].initial
        bounds[i] = forced + dear * -(-bad // 2)
    return bounds


class Search:
    """Iterative-deepening A* over (row, state)."""

    def __init__(self, lines: list[Line], goals: tuple[int, ...]):
        self.lines, self.goals, self.least = lines, goals, least_costs(lines)
        self.needs: dict[tuple[int, int], int] = {}

    def _steps(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, cost, next row, next state) in ASCII order."""
        role = NEXT[state]
        here = self.lines[i] if i < len(self.lines) else None
        if here is not None:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, AFTER[role]
        if here is not None and not here.doomed:
            mark = TRUNCATED * here.truncated
            if (state, here.initial) in KEPT:
                yield "K", KEEP + mark, i + 1, KEPT[state, here.initial]
            yield "R", REROLE + mark, i + 1, AFTER[role]

    def _within(self, i: int, state: int, budget: int, path: list[str]) -> int:
        """``FOUND`` when ``path`` now leads to a goal within the budget, else the least budget that may do."""
        if i == len(self.lines) and state in self.goals:
            return FOUND
        least = max(self.least[i], self.needs.get((i, state), 0))
        if least > budget:
            return least
        needed = []
        for edit, cost, j, after in self._steps(i, state):
            if cost > budget:
                needed.append(cost + self.least[j])
                continue
            path.append(edit)
            rest = self._within(j, after, budget - cost, path)
            if rest == FOUND:
                return FOUND
            path.pop()
            needed.append(cost + rest)
        self.needs[i, state] = min(needed)
        return self.needs[i, state]

    def run(self, state: int) -> tuple[int, str]:
        """(cost, audit) of the cheapest path from a state at the first row; a goal must be in reach."""
        bound = self.least[0]
        while True:
            path: list[str] = []
            more = self._within(0, state, bound, path)
            if more == FOUND:
                return self._cost(path, state), "".join(path)
            bound = more

    def _cost(self, path: list[str], state: int) -> int:
        i, total = 0, 0
        for edit in path:
            cost, i, state = next(x[1:] for x in self._steps(i, state) if x[0] == edit)
            total += cost
        return total


def reachable(lines: list[Line], start: int, goal: int) -> bool:
    if goal == START:
        return start == START
    if goal == SYSTEM:
        return start == SYSTEM or start == START and any(x.initial == "s" and not x.doomed for x in lines)
    return True


def paths_between(lines: list[Line]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of the cheapest path between any two states."""
    out = []
    for goal in range(4):
        search = Search(lines, (goal,))
        out += [(start, goal, *search.run(start)) for start in range(4) if reachable(lines, start, goal)]
    return out


def cheapest(lines: list[Line]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return Search(lines, ACCEPTING).run(START)


def repaired(lines: list[Line], audit: str, state: int = START) -> tuple[list[str], int]:
    """The ``role:text`` lines that an audit leaves, and the state after them."""
    out, i = [], 0
    for edit in audit:
        here = lines[i] if edit != "I" else None
        i += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            out.append(f"{here.role}:{here.text}")
            state = KEPT[state, here.initial]
        else:
            out.append(f"{NEXT[state]}:{here.text if here else ''}")
            state = AFTER[NEXT[state]]
    return out, state


@dataclass
class Path:
    """A way through the pieces so far: its cost, last audit, and digest."""

    cost: int
    audit: str
    before: Path | None
    digest: "hashlib._Hash"
    started: bool = False

    def audits(self, stop: Path | None = None) -> str:
        parts, at = [], self
        while at is not None and at is not stop:
            parts.append(at.audit)
            at = at.before
        return "".join(reversed(parts))


def _audit_below(x: Path, x_last: str, y: Path, y_last: str) -> bool:
    """Whether the first audit sorts first; both are compared from where they part."""
    a, b = x, y
    while a is not b:
        a, b = a.before, b.before
    return x.audits(a) + x_last < y.audits(b) + y_last


@dataclass
class Conversation:
    """Joins the pieces of one conversation in order."""

    paths: dict[int, Path] = field(default_factory=lambda: {START: Path(0, "", None, hashlib.sha256())})
    counts: dict[str, int] = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
    low: int | None = None
    high: int | None = None
    turns: int = 0
    last: str | None = None

    def counted(self, lines: list[Line], turns: list[int | None]) -> None:
        for x, turn in zip(lines, turns):
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.high
                self.high = turn
            self.counts["blank"] += x.blank
            self.counts["duplicate"] += x.repeated and not x.blank
            self.counts["truncated"] += x.truncated
            self.counts["illegal"] += self.last is not None and self.last + x.initial not in LEGAL
            self.last = x.initial

    def joined(self, lines: list[Line], between: list[tuple[int, int, int, str]]) -> None:
        """Go on by one piece along the best path to each state."""
        best: dict[int, tuple[int, int, str]] = {}
        for start, goal, cost, audit in between:
            if start not in self.paths:
                continue
            total = self.paths[start].cost + cost
            held = best.get(goal)
            if held is None or total < held[0] or total == held[0] and _audit_below(self.paths[start], audit, self.paths[held[1]], held[2]):
                best[goal] = (total, start, audit)
        after = {}
        for goal, (total, start, audit) in best.items():
            path = self.paths[start]
            digest, told = path.digest.copy(), repaired(lines, audit, start)[0]
            if told:
                digest.update(("\n" * path.started + "\n".join(told)).encode())
            after[goal] = Path(total, audit, path, digest, path.started or bool(told))
        self.paths = after

    def whole(self, lines: list[Line]) -> None:
        """All rows at once."""
        if len(lines) > PIECE:
            for at in range(0, len(lines), PIECE):
                piece = lines[at : at + PIECE]
                self.joined(piece, paths_between(piece))
        else:
            cost, audit = cheapest(lines)
            state = repaired(lines, audit)[1]
            self.joined(lines, [(START, state, cost, audit)])

    def result(self) -> tuple:
        ends = [self.paths[s] for s in ACCEPTING if s in self.paths]
        best = min(ends, key=lambda p: (p.cost, p.audits()))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts.values(), best.cost, best.audits(), best.digest.hexdigest())


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROWS = "turns array<bigint>, roles array<string>, texts array<string>, repeated array<boolean>, paths array<struct<start:int,goal:int,cost:bigint,audit:string>>"
_NO_RESULT, _NO_ROWS = (None,) * 8, (None,) * 5


def ordered_rows(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """Rows in ranges of (conversation, turn), each with whether its role and text came earlier.

    ``keep`` says which rows are there; those that are not only name their conversation.
    """
    live = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    plain = rows.select(
        F.col("conv_id").alias("c"),
        F.when(live, F.col("turn").cast("bigint")).alias("turn"),
        F.when(live, F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(live, F.coalesce("text", F.lit(" "))).alias("text"),
        live.alias("live"),
    ).withColumn("tie", F.xxhash64("role", "text"))
    first = Window.partitionBy("c", "live", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = plain.withColumn("repeated", F.row_number().over(first) > 1)
    return marked.repartitionByRange("c", F.col("turn").asc_nulls_first(), "tie").sortWithinPartitions(
        F.col("c").asc_nulls_first(), F.col("turn").asc_nulls_first(), "tie", "role", "text"
    )


def _columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    listed = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(listed, schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _schema(key: pa.DataType, *more: tuple[str, pa.DataType]) -> pa.Schema:
    number, words = pa.int64(), pa.string()
    result = [("c", key)] + [(n, number) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([*result, ("audit", words), ("repaired_sha256", words), *more])


def _batched(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + sum(len(x) for x in row if isinstance(x, (str, list)))
        if size > 100_000:
            yield _columns(schema, held)
            held, size = [], 0
    yield _columns(schema, held)


def _repair_ranges(key: pa.DataType) -> Callable:
    """Results of the conversations inside a range; pieces of its first and its last one."""
    words, number = pa.string(), pa.int64()
    path = pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", number), ("audit", words)])
    schema = _schema(
        key,
        ("part", number), ("no", number), ("turns", pa.list_(number)), ("roles", pa.list_(words)), ("texts", pa.list_(words)),
        ("repeated", pa.list_(pa.bool_())), ("paths", pa.list_(path)),
    )

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        """(conversation, its number in the range, number of the piece, lines, turns), a piece at a time."""
        at, name, no, lines, turns = -1, None, 0, [], []
        for c, turn, role, text, live, repeated in rows:
            if at < 0 or c != name:
                if at >= 0:
                    yield name, at, no, lines, turns
                at, name, no, lines, turns = at + 1, c, 0, [], []
            elif len(lines) == PIECE:
                yield name, at, no, lines, turns
                no, lines, turns = no + 1, [], []
            if live:
                lines.append(line(role, text, repeated))
                turns.append(turn)
        if at >= 0:
            yield name, at, no, lines, turns

    def told(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        def opened(piece: tuple) -> tuple:
            name, _, no, lines, turns = piece
            between = [dict(zip(("start", "goal", "cost", "audit"), x)) for x in paths_between(lines)]
            return (name, *_NO_RESULT, part, no, turns, [x.role for x in lines], [x.text for x in lines], [x.repeated for x in lines], between)

        def closed(held: list[tuple]) -> tuple:
            talk = Conversation()
            for *_, lines, turns in held:
                talk.counted(lines, turns)
            talk.whole([x for *_, lines, _ in held for x in lines])
            return (held[0][0], *talk.result(), part, -1, *_NO_ROWS)

        held: list[tuple] = []
        at, split = 0, True  # the first conversation may have begun in the range before
        for piece in pieces(rows):
            if piece[1] != at:
                if not split:
                    yield closed(held)
                held, at, split = [], piece[1], False
            held.append(piece)
            if split or len(held) > HELD:
                yield from map(opened, held)
                held, split = [], True
        yield from map(opened, held)  # the last one may go on in the next range

    @tidy
    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _runs(batches, ["c", "turn", "role", "text", "live", "repeated"])
        yield from _batched(schema, told(TaskContext.get().partitionId(), rows))

    return repair


def _join_pieces(key: pa.DataType) -> Callable:
    schema = _schema(key)

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        name, talk = None, None
        for c, turns, roles, texts, repeated, paths in rows:
            if talk is None or c != name:
                if talk is not None:
                    yield (name, *talk.result())
                name, talk = c, Conversation()
            lines = [line(*x) for x in zip(roles, texts, repeated)]
            talk.counted(lines, turns)
            talk.joined(lines, [(p["start"], p["goal"], p["cost"], p["audit"]) for p in paths])
        if talk is not None:
            yield (name, *talk.result())

    @tidy
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(schema, joined(_runs(batches, ["c", "turns", "roles", "texts", "repeated", "paths"])))

    return join


def repair_conversations(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """One row per ``conv_id`` with its faults, the cheapest repair's cost and audit, and the digest of what it leaves.

    ``rows`` have conv_id, turn, role, text; see :func:`ordered_rows` for ``keep``.
    """
    key = rows.schema["conv_id"].dataType
    kind = f"c {key.simpleString()}, {RESULT}"
    arrow = pa.int64() if key.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    if not pa.types.is_int64(arrow) and key.simpleString() != "string":
        raise ValueError("conv_id must be a whole number or a string")
    wide = rows.withColumn("conv_id", F.col("conv_id").cast("bigint")) if pa.types.is_int64(arrow) else rows
    kind = kind.replace(key.simpleString(), "bigint", 1) if pa.types.is_int64(arrow) else kind
    cut = staged(ordered_rows(wide, keep).mapInArrow(_repair_ranges(arrow), f"{kind}, part bigint, no bigint, {ROWS}"), "conversations")
    closed = cut.where("no < 0").select("c", *(x.split()[0] for x in RESULT.split(", ")))
    pieces = cut.where("no >= 0").select("c", "part", "no", "turns", "roles", "texts", "repeated", "paths")
    joined = pieces.repartition("c").sortWithinPartitions("c", "part", "no").mapInArrow(_join_pieces(arrow), kind)
    return closed.unionByName(joined).withColumnRenamed("c", "conv_id").withColumn("conv_id", F.col("conv_id").cast(key))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the faults that their ids draw, and which of them are there still."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    drawn = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), "draw", F.explode(times).alias("copy"))
    return out, F.col("draw") != 0
