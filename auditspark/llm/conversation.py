"""Conversation structure repair by generalised LR parsing.

A conversation is an optional system turn and then pairs of user and assistant
turns, or nothing.  The role grammar is compiled to LR states.  The stacks of all
repairs under way form one graph: a node is an LR state with the state below it,
and the tops that a conversation has after some rows are its live repairs.  Each
row moves every top by weighted actions: keep (shift the row's own role), rerole
(shift another), delete (no shift), and before either any insert (shift without a
row).  Equal tops are merged by the least (cost, audit), so after a row at most
one repair for each state is left, and those beyond the cost of two inserts above
the best cannot win and go.  Audits of live repairs are compared by the rank of
what they had before and what they add: each ends with its row's own edit, so
none is the beginning of another.

Rows are ordered by conversation, turn (nulls first), role and text over ranges,
so a conversation of any length is sorted by many tasks.  Conversations that end
inside a task are repaired there; those that a task's rim cuts, or of more than
``SEGMENT_BYTES``, travel as segments to one task, which reads them in order and
holds a segment, a digest for each top and five bytes a row (the digest of a
whole repaired conversation is a serial value).

Nulls in any column count as one space, for the number that says what damage a
row takes as well; a null turn comes first and is left out of the gaps.  Rows of
one turn are ordered by role and text, so rows repeated there stand together.  An
empty role or one of another letter fits nowhere.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from auditspark.operators.joins import lookup_join

from .common import per_process

SPACES = " \t\n\x0b\x0c\r"
FINE, TRUNCATED, BLANK, DUPLICATE, DROPPED = range(5)
SEGMENT_BYTES = 1 << 20

#: Head and turns of a conversation; s, u and a are the initials of the roles.
GRAMMAR = (
    ("whole", ("conversation",)), ("conversation", ()), ("conversation", ("turns",)),
    ("turns", ("head", "u", "a")), ("turns", ("turns", "u", "a")),
    ("head", ()), ("head", ("s",)),
)
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
EDITS = [i + e for i in ("", "I", "II") for e in "DKR"]


class Stacks:
    """The LR states of a grammar and the graph of their stacks."""

    def __init__(self, grammar=GRAMMAR):
        self.rules, self.left = grammar, {name for name, _ in grammar}
        self.number, self.states, self.goto = {}, [], {}
        self._state({(0, k) for k in range(len(grammar)) if grammar[k][0] == grammar[0][0]})
        for state, items in enumerate(self.states):  # grows while it is read
            for symbol in sorted({s for at, k in items for s in grammar[k][1][at : at + 1]}):
                kernel = {(at + 1, k) for at, k in items if grammar[k][1][at : at + 1] == (symbol,)}
                self.goto[state, symbol] = self._state(kernel)
        self.below: dict[int, set[int]] = {0: set()}
        size = -1
        while size != sum(map(len, self.below.values())):
            size = sum(map(len, self.below.values()))
            for state in list(self.below):
                for top in self.reduced(state):
                    for symbol in {s for q, s in self.goto if q == top and s not in self.left}:
                        self._push(top, symbol)
        if any(len(b) > 1 for b in self.below.values()):
            raise ValueError("equal tops of this grammar may stand on unequal stacks")

    def _state(self, kernel: set) -> int:
        items, todo = set(kernel), list(kernel)
        while todo:
            at, k = todo.pop()
            for symbol in self.rules[k][1][at : at + 1]:
                fresh = {(0, j) for j, (name, _) in enumerate(self.rules) if name == symbol} - items
                items |= fresh
                todo += fresh
        if (key := frozenset(items)) not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _push(self, top: int, symbol: str) -> int:
        above = self.goto[top, symbol]
        self.below.setdefault(above, set()).add(top)
        return above

    def reduced(self, state: int) -> set[int]:
        """The state and the tops that reductions make of it."""
        found, todo = {state}, [state]
        while todo:
            top = todo.pop()
            for at, k in self.states[top]:
                name, symbols = self.rules[k]
                if at == len(symbols):
                    bases = reduce(lambda s, _: {b for q in s for b in self.below[q]}, symbols, {top})
                    fresh = {self._push(b, name) for b in bases if (b, name) in self.goto} - found
                    found |= fresh
                    todo += fresh
        return found

    def live(self, state: int) -> set[int]:
        """Of these the tops that can shift."""
        return {t for t in self.reduced(state) if any(q == t and s not in self.left for q, s in self.goto)}

    def shifted(self, top: int, symbol: str) -> set[int]:
        return self.live(self._push(top, symbol)) if (top, symbol) in self.goto else set()

    def accepts(self, top: int) -> bool:
        return self.goto[0, self.rules[0][1][0]] in self.reduced(top)


class Repair:
    """Actions of each kind of row, compiled from the grammar."""

    def __init__(self, stacks: Stacks):
        inserted = {}  # (top before, top after): letters of the inserted roles
        tops = sorted(stacks.below)
        for top in tops:
            level = {top: ""}
            for _ in range(3):
                for after, roles in level.items():
                    inserted.setdefault((top, after), roles)
                level = {to: roles + r for t, roles in level.items() for r in ROLES for to in stacks.shifted(t, r)}
        inserted = {k: v for k, v in inserted.items() if k[0] in set().union(*map(stacks.live, tops))}
        self.tops = sorted({t for pair in inserted for t in pair})
        place = {t: k for k, t in enumerate(self.tops)}
        self.start = [place[t] for t in stacks.live(0)]
        self.moves = {
            (initial, fault): self._moves(stacks, inserted, place, initial, fault)
            for initial in "sua " for fault in (FINE, TRUNCATED, BLANK, DUPLICATE)
        }
        #: Inserts that end a conversation, by top.
        self.ends = [
            min((roles for (a, b), roles in inserted.items() if a == t and stacks.accepts(b)), key=len, default=None)
            for t in self.tops
        ]

    @staticmethod
    def _moves(stacks, inserted, place, initial, fault):
        best: dict[tuple[int, int], tuple] = {}
        for (before, mid), roles in inserted.items():
            spent, letters = INSERT * len(roles), "I" * len(roles)
            late = UNFINISHED if fault == TRUNCATED else 0
            choices = [(spent + DELETE, letters + "D", roles, None, mid)]
            if fault in (FINE, TRUNCATED):
                choices += [(spent + late, letters + "K", roles, "", to) for to in stacks.shifted(mid, initial)]
                choices += [(spent + late + REROLE, letters + "R", roles, r, to)
                            for r in ROLES for to in stacks.shifted(mid, r)]
            for cost, letters_, roles_, role, to in choices:
                key, option = (place[before], place[to]), (cost, EDITS.index(letters_), roles_, role)
                if key not in best or (option[0], letters_) < (best[key][0], EDITS[best[key][1]]):
                    best[key] = option
        by_top: dict[int, list] = {}
        for (before, to), option in best.items():
            by_top.setdefault(to, []).append((before, *option))
        return sorted(by_top.items())


#: Order of edits as audit letters, to compare two of them by number.
_EDIT_RANK = [sorted(EDITS).index(e) for e in EDITS]


class Conversation:
    """The repairs of one conversation, row by row."""

    def __init__(self, repair: Repair):
        self.repair = repair
        self.live: list = [None] * len(repair.tops)
        for top in repair.start:
            self.live[top] = (0, 0, hashlib.sha256(), False)
        self.steps = bytearray()
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.last = None

    def row(self, turn, role: str, text: str, fault: int) -> None:
        if fault == DROPPED:
            return
        if self.last == (turn, role, text) and fault != BLANK:
            fault = DUPLICATE  # of rows that are equal in all, the first
        if turn is not None and (self.n == 0 or self.last[0] != turn):
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.n:
            self.illegal += self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        self.last = (turn, role, text)
        self.n += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self._advance(role, text, fault)

    def _advance(self, role: str, text: str, fault: int) -> None:
        live, chosen = self.live, []
        initial = role[:1] if role[:1] in ("s", "u", "a") else " "
        for to, options in self.repair.moves[initial, fault]:
            best = None
            for before, cost, edit, roles, new in options:
                top = live[before]
                if top is not None:
                    option = (top[0] + cost, top[1], _EDIT_RANK[edit], before, edit, roles, new)
                    if best is None or option[:3] < best[:3]:
                        best = option
            if best is not None:
                chosen.append((to, best))
        limit = min(b[0] for _, b in chosen) + 2 * INSERT
        chosen = [c for c in chosen if c[1][0] <= limit]
        rank = {k: r for r, k in enumerate(sorted({b[1:3] for _, b in chosen}))}
        self.live = [None] * len(live)
        step = bytearray(b"\xff" * len(live))
        for to, (cost, was, edit_rank, before, edit, roles, new) in chosen:
            _, _, digest, begun = live[before]
            lines = [ROLES[r] + ":" for r in roles]
            if new is not None:
                lines.append((ROLES[new] if new else role) + ":" + text)
            if lines:
                digest = digest.copy()
                digest.update((("\n" if begun else "") + "\n".join(lines)).encode())
            self.live[to] = (cost, rank[was, edit_rank], digest, begun or bool(lines))
            step[to] = before * len(EDITS) + edit
        self.steps += step

    def result(self) -> tuple:
        if not self.n:
            return 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()
        ends = [
            (top[0] + INSERT * len(roles), top[1], len(roles), k)
            for k, (top, roles) in enumerate(zip(self.live, self.repair.ends))
            if top is not None and roles is not None
        ]
        cost, _, _, at = min(ends)
        _, _, digest, begun = self.live[at]
        lines = [ROLES[r] + ":" for r in self.repair.ends[at]]
        if lines:
            digest = digest.copy()
            digest.update((("\n" if begun else "") + "\n".join(lines)).encode())
        edits, width = ["I" * len(lines)], len(self.live)
        for row in range(self.n - 1, -1, -1):
            before, edit = divmod(self.steps[row * width + at], len(EDITS))
            edits.append(EDITS[edit])
            at = before
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        audit = "".join(reversed(edits))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()


def spaced(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows conv, turn, role and text with the faults that the number of
    ``conv_id:turn`` says; a dropped row keeps its place without its text."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    given = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"),
        spaced("text").alias("text"), kind.alias("kind"),
    )
    dropped = F.col("kind") == 0
    return given.select(
        "conv", "turn",
        F.when(~dropped, F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))).alias("role"),
        F.when(~dropped, text.otherwise(F.col("text"))).alias("text"),
        F.explode(F.array_repeat(dropped, F.when(F.col("kind") == 3, 2).otherwise(1))).alias("dropped"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with the first fault of each.  A row is a duplicate if its conversation
    has its role and text at an earlier turn; equal rows of one turn are left to the
    reader in order.  Only keys that occur twice are joined back."""
    solid = F.rtrim("text", F.lit(SPACES))
    key = F.md5(F.concat(F.to_json(F.struct("conv")), F.md5(F.col("role").cast("binary")), F.col("text")).cast("binary"))
    rows = rows.withColumn("key", F.when(solid != "", key))
    seen = rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("null_first")
    )
    rows = lookup_join(rows, seen.where("n > 1").drop("n"), ["key"], "left", spread_by=["conv", "turn"])
    later = F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("first")))
    fault = (
        F.when(F.col("dropped"), DROPPED).when(F.col("key").isNull(), BLANK)
        .when(F.coalesce(later, F.lit(False)), DUPLICATE)
        .when(F.right(solid, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    )
    return rows.select("conv", "turn", "role", "text", fault.cast("int").alias("fault"))


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """For each conversation of rows conv, turn, role, text and fault the cheapest repair."""
    conv = rows.schema["conv"]
    counted = [T.StructField(n, T.LongType()) for n in _RESULT[:6]]
    found = [T.StructField("conv", conv.dataType), *counted, *[T.StructField(n, T.StringType()) for n in _RESULT[6:]]]
    lists = (T.LongType(), T.StringType(), T.StringType(), T.IntegerType())
    cut = [T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())] + [
        T.StructField(n, T.ArrayType(t)) for n, t in zip(("turns", "roles", "texts", "faults"), lists)
    ]
    whole, sent = to_arrow_schema(T.StructType(found)), to_arrow_schema(T.StructType(found + cut))

    def compiled() -> Repair:
        return per_process("conversation repair", lambda: Repair(Stacks()))

    def table(out: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
            )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out = TaskContext.get().partitionId(), 0, []
        key, held, size, is_cut = None, [], 0, True  # the first may have begun in another task

        def segment() -> tuple:
            return (key, *[None] * 8, part, seq, *map(list, zip(*held)))

        begun = False
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if begun and row[0] != key:
                    if is_cut:
                        out.append(segment())
                        seq += 1
                    else:
                        conversation = Conversation(compiled())
                        for r in held:
                            conversation.row(*r)
                        out.append((key, *conversation.result(), *[None] * 6))
                    held, size, is_cut = [], 0, False
                elif size > segment_bytes:
                    is_cut = True
                    out.append(segment())
                    seq += 1
                    held, size = [], 0
                begun, key = True, row[0]
                held.append(row[1:])
                size += len(row[3] or "") + 64
                if len(out) >= 512 or size > segment_bytes:
                    yield from table(out, sent)
                    out = []
        if held:
            out.append(segment())
        yield from table(out, sent)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, conversation = [], None, None
        for batch in batches:
            for start in range(batch.num_rows):  # a segment at a time
                row = [c[0].as_py() for c in batch.slice(start, 1).columns]
                if conversation is not None and row[0] != key:
                    out.append((key, *conversation.result()))
                    conversation = None
                if row[1] is not None:
                    out.append(tuple(row[:9]))
                else:
                    key = row[0]
                    conversation = conversation or Conversation(compiled())
                    for r in zip(*row[11:]):
                        conversation.row(*r)
            yield from table(out, whole)
            out = []
        if conversation is not None:
            yield from table([(key, *conversation.result())], whole)

    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.mapInArrow(within, T.StructType(found + cut))
    together = pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return together.mapInArrow(across, T.StructType(found))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation after the damage of ``damaged``."""
    found = repaired(with_faults(damaged(conversations.select("conv_id", "turn", "role", "text"))))
    return found.withColumnRenamed("conv", "conv_id")
