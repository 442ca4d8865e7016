"""Conversation structure repair: the cheapest edits that make roles alternate, by a Viterbi search that streams.

Rows of a conversation are read by turn. Blank rows and repeats must go, others are kept, given the role user or assistant, or
deleted, and empty user or assistant rows may be inserted, so that the roles read `(s?(ua)+)?`. The search holds one
survivor for each of the automaton's four states. Survivors are leaves of a tree of backpointers with reference counts: a branch no survivor
needs is freed at once, and as soon as all survivors share an ancestor, the edits up to it are final and are sent on.
What is held is the part not yet decided, never a conversation.

Equal costs are settled by the least audit (the initials of all edits). Survivors carry the rank of their whole audit among each
other: audits of different survivors have as many row letters and end in one, so none is a prefix of another, and
extending them keeps their order. Comparing (rank, new letters) is therefore comparing the complete unresolved audits.
A survivor that costs more than another one and the dearest way from that one's state to every end of its own can win nothing and is dropped.

Rows reach their task by conversation, sorted by turn (nulls first), role and text; the sort spills. A conversation's digest
is sequential, so a conversation is one stream in one task, in bounded memory. Repeats are found before, by sums per text.

Defined results: null role or text counts as one space; a null conv_id is a conversation; rows of one turn are ordered by
role and text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulespark.session import small_side

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1

# The automaton of (s?(ua)+)?: nothing yet, after s, after u, after a. It may end in NONE or ASSISTANT.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {NONE: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ENDING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

BLANK, REPEATED, CUT = "blank", "duplicate", "truncated"

# How much dearer the rest may be from the first state than from the second, at most.
SLACK = {
    (ASSISTANT, NONE): 3, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 2, (USER, NONE): 5, (USER, SYSTEM): 2, (USER, ASSISTANT): 2,
    (NONE, SYSTEM): 0, (NONE, USER): 2, (NONE, ASSISTANT): 0, (SYSTEM, NONE): 4, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 4,
}


def _inserted(state: int) -> Iterator[tuple[int, str]]:
    """States within reach by inserting rows; more than two never pay."""
    yield state, ""
    one = NEXT[state, WANTED[state][0]]
    yield one, INSERT
    yield NEXT[one, WANTED[one][0]], INSERT * 2


def _steps(initial: str, must_go: bool, cut: bool) -> list[tuple[int, int, str, int]]:
    """(from, cost, letters, to): the best way through one row between any two states."""
    best: dict = {}
    for start in (NONE, SYSTEM, USER, ASSISTANT):
        for state, letters in _inserted(start):
            ways = [(state, DELETE, 0)]
            if not must_go:
                ways.append((NEXT[state, WANTED[state][0]], REROLE, cut))
                if (state, initial) in NEXT:
                    ways.append((NEXT[state, initial], KEEP, cut))
            for to, letter, extra in ways:
                way = (COST[INSERT] * len(letters) + COST[letter] + TRUNCATED_COST * extra, letters + letter)
                best[start, to] = min(best.get((start, to), way), way)
    return [(start, cost, letters, to) for (start, to), (cost, letters) in best.items()]


STEPS = {(i, go, cut): _steps(i, go, cut) for i in ("s", "u", "a", "") for go in (False, True) for cut in (False, True)}


class Node:
    """An edit of one row: its letters, the row, and how many nodes or survivors need it."""

    __slots__ = ("parent", "letters", "row", "kids", "held")

    def __init__(self, parent: Node | None, letters: str, row: tuple | None):
        self.parent, self.letters, self.row, self.kids, self.held = parent, letters, row, [], 0
        if parent is not None:
            parent.kids.append(self)


class Repair:
    """One conversation's search; `add` and `end` give the edits that have become final, as (letter, role, text, fault)."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.root.held = 1
        self.survivors = {NONE: (0, 0, self.root)}  # state: cost, rank of the audit, node
        self.state = NONE  # of the edits sent so far
        self.waiting = self.most_waiting = 0
        self.cost = 0

    def add(self, role: str, text: str, fault: str | None) -> Iterator[tuple]:
        row = (role, text, fault)
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        reached: dict = {}
        for start, cost, letters, to in STEPS[initial, fault in (BLANK, REPEATED), fault == CUT]:
            if start in self.survivors:
                paid, rank, _ = self.survivors[start]
                way = (paid + cost, rank, letters, start)
                if to not in reached or way < reached[to]:
                    reached[to] = way
        for state in list(reached):
            if any(other != state and reached[state][0] > way[0] + SLACK[other, state] for other, way in reached.items()):
                del reached[state]
        order = sorted(reached, key=lambda state: reached[state][1:3])
        before, self.survivors = self.survivors, {}
        for rank, state in enumerate(order):
            cost, _, letters, start = reached[state]
            node = Node(before[start][2], letters, row)
            node.held = 1
            self.waiting += 1
            self.survivors[state] = (cost, rank, node)
        for _, _, node in before.values():
            node.held -= 1
            self._free(node)
        self.most_waiting = max(self.most_waiting, self.waiting)
        yield from self._settled()

    def _free(self, node: Node) -> None:
        while node is not self.root and not node.kids and not node.held:
            node.parent.kids.remove(node)
            self.waiting -= 1
            node = node.parent

    def _settled(self) -> Iterator[tuple]:
        while len(self.root.kids) == 1 and not self.root.held:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.waiting -= 1
            yield from self._sent(self.root.letters, self.root.row)

    def _sent(self, letters: str, row: tuple | None) -> Iterator[tuple]:
        for letter in letters:
            if letter == DELETE:
                yield letter, None, None, row[2]
                continue
            role, text, fault = (WANTED[self.state], "", None) if letter == INSERT else row
            if letter == REROLE:
                role = WANTED[self.state]
            self.state = NEXT[self.state, role[0]]
            yield letter, role, text, fault

    def end(self) -> Iterator[tuple]:
        self.cost, _, state = min((cost + COST[INSERT] * len(ENDING[state]), rank, state) for state, (cost, rank, _) in self.survivors.items())
        for other, (_, _, node) in self.survivors.items():
            if other != state:
                node.held -= 1
                self._free(node)
        self.survivors[state][2].held -= 1
        yield from self._settled()
        yield from self._sent(ENDING[state], None)


def damaged_key(conv_id: Column, turn: Column) -> Column:
    return F.concat_ws(":", F.coalesce(conv_id.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults dealt by the rows' keys: lost, emptied, unended, repeated or made user's."""
    fault = F.crc32(damaged_key(F.col("conv_id"), F.col("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


_CHARACTER = r"[^\x20\x09-\x0D]"


def _ordered(rows: DataFrame) -> DataFrame:
    """A conversation's rows in one task, in order, with their own fault and whether their text came at an earlier turn."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2("text", 256)
    keyed = rows.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d"), F.struct("turn").alias("t"))
    firsts = keyed.groupBy("c", "r", "d").agg(F.min("t").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("d"))
    joined = rows.join(small_side(firsts), same, "left")
    own = (
        F.when(~F.col("text").rlike(_CHARACTER), BLANK)
        .when(~F.coalesce(F.struct("turn").eqNullSafe(F.col("first")), F.lit(True)) & F.col("first").isNotNull(), REPEATED)
        .when(F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"), CUT)
    )
    out = joined.select("conv_id", "turn", "role", "text", own.alias("fault"))
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _faults(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Adds repeats within a turn: they follow each other."""
    last = None
    for conv_id, turn, role, text, fault in rows:
        now = (conv_id, turn, role, text)
        yield conv_id, turn, role, text, REPEATED if now == last and fault != BLANK else fault
        last = now


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, stream of its rows); a stream must be used up before the next one is asked for."""
    row = next(rows, None)
    while row is not None:
        conv_id = row[0]

        def own():
            nonlocal row
            while row is not None and row[0] == conv_id:
                yield row
                row = next(rows, None)

        stream = own()
        yield conv_id, stream
        for _ in stream:
            pass


def repair_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, pos, edit, role, text, fault) of ordered (conv_id, turn, role, text, fault) rows."""
    for conv_id, own in _conversations(_faults(rows)):
        search, pos = Repair(), 0
        for _, _, role, text, fault in own:
            for edit in search.add(role, text, fault):
                yield conv_id, pos, *edit
                pos += 1
        for edit in search.end():
            yield conv_id, pos, *edit
            pos += 1


def summary_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A row per conversation: what was wrong, what the repair costs, its edits and the digest of the repaired text."""
    for conv_id, own in _conversations(_faults(rows)):
        search, audit, sha, some = Repair(), [], hashlib.sha256(), False
        found = {BLANK: 0, REPEATED: 0, CUT: 0, None: 0}
        least = most = before = None
        turns = illegal = 0

        def take(edits):
            nonlocal some
            for letter, role, text, _ in edits:
                audit.append(letter)
                if role is not None:
                    sha.update((("\n" if some else "") + role + ":").encode())
                    sha.update(text.encode())
                    some = True

        for _, turn, role, text, fault in own:
            found[fault] += 1
            if turn is not None and turn != most:
                least = turn if least is None else least
                most, turns = turn, turns + 1
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            take(search.add(role, text, fault))
        take(search.end())
        gaps = 0 if most is None else most - least + 1 - turns
        yield conv_id, gaps, found[BLANK], found[REPEATED], found[CUT], illegal, search.cost, "".join(audit), sha.hexdigest()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size=lambda row: 1, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


REPAIRED = "conv_id {0}, pos long, edit string, role string, text string, fault string"
SUMMARY = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def repair(rows: DataFrame) -> DataFrame:
    """Every edit of every conversation, in order: conv_id, pos, edit (K, R, D, I), repaired role and text, the row's fault."""
    ddl = REPAIRED.format(rows.schema["conv_id"].dataType.simpleString())
    schema = _arrow(ddl)
    size = lambda row: 256 + len(row[4] or "")
    return _ordered(rows).mapInArrow(lambda batches: _batched(repair_rows(_rows(batches)), schema, size, 4 << 20), ddl)


def summarise(rows: DataFrame) -> DataFrame:
    """A row per conversation that has rows: counts of faults, the repair's cost and audit, the repaired text's digest."""
    ddl = SUMMARY.format(rows.schema["conv_id"].dataType.simpleString())
    schema = _arrow(ddl)
    size = lambda row: 256 + len(row[7])
    return _ordered(rows).mapInArrow(lambda batches: _batched(summary_rows(_rows(batches)), schema, size, 4 << 20), ddl)


def audited(rows: DataFrame) -> DataFrame:
    """`summarise` of the damaged rows, with a row of zeros for conversations that lost every row."""
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    done = summarise(damage(rows))
    both = ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
