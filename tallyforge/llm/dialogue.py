"""Repair of damaged conversations by the cheapest edits, found by a Viterbi search with survivor coalescence.

The roles of a sound conversation spell `s?(ua)+` by their initials, or nothing. The search keeps the best way into each
state of that pattern; ways are leaves of one tree of back pointers, whose nodes count their references. As soon as all
survivors share an ancestor, the edits up to it are final: they are emitted, and their nodes and rows are given up. What is
held of a conversation is so the stretch on which survivors still differ, and equally cheap ways are told apart by all of it.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
RELABEL, REMOVE, INSERT, UNFINISHED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept role's initial; other initials can't be kept.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after an inserted or relabelled message: the one role that may come next.
NEXT = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}
#: Edits that may wait before a first look for a common ancestor.
WAIT = 64


class _Node:
    """An edit with its predecessor; refs counts its children and the survivors that end here."""

    __slots__ = ("edit", "parent", "refs", "depth")

    def __init__(self, edit: str, parent: _Node | None):
        self.edit, self.parent, self.refs = edit, parent, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.refs += 1


def _release(node: _Node) -> None:
    while not node.refs and node.parent:
        node = node.parent
        node.refs -= 1


def _before(a: _Node, b: _Node) -> bool:
    """Whether the edits up to `a` are ASCII-smaller than those up to `b`, compared from their common ancestor on."""
    one, other = [], []
    while a is not b:
        if a.depth >= b.depth:
            one.append(a.edit)
            a = a.parent
        else:
            other.append(b.edit)
            b = b.parent
    return one[::-1] < other[::-1]


class Survivors:
    """The search over one conversation: `step` takes a row's fault and initial and returns the edits that became final."""

    def __init__(self):
        self.root, self.ways, self.look = _Node("", None), [None] * 4, WAIT
        self._offer(self.ways, START, 0, self.root)
        self._insert()

    def _offer(self, ways: list, state: int, cost: int, node: _Node) -> bool:
        """Take a way into a state if it is cheaper, or as cheap and ASCII-smaller."""
        old = ways[state]
        if old and (cost > old[0] or cost == old[0] and not _before(node, old[1])):
            _release(node)
            return False
        node.refs += 1
        ways[state] = cost, node
        if old:
            old[1].refs -= 1
            _release(old[1])
        return True

    def _insert(self) -> None:
        """Insertions after a row, and ways given up that can't win: a later state does all that an earlier one can, but keep a system row."""
        moved = True
        while moved:
            moved = False
            for state, way in enumerate(self.ways):
                if way and (not self.ways[NEXT[state]] or way[0] + INSERT <= self.ways[NEXT[state]][0]):
                    moved |= self._offer(self.ways, NEXT[state], way[0] + INSERT, _Node("I", way[1]))
        best = self.ways[ASSISTANT][0]
        for state, saved in ((START, REMOVE), (SYSTEM, 0)):
            if self.ways[state] and self.ways[state][0] > best + saved:
                node = self.ways[state][1]
                self.ways[state] = None
                node.refs -= 1
                _release(node)

    def step(self, fault: int, initial: str) -> str:
        new, usable, extra = [None] * 4, fault not in (BLANK, DUPLICATE), UNFINISHED if fault == TRUNCATED else 0
        for state, way in enumerate(self.ways):
            if way:
                cost, node = way
                self._offer(new, state, cost + REMOVE, _Node("D", node))
                if usable:
                    self._offer(new, NEXT[state], cost + RELABEL + extra, _Node("R", node))
                    if (state, initial) in KEPT:
                        self._offer(new, KEPT[state, initial], cost + extra, _Node("K", node))
        old, self.ways = self.ways, new
        for way in old:
            if way:
                way[1].refs -= 1
                _release(way[1])
        self._insert()
        return self._final(self.ways[ASSISTANT][1]) if self.ways[ASSISTANT][1].depth >= self.look else ""

    def _final(self, leaf: _Node) -> str:
        """The edits up to the deepest node that all survivors come from, which becomes the root."""
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        done = []
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            done.append(self.root.edit)
        self.look = self.root.depth + max(WAIT, 2 * len(path))
        return "".join(done)

    def end(self) -> tuple[int, str]:
        """The cost of the best whole way, and its edits that weren't final yet."""
        ends = [w for w in (self.ways[START], self.ways[ASSISTANT]) if w]
        cost, node = ends[0]
        for other, leaf in ends[1:]:
            if other < cost or other == cost and _before(leaf, node):
                cost, node = other, leaf
        edits = []
        while node is not self.root:
            edits.append(node.edit)
            node = node.parent
        return cost, "".join(reversed(edits))


class _Conversation:
    """One conversation read in order: faults are counted, final edits applied, and the repaired messages hashed as they come."""

    def __init__(self, conv_id):
        self.conv_id, self.search, self.rows, self.audit, self.hash = conv_id, Survivors(), deque(), [], hashlib.sha256()
        self.faults, self.illegal, self.last, self.turns, self.low, self.high = [0] * 4, 0, None, 0, None, None
        self.state, self.kept, self.messages, self.seen = START, 0, [], False

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if self.seen and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.turns, self.high, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        self.seen, self.last = True, role[:1]
        self.faults[fault] += 1
        self.rows.append((turn, role, text))
        self._apply(self.search.step(fault, role[:1]))

    def _apply(self, edits: str) -> None:
        for edit in edits:
            turn, role, text = (None, "", "") if edit == "I" else self.rows.popleft()
            if edit in "IR":
                self.state = NEXT[self.state]
                role = "user" if self.state == USER else "assistant"
            elif edit == "K":
                self.state = KEPT[self.state, role[:1]]
            if edit != "D":
                self.hash.update((f"\n{role}:{text}" if self.kept else f"{role}:{text}").encode())
                self.kept += 1
            self.messages.append((edit, turn, role, text))
        self.audit.append(edits)

    def end(self) -> tuple:
        cost, edits = self.search.end()
        self._apply(edits)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = [*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
MESSAGES = [T.StructField(c, T.LongType() if c in ("place", "turn") else T.StringType()) for c in ("place", "edit", "turn", "role", "text")]
_ROWS = 4096


def _ordered(rows: DataFrame, present: str | None) -> DataFrame:
    """Rows by conversation in order, each with its first fault. One shuffle by conversation carries both the window and the order."""
    there = F.col(present) if present else F.lit(True)
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), there.alias("there"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "there").orderBy(F.asc_nulls_first("turn"))) > 1
    ink = F.rtrim("text", F.lit(SPACE))
    fault = F.when(ink == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.right(ink, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    dealt = own.repartition("conv_id").withColumn("again", again).withColumn("fault", fault)
    return dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")


def _searched(rows: DataFrame, present: str | None, whole: bool) -> DataFrame:
    """A row per conversation (`whole`), or per edit."""
    schema = T.StructType([rows.schema["conv_id"], *(SUMMARY if whole else MESSAGES)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names, out, now, place = to_arrow_schema(schema), [], None, 0

        def settle(ended: bool) -> None:
            nonlocal place
            summary = now.end() if ended else None
            if whole:
                if ended:
                    out.append((now.conv_id, *summary))
            else:
                out.extend((now.conv_id, place + i, *m) for i, m in enumerate(now.messages))
                place = 0 if ended else place + len(now.messages)
            now.messages.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), names)], schema=names)
            out.clear()
            return made

        for b in batches:
            for conv_id, turn, role, text, there, fault in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv_id != conv_id:
                    if now:
                        settle(True)
                    now = _Conversation(conv_id)
                if there:
                    now.add(turn, role, text, fault)
                if now.messages:
                    settle(False)
                if len(out) >= _ROWS:
                    yield batch()
        if now:
            settle(True)
        if out:
            yield batch()

    return _ordered(rows, present).select("conv_id", "turn", "role", "text", "there", "fault").mapInArrow(search, schema)


def summaries(rows: DataFrame, present: str | None = None) -> DataFrame:
    """One row per conversation of `rows(conv_id, turn, role, text)`: its faults, the cost and initials of the cheapest edits, and the hash of what they leave.

    Rows stand in order of turn, nulls first, ties by role and text. A null role or text counts as one space, so such a
    text is blank; null conversation ids are one conversation. A row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated. Edits: Keep 0, Rerole 3, Delete 4 (the only one for blank and duplicate rows), Insert 3,
    and 3 more for a truncated row that isn't deleted; of equally cheap ways the ASCII-least wins. Rows where the column
    `present` is false only hold their conversation's place: without another row it has zeros, no edits and the hash
    of nothing. Repeated rows are duplicates; other columns don't matter; an empty table gives an empty result.

    A conversation is read in order by one task, as its hash asks; the task streams and holds the undecided stretch only.
    """
    return _searched(rows, present, True)


def repaired(rows: DataFrame, present: str | None = None) -> DataFrame:
    """One row per edit, in order within a conversation: `(conv_id, place, edit, turn, role, text)`, with the role and text it
    leaves; deleted rows (edit D) show what was deleted. See `summaries`; a conversation without rows has none here."""
    return _searched(rows, present, False)


def damaged(rows: DataFrame) -> DataFrame:
    """Damage by the crc32 of `conv_id:turn` modulo 20: a row is dropped (`present` is false), emptied, loses its sentence
    marks, is repeated, or gets the role user; other rows stay. Nulls count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20).alias("kind")
    own = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), times.alias("copy")).drop("copy")
