"""Conversation structure repair by a Viterbi search that emits edits as soon as they are settled.

A conversation should read, by the initials of its roles, ``(s?(ua)+)?``: at most one system
turn, then user and assistant in turn. Its rows, in order, are kept (K), given the other
role (R) or deleted (D), and empty turns are inserted (I) anywhere, at the least total cost;
of the cheapest edit sequences the one whose initials come first in ASCII order counts.

The search has four states: nothing yet, after s, after u, after a. In each only one of user
and assistant may come next, so an edit sequence fixes the repaired text. Every state
keeps one survivor, a path in a tree of back pointers with reference counts. When a
survivor dies, at a fork or because another ends cheaper whatever follows, its path is freed
up to the next fork; when all survivors share their first
edits these are settled, are emitted and leave the tree. So memory follows the unsettled
part of a conversation, not its length. Survivors are ranked by their whole sequences of
initials: a new one's rank follows from its parent's rank and its own edits, as no survivor's
sequence is a prefix of another's (all have as many K, R and D, and end in one).

Rows are shuffled once, by conversation, and streamed through it in turn order; the sort
spills. A conversation is one task's work whatever its length, because its digest is one
SHA-256 over all its lines.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
START, S, U, A = range(4)
ROLES = {U: "user", A: "assistant"}
#: State after a user or assistant turn that the state admits, and states by initials it admits.
TURN = {START: U, S: U, U: A, A: U}
ADMITS = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
#: Inserts that lead from each state to the end of a whole conversation.
MISSING = {START: 0, S: 2, U: 1, A: 0}
LEGAL = {"su", "ua", "au"}


class Node:
    """The edit of one row with the inserts before it."""

    __slots__ = ("edit", "heads", "parent", "row")

    def __init__(self, parent, edit: str, row) -> None:
        self.parent, self.edit, self.row = parent, edit, row
        self.heads: set[Node] = set()  # living children; their number is the reference count


class Search:
    """One conversation: rows go in with :meth:`add`, settled edits come out of ``emit(edit, role, text)``."""

    def __init__(self, emit) -> None:
        self.emit = emit
        self.root = Node(None, "", None)
        self.at = START  # the state after what was emitted
        self.alive = {START: (0, 0, self.root)}  # state -> (cost, rank, path)

    def add(self, role: str, text: str, fault: int) -> None:
        initial, extra = role[:1], TRUNCATED if fault == CUT else 0
        best: dict[int, tuple] = {}

        def offer(state, cost, rank, edit, parent):
            if state not in best or (cost, rank, edit) < best[state][:3]:
                best[state] = cost, rank, edit, parent

        for state, (cost, rank, path) in self.alive.items():
            before = ""
            while len(before) < 3:  # a third insert would only repeat a state
                offer(state, cost + DELETE, rank, before + "D", path)
                if fault not in (BLANK, DUPLICATE):
                    if initial in ADMITS[state]:
                        offer(ADMITS[state][initial], cost + extra, rank, before + "K", path)
                    offer(TURN[state], cost + REROLE + extra, rank, before + "R", path)
                state, cost, before = TURN[state], cost + INSERT, before + "I"
        for state in [s for s in best if self._beaten(s, best)]:
            del best[state]
        old = [path for _, _, path in self.alive.values()]
        self.alive = {}
        for rank, (state, (cost, _, edit, parent)) in enumerate(sorted(best.items(), key=lambda x: x[1][1:3])):
            node = Node(parent, edit, (role, text))
            parent.heads.add(node)
            self.alive[state] = cost, rank, node
        for node in old:  # paths without a survivor go, up to the next fork
            while node.parent is not None and not node.heads:
                node.parent.heads.discard(node)
                node.parent, node = None, node.parent
        while len(self.root.heads) == 1:
            (head,) = self.root.heads
            self._say(head.edit, head.row)
            head.parent = head.row = None
            self.root = head

    def _say(self, edits: str, row) -> None:
        for e in edits:
            role, text = ("", "") if e == "I" else row
            if e in "IR":
                self.at = TURN[self.at]
                role = ROLES[self.at]
            elif e == "K":
                self.at = ADMITS[self.at][role[:1]]
            self.emit(e, role, text)

    @staticmethod
    def _beaten(state: int, best: dict[int, tuple]) -> bool:
        """Whether another survivor ends cheaper whatever follows. After a, or after u with an a inserted,
        all that may follow s may follow too, and all that may follow nothing but an s row, which
        can be deleted instead. After u and a, one insert leads from one to the other."""
        never = (float("inf"),)
        u, a = best.get(U, never)[0], best.get(A, never)[0]
        bound = {START: min(a, u + INSERT) + DELETE, S: min(a, u + INSERT), U: a + INSERT, A: u + INSERT}[state]
        return bound < best[state][0]

    def end(self) -> int:
        """Settle the rest; the total cost."""
        cost, _, edits, node = min(((c + INSERT * MISSING[s], r, "I" * MISSING[s], n) for s, (c, r, n) in self.alive.items()), key=lambda x: x[:3])
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for n in reversed(path):
            self._say(n.edit, n.row)
        self._say(edits, None)
        return cost


class Report:
    """What :func:`repair` says of one conversation."""

    KIND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self, conv, out) -> None:
        self.conv, self.out, self.audit, self.sha = conv, out, [], hashlib.sha256()
        self.search = Search(self._edit)
        self.faults = [0, 0, 0, 0]
        self.lines = self.illegal = self.turns = 0
        self.low = self.last = self.before = None

    def _edit(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.low = turn if self.low is None else self.low
            self.last = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.faults[fault] += 1
        self.search.add(role, text, fault)

    def close(self) -> None:
        cost = self.search.end()
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        self.out.append((self.conv, gaps, *self.faults[1:], self.illegal, cost, "".join(self.audit), self.sha.hexdigest()))


class Edits:
    """The rows that :func:`edits` returns of one conversation."""

    KIND = "step long, edit string, role string, text string"

    def __init__(self, conv, out) -> None:
        self.conv, self.out, self.step = conv, out, 0
        self.search = Search(self._edit)

    def _edit(self, edit: str, role: str, text: str) -> None:
        self.step += 1
        self.out.append((self.conv, self.step, edit, role, text))

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.search.add(role, text, fault)

    def close(self) -> None:
        self.search.end()


def _walk(make):
    """Rows sorted by conversation, each conversation through its own ``make(conv, out)``."""
    def run(batches):
        import pyarrow as pa

        fields = [f.split() for f in make.KIND.split(", ")]
        now, out = None, []

        def flush(kind):
            if out:
                schema = pa.schema([("conv", kind), *[(n, pa.int64() if t == "long" else pa.string()) for n, t in fields]])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out.clear()

        kind = None
        for b in batches:
            kind = b.schema.field("conv").type
            columns = [b.column(c).to_pylist() for c in ("conv", "present", "turn", "role", "text", "fault")]
            for conv, present, *row in zip(*columns, strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        now.close()
                    now = make(conv, out)
                if present:
                    now.add(*row)
            yield from flush(kind)
        if now is not None:
            now.close()
            yield from flush(kind)

    return run


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, present): test damage by crc32 of ``conv_id:turn`` modulo 20, nulls as one
    space: 0 drops the row (``present`` is false), 1 empties its text, 2 removes its ``[.!?]``,
    3 repeats it, 4 makes it a user's. Null roles and texts become one space."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)]
    way = F.crc32(F.encode(F.concat(part[0], F.lit(":"), part[1]), "UTF-8")) % 20
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                                F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("way") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (rows.withColumn("copy", F.explode(copies))
            .select("conv", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("way") != 0).alias("present")))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, present) with their first fault, a conversation after another, each by
    turn, nulls first; rows of one turn by role and text."""
    space = " \t\n\x0b\x0c\r"
    bare = F.rtrim(F.col("text"), F.lit(space))
    ends = F.right(bare, F.lit(1)).isin(".", "!", "?")
    plain = (rows.select("conv", "turn", "role", F.when(F.col("present"), F.col("text")).alias("text"), "present")
             .withColumn("shape", F.when(F.length(F.rtrim(F.col("text"), F.lit(space))) == 0, BLANK).when(ends, 0).otherwise(CUT))
             .withColumn("digest", F.unhex(F.sha2(F.col("text"), 256))).repartition("conv"))
    seen = Window.partitionBy("conv", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    again = (F.row_number().over(seen) > 1) & (F.col("shape") != BLANK)
    return (plain.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("shape")))
            .sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
            .select("conv", "turn", "role", "text", "fault", "present"))


def repair(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``rows`` (conv, turn, role, text, present), null one included:
    gaps (missing turn numbers), rows by first fault (blank, duplicate, truncated), illegal
    neighbours, and the cheapest repair: cost, audit (initials of its edits) and the SHA-256 of
    the repaired ``role:text`` lines. A conversation without present rows has zeros, an
    empty audit and the digest of nothing; an empty table gives an empty one. Rows of one turn
    come by role and text; role and text are not null."""
    kind = rows.schema["conv"].dataType.simpleString()
    return _in_order(rows).mapInArrow(_walk(Report), f"conv {kind}, {Report.KIND}").withColumnRenamed("conv", id_col)


def edits(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, step, edit, role, text): the edits of the cheapest repair in order. The repaired
    conversation is its rows without ``edit = 'D'``."""
    kind = rows.schema["conv"].dataType.simpleString()
    return _in_order(rows).mapInArrow(_walk(Edits), f"conv {kind}, {Edits.KIND}").withColumnRenamed("conv", id_col)
