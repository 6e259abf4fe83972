"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: nothing, or
an optional system row and then user and assistant in turns. Rows are edited at a price: kept
for 0, given the role user or assistant for 3, deleted for 4, and rows with empty text inserted for
3; blank and duplicate rows must go, truncated ones cost 3 more unless they go. The cheapest
edits are wanted and, among equally cheap ones, those whose initials (D, I, K, R) come first as text.

The search reads the rows once, in order. After each row it holds one survivor for each state of
the grammar: the cheapest way to get there. Survivors are leaves of a tree of back pointers whose nodes
know their children; a node without children is let go, and as soon as the root has a single child every
survivor shares it, so that its edits are final and are emitted. Memory therefore holds what is
unresolved and nothing else. Ways of equal cost into one state are told apart by their complete
unresolved edits. A survivor so dear that another state can do all that it can for less is let go as well, else
the way that deletes every row would never meet the others. Every way has one edit for each row, and ends in it, so none of two is the beginning
of the other and their order never changes once they differ: it is carried along as a rank of each survivor.

Spark brings a conversation's rows together in order, with spilling sorts; the search takes them as
a stream, so a conversation with a third of all rows needs no more memory than a short one. A
digest over its whole repaired text runs through its rows in order in any case.

Rows are ordered by turn, NULLs first, then by role and text. The search takes NULL roles and texts as
one space. A role without letters is no role: such a row is deleted or gets one. Rows with NULL ``conv_id`` are
one conversation. Repeated rows are rows of their own, all but the first duplicates. Texts and
conversations may be of any length. An empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import bound_batches

# Prices, roles, the white space that a text is stripped of, the marks that end one.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
MARKS = ".!?"
LEGAL = {"su", "ua", "au"}
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
TURN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the role that an edit can give in each state
FINAL = (START, ASSISTANT)


def _steps(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str, str]]]:
    """For each state to be reached by a row: (state before, cost, edits, roles that these give)."""
    found: dict[tuple[int, int], tuple[int, str, str]] = {}

    def offer(before: int, state: int, cost: int, edits: str, roles: str) -> None:
        known = found.get((before, state))
        if known is None or (cost, edits) < known[:2]:
            found[before, state] = (cost, edits, roles)

    extra = TRUNCATED if truncated else 0
    for before in range(4):
        at, cost, edits, roles = before, 0, "", ""
        for _ in range(3):  # two insertions reach every state that any number reaches
            offer(before, at, cost + DELETE, edits + "D", roles)
            if not must_go:
                if (at, initial) in NEXT:
                    offer(before, NEXT[at, initial], cost + extra, edits + "K", roles + "=")
                offer(before, NEXT[at, TURN[at]], cost + RENAME + extra, edits + "R", roles + TURN[at])
            cost, edits, roles = cost + INSERT, edits + "I", roles + TURN[at]
            at = NEXT[at, TURN[at]]
    return [[(b, *found[b, s]) for b in range(4) if (b, s) in found] for s in range(4)]


def _close() -> list[tuple[int, int, str, str]]:
    """Insertions after the last row: (state before, cost, edits, roles)."""
    out = []
    for before in range(4):
        at, edits, roles = before, "", ""
        while at not in FINAL:
            edits, roles, at = edits + "I", roles + TURN[at], NEXT[at, TURN[at]]
        out.append((before, INSERT * len(edits), edits, roles))
    return out


# What it costs at most to end as well from one state as from another, by insertions, and a deletion where only
# the start may keep a system row. A survivor that lies further behind can never win, whatever follows.
BEHIND = {
    START: (0, 0, 3, 0), SYSTEM: (6, 0, 3, 6), USER: (7, 3, 0, 3), ASSISTANT: (4, 0, 3, 0),
}

_STEPS: dict[tuple[str, bool, bool], list[list[tuple[int, int, str, str]]]] = {}
_CLOSE = _close()


class Node:
    """Edits for one row on one way: those before it and its own."""

    __slots__ = ("parent", "edit", "children")

    def __init__(self, parent: Node | None, edit: Edit):
        self.parent, self.edit = parent, edit
        self.children: list[Node] = []


class Survivor:
    """The cheapest way into a state: cost, place among the survivors' edits as text, leaf, digest of its repaired rows."""

    __slots__ = ("cost", "rank", "node", "digest")

    def __init__(self, cost: int, rank: int, node: Node, digest):
        self.cost, self.rank, self.node, self.digest = cost, rank, node, digest


Edit = tuple[str, str]  # edits of a row and those before it, the roles that all but deletions give


def _written(digest, state: int, edit: Edit, role: str, text: str):
    """``digest`` after the repaired rows of one edit; ways may share a digest, so it is never changed itself."""
    edits, roles = edit
    if not roles:
        return digest
    digest, keeps = digest.copy(), len(roles) - 1 if edits[-1] in "KR" else len(roles)
    for i, r in enumerate(roles):
        line = f"{role if r == '=' else ROLES[r]}:{text if i == keeps else ''}"
        digest.update(f"\n{line}".encode() if i or state != START else line.encode())
    return digest


class Search:
    """The search over one conversation, fed row by row.

    ``add`` returns the edits that became final, one ``Edit`` for each row in order, where ``=`` is a role that
    stays. With ``digests`` each survivor carries the digest of its own repaired rows, so that no text waits.
    """

    def __init__(self, digests: bool = False):
        self.root = Node(None, ("", ""))
        self.digests = digests
        self.survivors: list[Survivor | None] = [Survivor(0, 0, self.root, hashlib.sha256() if digests else None), None, None, None]

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> list[Edit]:
        key = (role[:1] if role[:1] in ("s", "u", "a") else "", must_go, truncated)
        steps = _STEPS.get(key)
        if steps is None:
            steps = _STEPS[key] = _steps(*key)
        before, chosen = self.survivors, []
        for state, ways in enumerate(steps):
            best = None
            for b, cost, edits, roles in ways:
                old = before[b]
                if old is not None:
                    way = (old.cost + cost, old.rank, edits, b, roles)
                    if best is None or way < best:
                        best = way
            if best is not None:
                chosen.append((best[1:3], state, best))
        costs = [(state, best[0]) for _, state, best in chosen]
        chosen = [c for c in chosen if all(cost + BEHIND[x][c[1]] >= c[2][0] for x, cost in costs)]
        after: list[Survivor | None] = [None] * 4
        for rank, (_, state, (cost, _, edits, b, roles)) in enumerate(sorted(chosen)):
            old, edit = before[b], (edits, roles)
            node = Node(old.node, edit)
            old.node.children.append(node)
            after[state] = Survivor(cost, rank, node, _written(old.digest, b, edit, role, text) if self.digests else None)
        self.survivors = after
        for old in before:
            if old is not None:
                self._let_go(old.node)
        return self._final()

    def _let_go(self, node: Node) -> None:
        while not node.children and node is not self.root:
            parent = node.parent
            parent.children.remove(node)
            node = parent

    def _final(self) -> list[Edit]:
        out = []
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            out.append(self.root.edit)
        return out

    def finish(self) -> tuple[list[Edit], Edit, int, str]:
        """The edits that were open, those after the last row, the cost of all, and the digest of the repaired rows."""
        cost, _, state, edit = min(
            (old.cost + cost, old.rank, b, (edits, roles))
            for b, cost, edits, roles in _CLOSE if (old := self.survivors[b]) is not None
        )
        won, out = self.survivors[state], []
        node = won.node
        while node is not self.root:
            out.append(node.edit)
            node = node.parent
        digest = _written(won.digest, state, edit, "", "").hexdigest() if self.digests else ""
        return out[::-1], edit, cost, digest


def _faulty(text: str) -> str:
    """``blank``, ``truncated`` or nothing."""
    end = text.rstrip(WHITE)[-1:]
    return "blank" if not end else "" if end in MARKS else "truncated"


class Conversation:
    """What is told about one conversation while its rows pass."""

    def __init__(self, conv_id, digests: bool):
        self.conv_id, self.search = conv_id, Search(digests)
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.role = 0, None
        self.first_turn = self.turn = None
        self.turns = 0
        self.audit: list[str] = []

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> list[Edit]:
        fault = _faulty(text)
        if repeated and fault != "blank":
            fault = "duplicate"
        if fault:
            self.counts[fault] += 1
        if self.role is not None and self.role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.role = role
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        return self.search.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def summary(self) -> dict:
        rest, close, cost, digest = self.search.finish()
        audit = "".join([*self.audit, *(edits for edits, _ in rest), close[0]])
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _in_order(rows: DataFrame, present: Column) -> DataFrame:
    """The rows of each conversation side by side, in order, ``repeated`` where role and text were seen earlier.

    One exchange: it also serves the window, whose keys begin with the conversation.
    """
    clean = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"),
    )
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))
    flagged = clean.repartition("conv_id").withColumn("repeated", F.row_number().over(same) > 1)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "repeated"]
    return bound_batches(flagged).sortWithinPartitions(*order)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    names = ("conv_id", "turn", "role", "text", "present", "repeated")
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def summaries(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per ``conv_id``: gaps, faults, cost and initials of the cheapest edits, digest of the repaired rows.

    Rows for which ``present`` does not hold only name their conversation.
    """

    def told(done: list[dict], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [(c, pa.int64()) for c in NUMBERS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
        return pa.RecordBatch.from_pylist(done, pa.schema([batch.schema.field("conv_id"), *kinds]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            done = []
            for conv_id, turn, role, text, here, repeated in _rows(batch):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.summary())
                    now = Conversation(conv_id, True)
                if here:
                    now.audit.extend(edits for edits, _ in now.add(turn, role, text, repeated))
            if done:
                yield told(done, batch)
        if now is not None:
            yield told([now.summary()], batch)

    ordered = _in_order(rows, F.lit(True) if present is None else present)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string")


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits as rows: ``conv_id``, ``place`` in order, ``edit``, and the ``turn``, ``role`` and ``text`` after it.

    Deleted rows keep theirs, inserted ones have no turn and an empty text; without the deleted ones this
    is the repaired conversation. Rows wait in memory until their edits are final.
    """

    def told(wait: deque, found: list[Edit], conv_id, place: int) -> Iterator[dict]:
        for letters, roles in found:
            given = iter(roles)
            for letter in letters:
                turn, role, text = (None, "", "") if letter == "I" else wait.popleft()
                r = "=" if letter == "D" else next(given)
                yield {"conv_id": conv_id, "place": place, "edit": letter, "turn": turn, "role": role if r == "=" else ROLES[r], "text": text}
                place += 1

    def rows_of(done: list[dict], batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
        return pa.RecordBatch.from_pylist(done, pa.schema([batch.schema.field("conv_id"), *kinds]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        wait: deque = deque()
        place = 0

        def finished() -> list[dict]:
            rest, close, _, _ = now.search.finish()
            return list(told(wait, [*rest, close], now.conv_id, place))

        for batch in batches:
            done: list[dict] = []
            for conv_id, turn, role, text, _, repeated in _rows(batch):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done += finished()
                    now, place = Conversation(conv_id, False), 0
                wait.append((turn, role, text))
                found = list(told(wait, now.add(turn, role, text, repeated), conv_id, place))
                place += len(found)
                done += found
            if done:
                yield rows_of(done, batch)
        if now is not None and (done := finished()):
            yield rows_of(done, batch)

    ordered = _in_order(rows, F.lit(True))
    kind = ordered.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by a checksum of ``conv_id:turn``; dropped rows stay, with ``present`` false."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    marked = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), copies.alias("copy"))


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations``, damaged and repaired."""
    return summaries(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("present"))
