"""Conversation repair against a search through all edits, and its edges."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tapeline.llm import conversations
from tests.llm.test_operators import SMALL

ROW = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def plain_faults(rows):
    """The first fault of each row, by the rules' own words."""
    seen, out = set(), []
    for _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        if not ends:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif ends[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def every_way(rows, faults):
    """All edits with at most two insertions in a row: (cost, audit, repaired rows)."""
    gaps = ["", "u", "a", "ua", "au"]

    def choices(role, text, fault):
        yield 4, "D", []
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            yield more, "K", [(role, text)]
            for name in NAMES.values():
                yield 3 + more, "R", [(name, text)]

    parts = []
    for (_, role, text), fault in zip(rows, faults):
        parts += [[(3 * len(g), "I" * len(g), [(NAMES[r], "") for r in g]) for g in gaps], list(choices(role, text, fault))]
    parts.append([(3 * len(g), "I" * len(g), [(NAMES[r], "") for r in g]) for g in gaps])
    for way in itertools.product(*parts):
        done = [r for _, _, rows_ in way for r in rows_]
        if GRAMMAR.fullmatch("".join(role[:1] or "?" for role, _ in done)):
            yield sum(c for c, _, _ in way), "".join(a for _, a, _ in way), done


def plain_tables(rows, faults):
    """The same by dynamic programming over whole strings, for longer conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def grown(ways):
        wait = list(ways.items())
        while wait:
            state, (cost, audit, done) = wait.pop()
            for r in "ua":
                if (state, r) in step:
                    to, way = step[state, r], (cost + 3, audit + "I", [*done, (NAMES[r], "")])
                    if to not in ways or way[:2] < ways[to][:2]:
                        ways[to] = way
                        wait.append((to, way))
        return ways

    ways = grown({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, done) in ways.items():
            options = [(state, cost + 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (state, role[:1]) in step:
                    options.append((step[state, role[:1]], cost + more, "K", [(role, text)]))
                options += [(step[state, r], cost + 3 + more, "R", [(NAMES[r], text)]) for r in "ua" if (state, r) in step]
            for to, price, letter, new in options:
                way = (price, audit + letter, done + new)
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        ways = grown(after)
    return min((way for state, way in ways.items() if state in ("", "a")), key=lambda w: w[:2])


def digest(done):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()


def expected(rows, best=plain_tables):
    """The whole result row for rows (turn, role, text) in order."""
    faults = plain_faults(rows)
    cost, audit, done = best(rows, faults)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": digest(done),
    }


def searched(rows):
    """The operator's own search, and what its streamed edits give."""
    talk, edits = conversations.Conversation(0, True), []
    seen = set()
    for turn, role, text in rows:
        edits += talk.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    talk.audit += [letters for letters, _ in edits]
    return {k: v for k, v in talk.summary().items() if k != "conv_id"}


def some_rows(rng, n, roles=("user", "assistant", "system", "tool", "")):
    return [(t, rng.choice(roles), rng.choice(["Yes.", "No!", "well", " ", "Why?\n", f"{t}.", f"{t}"])) for t in range(n)]


def test_search_matches_all_ways():
    rng = random.Random(5)
    for _ in range(60):
        rows = some_rows(rng, rng.randint(0, 3))
        assert expected(rows) == expected(rows, lambda r, f: min(every_way(r, f), key=lambda w: w[:2]))
        assert searched(rows) == expected(rows)


@pytest.mark.parametrize("roles", [("user", "assistant", "system"), ("user",), ("assistant",), ("user", "assistant", "tool", "")])
def test_search_matches_tables(roles):
    rng = random.Random(6)
    for _ in range(250):
        rows = some_rows(rng, rng.randint(0, 14), roles)
        assert searched(rows) == expected(rows)


def test_survivors_meet_and_memory_stays_small():
    search, open_nodes, final = conversations.Search(), 0, 0
    for i in range(20_000):
        final += len(search.add(("user", "assistant")[i % 2 if i % 97 else 0], f"{i}.", i % 31 == 0, i % 17 == 0))
        open_nodes = max(open_nodes, i + 1 - final)
    assert open_nodes < 200


def test_one_role_for_long_takes_linear_time():
    search = conversations.Search(True)
    final = [e for i in range(100_000) for e in search.add("user", f"{i}.", False, False)]
    rest, close, cost, _ = search.finish()
    assert len(final) + len(rest) == 100_000 and cost == 3 * 50_000 and close == ("", "")


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs in every column, repeated rows and turns, a conversation that vanishes, an unknown role, extra columns."""
    rows = [
        (1, 0, "user", "Hello there."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, None, None),
        (1, None, "system", "Be kind."), (2, 0, "assistant", "cut off"), (2, 1, "tool", "Result."), (2, 3, "", "Odd."),
        (None, 0, "user", "Who?"), (None, None, "user", "Nobody."), (None, None, "user", "Nobody."), (None, 2, "assistant", ""),
        (3, None, None, None), (4, 9, "user", "x" * 300_000 + "."), (4, 10, "user", "y. " * 100_000),
    ]
    return spark.createDataFrame([(*r, 1, "z", True) for r in rows], ROW + ", place int, edit string, repeated boolean")


def ordered(rows):
    """Rows (turn, role, text) as the operator orders them."""
    clean = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def plain_damage(rows):
    """conv_id -> rows after damage, by the contract's words."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [] if fate == 0 else [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {conv: ordered(kept) for conv, kept in out.items()}


def by_conversation(found):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found.collect()}


def test_summaries_and_edits_of_awkward_rows(awkward):
    rows: dict = {}
    for r in awkward.collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    told = by_conversation(conversations.summaries(awkward))
    assert told == {conv: expected(ordered(some)) for conv, some in rows.items()}
    edits: dict = {}
    for r in conversations.edits(awkward).orderBy("conv_id", "place").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, some in edits.items():
        assert [r.place for r in some] == list(range(len(some)))
        assert "".join(r.edit for r in some) == told[conv]["audit"]
        assert digest([(r.role, r.text) for r in some if r.edit != "D"]) == told[conv]["repaired_sha256"]
        kept = sorted(" " if x is None else x for _, _, x in rows[conv])
        assert sorted(r.text for r in some if r.edit != "I") == kept


def test_query_matches_plain_version(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_conversation(conversations.op13_conversations(spark, SMALL)) == {c: expected(r) for c, r in plain_damage(given).items()}


def test_damage_of_awkward_rows(awkward):
    from pyspark.sql import functions as F

    told = by_conversation(conversations.summaries(conversations.damaged(awkward), F.col("present")))
    given = [(r.conv_id, r.turn, r.role, r.text) for r in awkward.collect()]
    assert told == {c: expected(r) for c, r in plain_damage(given).items()}


def test_empty_table_and_one_exchange(spark):
    none = spark.createDataFrame([], ROW)
    assert conversations.summaries(none).count() == 0 and conversations.edits(none).count() == 0
    plan = conversations.summaries(none)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
