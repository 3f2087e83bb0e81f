"""Cheapest repairs against a search through all edits, and damage against plain rules."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from docquarry.llm import conversation_repair as repair

GRAMMAR = re.compile("(s?(ua)+)?")
COLUMNS = ["conv_id", *repair.RESULT]


def cheapest(rows):
    """Best-first search over (row, repaired initials): no automaton, no merging."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, n, initials, out = heapq.heappop(heap)
        if (n, initials) in done:
            continue
        done.add((n, initials))
        if n == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, out
        if len(initials) > len(rows) + 3:
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", n, initials + role[0], (*out, f"{role}:")))
        if n < len(rows):
            role, text, fault = rows[n]
            heapq.heappush(heap, (cost + 2, audit + "D", n + 1, initials, out))
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", n + 1, initials + role[:1], (*out, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", n + 1, initials + other[0], (*out, f"{other}:{text}")))


def plain(rows, damage=True):
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 5
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        own.sort()
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = {t for known, t, *_ in own if known}
        cost, audit, lines = cheapest([(r, t, f) for (_, _, r, t), f in zip(own, faults)])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.select(COLUMNS).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string"


def some(seed, conversations, longest):
    rnd, rows = random.Random(seed), []
    for c in range(conversations):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "usher", "", None])
            rows.append((c, rnd.choice([turn, turn, turn, turn + 2, None]), role, rnd.choice(["a.", "b!", "c?", "d", "", " \t", None, "é. \n", "x" * 9, f"{turn}."])))
    return rows


def test_repairs_as_searched(spark):
    rows = some(1, 300, 6)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", fault int").repartition(7)
    assert got(repair.repaired(df)) == plain(rows, damage=False)


def test_damage_as_plain(spark):
    rows = [*some(2, 250, 6), (None, None, None, None), (None, 1, "user", "a."), (10**6, 1, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(repair.repaired(repair.damaged(df), gone="gone")) == plain(rows)


def test_nothing_left(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)
    assert got(repair.repaired(repair.damaged(df), gone="gone")) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repaired(repair.damaged(df.limit(0)), gone="gone").count() == 0


@pytest.mark.parametrize("rows,size", [(3, 1 << 22), (1 << 16, 5)])
def test_long_conversations_in_parts(spark, monkeypatch, rows, size):
    rnd = random.Random(4)
    own = [(rnd.choice(["user", "assistant", "user", "system"]), rnd.choice(["a.", "b", "c! "]), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(400)]

    def walk():
        at = repair.Walk()
        for n, (role, text, fault) in enumerate(own):
            at.add(n, role, text, fault)
        return at.end()

    whole = walk()
    monkeypatch.setattr(repair, "PART_ROWS", rows)
    monkeypatch.setattr(repair, "PART_BYTES", size)
    assert walk() == whole and len(whole["audit"]) >= 400
    short = repair.Walk()
    for n, (role, text, fault) in enumerate(own[:9]):
        short.add(n, role, text, fault)
    cost, audit, lines = cheapest(own[:9])
    end = short.end()
    assert (end["cost"], end["audit"], end["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_few_steps_are_remembered():
    rnd, at = random.Random(5), repair.Walk()
    for n in range(30_000):
        at.add(n, rnd.choice(["user", "assistant", "system", "x"]), "a", rnd.randint(0, 3))
    assert len(repair._STEPS) < 20_000 and len(at.tops) <= 6


def test_one_conversation_with_most_rows(spark):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, id, 7) as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(id, '.') as text")
    found = repair.repaired(rows)
    assert found.count() == 20_001 - (7 % 3 == 0) and found.filter("conv_id = 7").first().audit.count("D") < 40_001
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
