"""Conversation structure repair: generalised LR parsing of roles with weighted edits.

The grammar of a conversation's roles, by their initials, is

    C -> nothing | T | s T        T -> u a | T u a

A conversation is parsed with all its possible stacks at once. Before each row turns may be
inserted; the row is kept, reroled or deleted. Stacks share what is below their tops, and of
stacks with equal tops the one of the smallest (cost, audit) stays: what may follow depends on
the top alone, and audits of equal cost that have come to the same row are never prefixes of
each other, so their order can't change later. Tops are kept in the order of their audits, and
those that are too dear to win are dropped (FAR); therefore few different sets of tops occur, and
each step is worked out once and remembered.

Rows come to a task by conversation, sorted by turn, and are read as a stream: a long
conversation is walked in parts of bounded bytes, each top with the digest of its own repaired
text so far. What grows with a conversation is its audit alone, which is a part of the result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The LR table of the grammar above. State 0 is the beginning, 1 is after s, 2 and 6
# are after u, 3 and 4 after T; 5 and 7 have a whole T, which is reduced at once.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}  # so many states leave the stack
GOTO = {0: 3, 1: 4}
ACCEPT = {0, 3, 4}
# Costs of edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: From any top any other's ending can be had for two inserted turns and one more insertion or deletion.
FAR = 3 * INSERT + DELETE
ROLES = {"u": "user", "a": "assistant"}
#: Rows and bytes of text that are walked before their edits are settled.
PART_ROWS, PART_BYTES = 1 << 16, 1 << 22
BLANK = " \t\n\x0b\x0c\r"
SOUND, BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = range(4)


def shifted(stack: tuple, symbol: str) -> tuple | None:
    """The stack (state, what is below) after a symbol, reduced; None where it can't follow."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    if state in REDUCE:
        for _ in range(REDUCE[state]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def inserted(stack: tuple) -> Iterator[tuple[str, tuple]]:
    """The stack, and what inserted turns make of it, until tops come again."""
    seen, letters = set(), ""
    while stack and stack[0] not in seen:
        seen.add(stack[0])
        yield letters, stack
        letters, stack = letters + "I", shifted(stack, "u") or shifted(stack, "a")


class Step(NamedTuple):
    tops: tuple  # (stack, cost above the least), in the order of audits
    cost: int  # by which the least cost has grown
    origins: tuple  # for each top, the place of the one it came from, and its edits


BEGIN = (((0, None), 0),)
_STEPS: dict[tuple, Step] = {}


def step(tops: tuple, initial: str, fault: int) -> Step:
    """All tops after one more row."""
    found = _STEPS.get((tops, initial, fault))
    if found is not None:
        return found
    best: dict[int, tuple] = {}
    for n, (stack, cost) in enumerate(tops):
        for letters, at in inserted(stack):
            spent = cost + INSERT * len(letters)
            edits = [(DELETE, "D", at)]
            if fault in (SOUND, TRUNCATED_ROW):
                more = TRUNCATED if fault == TRUNCATED_ROW else 0
                edits += [(more, "K", shifted(at, initial)), *((more + REROLE, "R", shifted(at, role)) for role in ROLES)]
            for price, letter, after in edits:
                if after:
                    key = (spent + price, n, letters + letter)
                    best[after[0]] = min(best.get(after[0], (key, after)), (key, after), key=lambda x: x[0])
    least = min(key[0] for key, _ in best.values())
    order = sorted((key[1], key[2], after, key[0] - least) for key, after in best.values() if key[0] <= least + FAR)
    _STEPS[tops, initial, fault] = found = Step(tuple((a, c) for _, _, a, c in order), least, tuple((n, e) for n, e, _, _ in order))
    return found


class Draft(NamedTuple):
    """What one top has settled so far."""

    audit: tuple | None  # (what came before, letters)
    digest: object
    lines: int
    after: str  # the initial of the last repaired row

    def edited(self, edits: list[str], rows: list[tuple[str, str]]) -> Draft:
        digest, lines, after = self.digest.copy(), self.lines, self.after
        text = []
        for letters, (role, body) in zip(edits, rows, strict=True):
            for letter in letters:
                if letter == "D":
                    continue
                if letter != "K":
                    role = ROLES["a" if after == "u" else "u"]
                text.append(f"{role}:{'' if letter == 'I' else body}")
                after = role[:1]
        if text:
            digest.update(("\n" * (lines > 0) + "\n".join(text)).encode())
        return Draft((self.audit, "".join(edits)), digest, lines + len(text), after)


class Walk:
    """One conversation, a row at a time."""

    def __init__(self) -> None:
        self.tops, self.cost = BEGIN, 0
        self.drafts = [Draft(None, hashlib.sha256(), 0, "")]
        self.steps, self.rows, self.bytes = [], [], 0
        self.counts, self.illegal, self.last = [0] * 4, 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.counts[fault] += 1
        found = step(self.tops, initial if initial in "sua" else "", fault)
        self.tops, self.cost = found.tops, self.cost + found.cost
        self.steps.append(found.origins)
        self.rows.append((role, text))
        self.bytes += len(text)
        if len(self.rows) >= PART_ROWS or self.bytes >= PART_BYTES:
            self.drafts = [self._draft(n) for n in range(len(self.tops))]
            self.steps, self.rows, self.bytes = [], [], 0

    def _draft(self, top: int) -> Draft:
        edits = []
        for origins in reversed(self.steps):
            top, letters = origins[top]
            edits.append(letters)
        return self.drafts[top].edited(edits[::-1], self.rows)

    def end(self) -> dict:
        cost, top, letters = min((c + INSERT * len(letters), n, letters) for n, (stack, c) in enumerate(self.tops) for letters, at in inserted(stack) if at[0] in ACCEPT)
        draft = self._draft(top)
        draft = draft.edited([letters], [("", "")]) if letters else draft
        audit, at = [], draft.audit
        while at:
            at, part = at
            audit.append(part)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.counts[BLANK_ROW], "duplicate": self.counts[DUPLICATE_ROW], "truncated": self.counts[TRUNCATED_ROW], "illegal": self.illegal,
            "cost": self.cost + cost, "audit": "".join(reversed(audit)), "repaired_sha256": draft.digest.hexdigest(),
        }


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: rows damaged by a checksum of their place.

    crc32(`conv:turn`) % 20: 0 drops the row (it stays with gone, so that its conversation is
    known), 1 empties its text, 2 takes its marks . ! ? away, 3 repeats it, 4 makes it the
    user's. Nulls, in the checksum too, are one space. Rows of one place share their fate."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv), space(turn))) % 20
    body = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    rows = conversations.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space(role)).alias("role"), body.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_time", F.explode(F.expr("sequence(1, _times)"))).drop("_times", "_time")


def _fault(text: Column, again: Column) -> Column:
    bare = F.rtrim(text, F.lit(BLANK))
    return F.when(bare == "", BLANK_ROW).when(again, DUPLICATE_ROW).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED_ROW).otherwise(SOUND)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each
    conversation, a null one included.

    Rows stand by turn, nulls first, those of one turn by role and text, of equal rows the
    first isn't a duplicate. Null roles and texts
    are one space; a row of an empty role has no initial, so it can't be kept as it is. A row that is gone counts for nothing but that its conversation is returned:
    without other rows all numbers are 0, the audit is empty and the digest that of nothing.
    Other columns are not read, whatever their names; an empty table gives no rows. Texts of
    any length are taken whole. All rows of a conversation go through one task, as a stream
    that is sorted by Spark, which spills where it must."""
    away = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), F.when(away, "").otherwise(space(text)).alias("text"), away.alias("gone"))
    own = own.withColumn("same", F.when(~F.col("gone"), F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256))).repartition("conv_id")
    # the rows of a conversation are in one place already: this only sorts
    again = F.row_number().over(W.partitionBy("conv_id", "same").orderBy(F.col("turn").asc_nulls_first())) > 1
    own = own.withColumn("fault", _fault(F.col("text"), again).cast("int")).drop("same").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE_ROW)
    kind = rows.schema[conv].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, keys, out = None, None, [], []
        for batch in batches:
            for key, place, name, body, away_, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is None or key != current:
                    if at is not None:
                        keys.append(current)
                        out.append(at.end())
                    current, at = key, Walk()
                if not away_:
                    at.add(place, name, body, fault)
            yield _results(keys, out, batch.schema.field(0).type)
            keys, out = [], []
        if at is not None:
            yield _results([current], [at.end()], batch.schema.field(0).type)

    return own.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(walk, f"conv_id {kind}, " + ", ".join(f"{c} {'long' if c not in ('audit', 'repaired_sha256') else 'string'}" for c in RESULT))


def _results(keys: list, out: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in RESULT]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array([r[c] for r in out], t) for c, t in zip(RESULT, types, strict=True))], ["conv_id", *RESULT])
