"""All matches of patterns with their places, and tables that stand in no other.

Spark has no expression that gives the places of all matches; these are functions of Arrow
batches inside tasks, linear in the text, and nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

_SPACE = r" \t\n\x0b\f\r"
TABLE_TAG = r"(?i)</?table[^>]*>"


def python_pattern(pattern: str) -> str:
    """A pattern of Java's in Python's words: white space and digits are ASCII, and the end is the end."""
    return pattern.replace(r"[.\s]", f"[.{_SPACE}]").replace(r"\s", f"[{_SPACE}]").replace(r"\d", "[0-9]").replace(r"\z", r"\Z").replace("(?iu)", "(?i)")


def _structs(texts: pa.Array, rows: Callable[[str], Iterator[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """For each text a list of structs; null for null."""
    offsets, found = [], []
    for text in texts.to_pylist():
        offsets.append(None if text is None else len(found))
        if text:
            found.extend(rows(text))
    offsets.append(len(found))
    columns = zip(*found, strict=True) if found else [[] for _ in fields]
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], fields=[pa.field(name, t) for name, t in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def all_matches(text: Column, patterns: list[str], begins: list[str] | None = None) -> Column:
    """Array of structs pattern (its number), at (from 0), raw of all matches, by pattern and place.

    begins: for each pattern, which matches no empty text, one that is found wherever a match may
    begin and none of whose finds hides another; the pattern is tried there only."""
    texts, heads = [python_pattern(p) for p in patterns], [python_pattern(p) for p in begins or []]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled, places = [re.compile(p) for p in texts], {h: re.compile(h) for h in heads}

        def tried(text: str) -> Iterator[tuple]:
            found = {h: [m.start() for m in p.finditer(text)] for h, p in places.items()}
            for n, (p, h) in enumerate(zip(compiled, heads, strict=True)):
                stop = 0
                for at in found[h]:
                    if at >= stop and (m := p.match(text, at)):
                        stop = m.end()
                        yield n, at, m[0]

        def rows(text: str) -> Iterator[tuple]:
            for n, p in enumerate(compiled):
                for m in p.finditer(text):
                    yield n, m.start(), m[0]

        for batch in batches:
            yield _structs(batch, tried if heads else rows, [("pattern", pa.int32()), ("at", pa.int32()), ("raw", pa.string())])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<pattern:int,at:int,raw:string>>")(text)


_SPAN = [("ord", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("table", pa.string())]
_SPANS = "array<struct<ord:bigint,start:int,stop:int,table:string>>"


def _tables(most: int) -> Callable[[str], Iterator[tuple]]:

    def rows(text: str) -> Iterator[tuple]:
        depth = ord_ = start = 0
        for m in re.finditer(TABLE_TAG, text):
            if m[0][1] != "/":
                if depth == 0:
                    ord_, start = ord_ + 1, m.start()
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0:
                    yield ord_, start, m.end(), text[start : m.end()]
        if depth:
            stop = min(start + most, len(text))
            yield ord_, start, stop, text[start:stop]

    return rows


def table_spans(html: Column, most: int = 8000) -> Column:
    """Array of structs ord (from 1), start (from 0), stop, table of the tables that stand in no other.

    A stray end tag is passed over; a table without an end reaches so many letters on, or to
    the text's end. The depth of tags is all that is held on the way."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _structs(batch, _tables(most), _SPAN)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _SPANS)(html)


def table_spans_each(texts: Column, most: int = 8000) -> Column:
    """For an array of texts an array of what table_spans() gives for each of them."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, stop = [], 0
            for n in batch.value_lengths().to_pylist():
                offsets.append(None if n is None else stop)
                stop += n or 0
            yield pa.ListArray.from_arrays(pa.array([*offsets, stop], pa.int32()), _structs(batch.flatten(), _tables(most), _SPAN))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"array<{_SPANS}>")(texts)
