"""Which of many terms stand in a text: an automaton over the terms' beginnings walks each text once,
and what may be a term is joined with the terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import settled, sorted_join

#: Letters of the beginnings in the automaton, which is sent to all tasks.
LETTERS = 1 << 21
#: Letters that a beginning may have; the longest are taken that stay within LETTERS.
HEADS = (32, 16, 12, 8, 4, 2, 1)
_DIGITS = frozenset("0123456789")


def apart(text: str, start: int, stop: int) -> bool:
    """Whether what stands at the place has no digit around it, nor a digit and a space or dash before it."""
    before = text[max(0, start - 2) : start]
    if text[stop : stop + 1] in _DIGITS or before[-1:] in _DIGITS:
        return False
    return not (before[-1:] in frozenset(" \t\n\x0b\f\r-") and before[:1] in _DIGITS and len(before) == 2)


def standing(rows: DataFrame, text: str, terms: DataFrame, term: str, ok: Callable[[str, int, int], bool] | None = None, letters: int = LETTERS, keys: list[str] | None = None) -> DataFrame:
    """rows with each term that stands in their text, once, if ok(text, start, stop) of one place.

    keys: columns of both sides that must be equal, too. Each text is walked once: where a
    term's beginning stands, the parts are taken that are as long as terms of this beginning,
    and these are joined with the terms. The terms aren't sent to the tasks, only their
    beginnings with their lengths, of about so many letters. Null and empty terms and null
    texts match nothing; repeated rows are matched each."""
    keys = keys or []
    # found once, as they are looked at several times
    own = settled(terms.select(F.col(term).cast("string").alias(term), *keys).filter(F.length(term) > 0).distinct())
    head = lambda n: F.struct(F.left(term, F.lit(n)).alias("h"), F.length(term).alias("n"))
    sizes = own.agg(*[F.approx_count_distinct(head(n)).alias(f"_{n}") for n in HEADS]).first()
    most = next((n for n in HEADS if sizes[f"_{n}"] * n <= letters), HEADS[-1])
    heads = own.select(head(most).alias("x")).groupBy("x.h").agg(F.sort_array(F.collect_set("x.n")).alias("n")).collect()
    if not heads:  # then no text is walked
        return rows.withColumn(term, F.lit("")).filter("false")
    sent = rows.sparkSession.sparkContext.broadcast([(r.h, r.n) for r in heads])
    at, schema = rows.columns.index(text), rows.select("*", F.lit("").alias(term)).schema
    return sorted_join(rows.mapInArrow(_parts(sent, at, schema, ok), schema), own, [term, *keys]).select(*rows.columns, term)


def _parts(sent, at: int, schema, ok: Callable[[str, int, int], bool] | None):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for head, lengths in sent.value:
            automaton.add_word(head, (len(head), lengths))
        automaton.make_automaton()
        for batch in batches:
            row, found = [], []
            for n, value in enumerate(batch.column(at).to_pylist() if len(automaton) else ()):
                seen = set()
                for end, (size, lengths) in automaton.iter(value or ""):
                    start = end + 1 - size
                    for length in lengths:
                        stop = start + length
                        if stop > len(value):
                            break
                        t = value[start:stop]
                        if t not in seen and (ok is None or ok(value, start, stop)):
                            seen.add(t)
                            row.append(n)
                            found.append(t)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns), pa.array(found, pa.string())], schema.names)

    return walk
