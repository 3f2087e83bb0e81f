"""What the operators share: reading tables, shared storage, whole-text helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from ..sources.tables import fresh_path, table

__all__ = ["forget", "fresh_path", "kept", "mix", "pieces", "settle", "table", "text_words", "word_hashes", "words"]

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")

#: A text is worked on in pieces of about so many bytes, cut at white space.
PIECE = 1 << 22


_KEPT: dict = {}


def kept(name: tuple, make: Callable[[], Any]) -> Any:
    """What this Python process keeps from task to task: one thing at a time, so that the
    memories of a pipeline's stages, which share their processes, don't add up."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drop what kept() holds: at the beginning of tasks that need their memory otherwise."""
    _KEPT.clear()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through a table written in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.option("parquet.block.size", 1 << 24).parquet(path)  # small row groups need little memory
    return spark.read.schema(df.schema).parquet(path)


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The bytes in pieces that end at white space, so that no word is cut."""
    at = 0
    while len(data) - at > size:
        found = _SPACE.search(data, at + size)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:] if at else data


def words(data: bytes) -> Iterator[list[bytes]]:
    """Lists of the words (runs without ASCII white space), one list for each piece."""
    for piece in pieces(data):
        yield piece.split()


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) over unsigned integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _GOLD * np.uint64(2 * salt + 1)
        x = (x ^ (x >> np.uint64(30))) * _C1
        x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B185EBCA87)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[name] = np.multiply.accumulate(full)
    return have[:n]


def word_hashes(data: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of all words in a byte array.

    is_word: 256 booleans, which bytes belong to words. fold: 256 bytes, what each byte
    counts as. A word's hash depends on its folded bytes and its length alone."""
    inside = is_word[data]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64), start
    n = len(data) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n, np.uint64)
        sums[0] = 0
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n - 1), out=sums[1:])
        value = (sums[end] - sums[start]) * _powers("down", _INVERSE, n)[start]
    return mix(value + mix((end - start).astype(np.uint64))), start


def text_words(data: bytes, is_word: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The hashes of a text's words, in order."""
    parts = [word_hashes(np.frombuffer(p, np.uint8), is_word, fold)[0] for p in pieces(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


#: Words as runs without ASCII white space; A-Z counts as a-z.
ANY_WORD = np.ones(256, bool)
ANY_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
