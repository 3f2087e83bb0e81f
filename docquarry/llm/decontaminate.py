"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over token positions; a hash of the selected tokens is the same in the
test item and in the training text even if the tokens in between were substituted. Hashes of
both sides are joined. Around each hit the two texts are laid side by side, and the overlap
counts if enough tokens are equal in place: substitutions are tolerated, chance hits are not.

The test set is the small side. While it has at most MOST_SENT tokens, its seeds go to all
executors, and training texts are not shuffled at all. A larger one is split into parts of
about that size by a hash of the item, and each part is joined by itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, forget, settle, text_words

#: Masks: x is selected, . is ignored. In any WINDOW tokens, and in any item of at least so many,
#: one of them misses all substitutions that SHARE allows (the tests go through all patterns).
MASKS = ("xx.x.xxx", "xxx..x..xx", "xx.x....x.xx", "xx.xxxx", "xxx..x.xx", "xxx.x.....xx", "xxx..x...x.x")
#: The same for items of LEAST_TOKENS to WINDOW - 1 tokens.
SHORT_MASKS = ("x.xxx", "xxx..x", "xx....xx")
#: An overlap counts where at least 3 of 4 tokens are equal, over the whole item or over WINDOW
#: tokens. Items of fewer than LEAST_TOKENS tokens count where all tokens are equal.
WINDOW, SHARE, LEAST_TOKENS = 13, 0.75, 8
#: Tokens of the test set in one part: about 200 MB with all seeds.
MOST_SENT = 2_000_000

#: Tokens are runs of letters and digits; bytes above ASCII are letters. A-Z counts as a-z.
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(text: str | None) -> np.ndarray:
    return text_words((text or "").encode(), TOKEN, LOWER)


def seeds(t: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash at each place where the whole mask fits."""
    n = len(t) - len(mask) + 1
    h = np.zeros(max(0, n), np.uint64)
    if n > 0:
        # tokens are hashes already, so that a polynomial of them is one
        with np.errstate(over="ignore"):
            for i, c in enumerate(mask):
                if c == "x":
                    h *= _ODD
                    h += t[i : i + n]
            h *= _ODD + np.uint64(2 * salt)
    return h


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash by which a place is looked up first.
_TOP = 20


class TestSet:
    """The tokens of all items and where each seed hash occurs."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], masks: tuple[str, ...] = MASKS):
        items = [(k, t) for k, t in items if len(t)]
        self.keys, self.size = [k for k, _ in items], np.array([len(t) for _, t in items], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size))).astype(np.int64)
        self.all = np.concatenate([t for _, t in items]) if items else np.empty(0, np.uint64)
        # (mask, least, most): the masks and the sizes of the items that they serve
        kinds = [("x" * n, n, n) for n in range(1, LEAST_TOKENS)]
        kinds += [(m, LEAST_TOKENS, WINDOW - 1) for m in SHORT_MASKS] + [(m, WINDOW, None) for m in masks]
        self.masks, self.hashes, self.item, self.at, self.top = [], [], [], [], []
        for salt, (m, least, most) in enumerate(kinds):
            own = np.flatnonzero((self.size >= least) & (self.size <= (most or np.inf)))
            got = [seeds(items[i][1], m, salt) for i in own]
            h = np.concatenate(got) if got else np.empty(0, np.uint64)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            self.masks.append((m, salt))
            self.hashes.append(h[order])
            self.item.append(np.repeat(own, [len(x) for x in got])[order])
            self.at.append(np.concatenate([np.arange(len(x)) for x in got])[order])
            top = np.zeros(1 << _TOP, bool)
            top[h >> np.uint64(64 - _TOP)] = True
            self.top.append(top)

    def overlaps(self, t: np.ndarray, window: int = WINDOW, share: float = SHARE) -> list[tuple[int, int, int, int, float]]:
        """(item, start, length, equal, similarity) of the best overlap with each item."""
        lines = set()
        for (m, salt), hashes, top, items, at in zip(self.masks, self.hashes, self.top, self.item, self.at, strict=True):
            h = seeds(t, m, salt)
            some = np.flatnonzero(top[h >> np.uint64(64 - _TOP)])
            lo = np.searchsorted(hashes, h[some])
            hit = hashes[np.minimum(lo, len(hashes) - 1)] == h[some]
            for i, first in zip(some[hit].tolist(), lo[hit].tolist(), strict=True):
                hi = np.searchsorted(hashes, h[i], "right")
                lines.update(zip(items[first:hi].tolist(), (i - at[first:hi]).tolist(), strict=True))
        best = {}
        for item, shift in lines:
            a, b = max(0, -shift), min(int(self.size[item]), len(t) - shift)  # of the item, where both have tokens
            own = self.all[self.start[item] + a : self.start[item] + b]
            same = own == t[shift + a : shift + b]
            n = int(self.size[item])
            equal = int(same.sum())
            found = None
            if equal >= (share * n if n >= LEAST_TOKENS else n):
                found = (shift + a, b - a, equal, equal / n)
            elif b - a >= window:
                sums = np.convolve(same, np.ones(window, int), "valid")
                good = np.flatnonzero(sums >= share * window)
                if len(good):
                    # from the first good window to the end of the last
                    p, q = int(good[0]), int(good[-1]) + window
                    equal = int(same[p:q].sum())
                    found = (shift + a + p, q - p, equal, equal / (q - p))
            if found and (item not in best or (found[2], -found[0]) > (best[item][2], -best[item][0])):
                best[item] = found
        return [(self.keys[i], *v) for i, v in sorted(best.items())]


def contamination(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, most: int = MOST_SENT) -> DataFrame:
    """doc_id, item_id, start, length, equal, similarity: each document and item that overlap.

    start and length: the tokens of the document that are covered. equal: tokens equal in
    place. similarity: equal as a share of the item, or of the covered tokens where only a part
    of the item was found. Null and empty texts overlap with nothing; items of fewer than
    LEAST_TOKENS tokens overlap where all their tokens stand in the document in a row. Rows
    without a key come out with a null one; repeated rows repeatedly. Without documents or tests there are no rows. Other columns are not read."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for held, more in _sent(docs.sparkSession, tests, item, item_text, masks, most):
        found = _search(docs, held)
        if more:  # one part after the other: what was sent for it goes before the next
            found = settle(found)
            held.unpersist()
        out = found if out is None else out.union(found)
    return out


def _sent(spark, tests: DataFrame, item: str, item_text: str, masks: tuple[str, ...], most: int) -> Iterator[tuple[Any, bool]]:
    """The test set on all executors, in parts of at most about that many tokens, and whether
    there are several. A part is built when it is asked for."""
    tests = tests.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    # a token has a byte and, but for the last, a separator
    size = tests.agg(F.sum((F.octet_length("text") + 2) / 2)).first()[0] or 0
    parts = max(1, int(-(-size // most)))
    for part in range(parts):
        own = tests if parts == 1 else tests.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield spark.sparkContext.broadcast(TestSet([(r.item_id, tokens(r.text)) for r in own.toLocalIterator()], masks)), parts > 1


def _search(docs: DataFrame, held) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(key, *x) for x in held.value.overlaps(tokens(text.as_py()))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "length", "equal", "similarity"])

    return docs.mapInArrow(search, "doc_id long, item_id long, start long, length long, equal long, similarity double")


def decontaminated(docs: DataFrame, tests: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, most: int = MOST_SENT) -> DataFrame:
    """The rows of docs, all columns, whose text overlaps with no test item; nothing is shuffled.

    Null and empty texts overlap with nothing and stay, as do rows without a key, which are
    judged like others. Repeated rows stay or go together. Without tests all rows stay; an
    empty table stays empty. Columns of any name pass through."""
    for held, more in _sent(docs.sparkSession, tests, item, item_text, masks, most):
        docs = docs.filter(_clean(held)(F.coalesce(F.col(text).cast("string"), F.lit(""))))
        if more:
            docs = settle(docs)
            held.unpersist()
    return docs


def _clean(held):
    """A function of texts: whether they overlap with none of the items sent."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        forget()
        return pd.Series([not held.value.overlaps(tokens(t)) for t in texts], dtype=bool)

    return clean
