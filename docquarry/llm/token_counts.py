"""Token counts: an exact histogram of encoded lengths.

Documents are aggregated by encoded length, inside each task first; one row for each length
holds counts and suffix sums. They answer totals, quantiles and truncated totals for every
context limit without another look at the texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import settle
from .tokenizing import encoder as encoder_of, tokenizer_path

#: Lengths are summed in ranges of so many first, so that no window runs over all of them.
RANGE = 1024


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None, extra: int = 0) -> DataFrame:
    """length, documents, tokens, documents_from, tokens_from, truncated, share_to.

    length: ids of a text, plus extra for each document (end marks). documents and tokens:
    of just that length. documents_from and tokens_from: of that length or more. truncated:
    tokens left when every document is cut to that length. share_to: share of documents of
    at most that length. Nulls and empty texts have the length extra; an empty table gives no
    rows; other columns are not read, so their names don't matter."""
    path = path or tokenizer_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = encoder_of(path), Counter()
        for batch in batches:
            for ids in encoder.encode_batch(batch.column(0).to_pylist()):
                found[len(ids) // encoder.dtype.itemsize + extra] += 1
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(found), pa.int64()), "documents": pa.array(list(found.values()), pa.int64())})

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "length long, documents long")
    # a row for each length, written once: it is read on both sides of the join
    counts = settle(counts.groupBy("length").agg(F.sum("documents").alias("documents")))
    counts = counts.withColumn("tokens", F.col("length") * F.col("documents")).withColumn("_range", F.expr(f"length div {RANGE}"))
    ranges = counts.groupBy("_range").agg(F.sum("documents").alias("_d"), F.sum("tokens").alias("_t"))
    later = W.orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("_range").alias("_of"),
        *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in ("_d", "_t")),
        *(F.sum(c).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(name) for c, name in (("_d", "_all"), ("_t", "_total"))),
    )
    inner = W.partitionBy("_range").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = counts.join(ranges, F.col("_range") == F.col("_of"))
    out = out.withColumn("documents_from", F.sum("documents").over(inner) + F.col("_d_later")).withColumn("tokens_from", F.sum("tokens").over(inner) + F.col("_t_later"))
    # what is longer is cut to length; what is shorter stays whole
    return out.select(
        "length", "documents", "tokens", "documents_from", "tokens_from",
        (F.col("_total") - F.col("tokens_from") + F.col("length") * F.col("documents_from")).alias("truncated"),
        ((F.col("_all") - F.col("documents_from") + F.col("documents")) / F.col("_all")).alias("share_to"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: documents, tokens, cut (documents over the limit), kept (tokens left)."""
    over = F.col("length") > limit
    return histogram.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(over, F.col("documents"))), F.lit(0)).alias("cut"),
        F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("documents")), F.lit(0)).alias("kept"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row, length: the smallest that at least the given share of documents doesn't pass."""
    return histogram.filter(F.col("share_to") >= share).agg(F.min("length").alias("length"))
