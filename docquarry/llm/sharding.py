"""Sharding by jump consistent hashing.

A stable key and the number of shards decide a row's shard; there is no table of a ring. With
one more shard, only the rows that go into it move: about one in that many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import settle

#: Rows of a shard are numbered in so many blocks, each by itself.
BLOCKS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    key = keys.astype(np.int64).view(np.uint64).copy()
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(going):
            at[going] = to[going]
            key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            to[going] = ((at[going] + 1) * step).astype(np.int64)
            going = going[to[going] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a long key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_table(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    size: bytes of the text and 1, as for a separator; a null text has size 1 and the checksum
    of nothing. slot: rows of a shard are numbered from 0 without a gap, by blocks that a hash
    of the row deals out, then by key; rows without a key are spread over the blocks as well,
    and equal rows get different slots. grown_shard: where the row is with one more shard.
    Texts are read once: what is known of them is written, and only that goes on. Other columns
    are not read."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = rows.withColumn("shard", jump_shard(F.col("doc_id"), shards)).withColumn("grown_shard", jump_shard(F.col("doc_id"), shards + 1))
    rows = settle(rows.withColumn("_block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks))))
    # at most shards x blocks rows, however large the table is
    counts = rows.groupBy("shard", "_block").count()
    before = counts.select("shard", "_block", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("shard", "_block").orderBy("doc_id", "size", "text_crc32"))
    out = rows.withColumn("_own", own).join(before, ["shard", "_block"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_own") - 1).alias("slot"), "grown_shard")
