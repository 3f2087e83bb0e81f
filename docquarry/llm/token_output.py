"""Token-ID output: raw id shards with a minimal perfect hash index.

Layout of a shard file, all numbers little-endian:

    magic 8 bytes, then 8 x u64: partition, sequence, documents, keys, tokens, buckets,
    bytes of one id, 1 if the first document has no key
    ids         tokens x id size      every document's ids and its end id, in key order
    starts      (documents + 1) x u64 where each document begins, counted in ids
    keys        documents x i64       ascending, for walking through the shard
    moves       buckets x i32         the hash's displacement of each bucket; -1 - s: slot s
    prints      keys x u32            the fingerprint of the key in each slot
    ordinals    keys x u32            the first document of the key in each slot
    one line feed

A lookup hashes the key to a bucket, reads its move, computes the slot, compares the
fingerprint and reads the ordinal and its start: constant time whatever the shard's size. A
table of shards (write_index()) tells the shard of a key, so a folder isn't walked (lookup())."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import fresh_path, mix, settle
from .tokenizing import encoder as encoder_of, tokenizer_path

MAGIC = b"IDSHARD1"
#: Ids of a shard: about 8 MB, so that one fits any task many times over.
SHARD_IDS = 1 << 22


class PerfectHash:
    """Hash and displace: keys fall into buckets, and each bucket, the fullest first, gets the
    first displacement that sends all its keys to free slots. As many slots as keys."""

    def __init__(self, moves: np.ndarray, n: int):
        self.moves, self.n = moves, n

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        moves = np.zeros(max(1, -(-n // 3)), np.int32)
        if not n:
            return PerfectHash(moves, 0)
        hashed = mix(keys.view(np.uint64))
        bucket = (hashed % np.uint64(len(moves))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, size = np.unique(bucket[order], return_index=True)[1], np.bincount(bucket)
        free = np.ones(n, bool)
        full = np.flatnonzero(size)
        for k in np.argsort(-size[full], kind="stable"):
            own = hashed[order[at[k] : at[k] + size[full[k]]]]
            if len(own) == 1:
                break
            first = 1
            while True:
                slots = PerfectHash._slots(own[None, :], np.arange(first, first + 64)[:, None], n)
                ok = free[slots].all(1) & (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                if ok.any():
                    break
                first += 64
            found = int(np.argmax(ok))
            moves[full[k]] = first + found
            free[slots[found]] = False
        single = np.flatnonzero(size == 1)
        moves[single] = -1 - np.flatnonzero(free)[: len(single)]
        return PerfectHash(moves, n)

    @staticmethod
    def _slots(hashed: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(hashed + move.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; a key that isn't in the set gets some slot too."""
        hashed = mix(keys.view(np.uint64))
        move = self.moves[(hashed % np.uint64(len(self.moves))).astype(np.int64)]
        return np.where(move < 0, -1 - move.astype(np.int64), PerfectHash._slots(hashed, move.astype(np.int64), self.n))


def prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64), salt=7) >> np.uint64(32)).astype("<u4")


def pack_shard(partition: int, sequence: int, keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """The bytes of one shard; keys ascend, those without a key come first."""
    missing = sum(k is None for k in keys)
    plain = np.array([0 if k is None else k for k in keys], "<i8")
    own, first = np.unique(plain[missing:], return_index=True)
    index = PerfectHash.build(own)
    slot = index.slots(own) if len(own) else np.empty(0, np.int64)
    marks, ordinals = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    marks[slot], ordinals[slot] = prints(own), first + missing
    starts = np.zeros(len(keys) + 1, "<u8")
    np.cumsum([len(x) // width for x in ids], out=starts[1:])
    head = np.array([partition, sequence, len(keys), len(own), starts[-1], len(index.moves), width, missing], "<u8")
    return b"".join([MAGIC, head.tobytes(), *ids, starts.tobytes(), plain.tobytes(), index.moves.astype("<i4").tobytes(), marks.tobytes(), ordinals.tobytes()])


class Shard:
    """A shard's parts, as views of its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of ids")
        self.partition, self.sequence, docs, keys, tokens, buckets, width, self.missing = map(int, np.frombuffer(data, "<u8", 8, 8))
        at = 72

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.ids = take(f"<u{width}", tokens)
        self.starts, self.keys = take("<u8", docs + 1).astype(np.int64), take("<i8", docs)
        self.hash = PerfectHash(take("<i4", buckets), keys)
        self.prints, self.ordinals = take("<u4", keys), take("<u4", keys)

    def ordinal(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, -1 for keys that the shard doesn't have.

        A fingerprint has 32 bits, so one of about four milliards of foreign keys passes."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        slot = self.hash.slots(keys)
        return np.where(self.prints[slot] == prints(keys), self.ordinals[slot].astype(np.int64), -1)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document of the key."""
        k = int(self.ordinal(np.array([key], "<i8"))[0])
        return None if k < 0 else self.ids[self.starts[k] : self.starts[k + 1]]


def write_shards(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> None:
    """Write ids in shard files under out, in ascending order of the key.

    The table is dealt by ranges of the key and each task writes its shards one after the
    other. Documents without a key come first; rows that share a key keep together, in the
    order of their texts. A null text counts as empty. Other columns are not read. No file is
    written for an empty table."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(*([partitions] if partitions else []), "key", "tie").sortWithinPartitions("key", "tie")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, partition, sequence = encoder_of(path), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        keys, ids, held = [], [], 0

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([pack_shard(partition, sequence, keys, ids, width)], pa.binary())})

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for k, x in zip(part.column(0).to_pylist(), encoder.encode_batch(part.column(1).to_pylist()), strict=True):
                    keys.append(k)
                    ids.append(x + end)
                    held += len(x) // width + 1
                    if held >= shard_ids:
                        yield blob()
                        keys, ids, held, sequence = [], [], 0, sequence + 1
        if keys:
            yield blob()

    # a text file's row is its bytes and the line end, so one row in a file is a binary file
    rows.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(out)


def read_shards(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, found through the index.

    start counts the ids of all documents before it over all shards in order. Documents without
    a key come first, with a null doc_id; those that share a key stand beside each other, of
    which the index gives the first. A folder without shards gives no rows. A key that the
    index doesn't lead to raises an error."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = Shard(data.as_buffer().to_pybytes())
                found = np.arange(len(s.keys))
                own = s.keys[s.missing :]
                # rows that share a key stand next to each other: the index gives the first of them
                again = np.arange(len(own)) - np.searchsorted(own, own)
                found[s.missing :] = s.ordinal(own) + again
                if (found != np.arange(len(found))).any():
                    raise ValueError("a key isn't where its shard's index says")
                start, end = s.starts[found], s.starts[found + 1]
                crc = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(start, end, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "partition": pa.array(np.full(len(found), s.partition)), "sequence": pa.array(np.full(len(found), s.sequence)),
                    "doc_id": pa.array(s.keys, mask=np.arange(len(found)) < s.missing), "local": pa.array(start), "n_tokens": pa.array(end - start), "ids_crc32": pa.array(crc, pa.int64()),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = settle(files.mapInArrow(documents, "partition long, sequence long, doc_id long, local long, n_tokens long, ids_crc32 long"))
    shards = rows.groupBy("partition", "sequence").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("partition").agg(F.sum("n").alias("n")).select("partition", before(W.orderBy("partition")).alias("outer"))
    shards = shards.select("partition", "sequence", before(W.partitionBy("partition").orderBy("sequence")).alias("inner"))
    return rows.join(shards, ["partition", "sequence"]).join(parts, "partition").select("doc_id", (F.col("outer") + F.col("inner") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def write_index(spark, path: str) -> None:
    """Write the table of all shards beside them: file, and the smallest and largest key in it.

    It is made once, by a job that reads each shard; keyed access needs it to know the shard."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Shard(data.as_buffer().to_pybytes())
                own = s.keys[s.missing :]
                some = len(own) > 0
                yield pa.RecordBatch.from_pydict({"file": [name] * some, "partition": pa.array([s.partition] * some, pa.int64()), "sequence": pa.array([s.sequence] * some, pa.int64()), "low": pa.array(own[:1], pa.int64()), "high": pa.array(own[-1:], pa.int64())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    files.mapInArrow(spans, "file string, partition long, sequence long, low long, high long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_index/shards")


def lookup(spark, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ids (the stored integers' bytes, as wide as the shard has them) of each different key.

    The table of shards, a row for each, tells the shard by two searches; only shards that
    hold some of the keys are read, and in each the index leads a key to its slot and place.
    Keys that aren't there, and null ones, give no row; of a key that several documents share
    the first is given."""
    shards = spark.read.parquet(f"{path}/_index/shards").orderBy("partition", "sequence").collect()
    low, high, names = np.array([r.low for r in shards], np.int64), np.array([r.high for r in shards], np.int64), [r.file for r in shards]
    sent = spark.sparkContext.broadcast((low, high))

    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        k, (low, high) = k.to_numpy(np.int64), sent.value
        at = np.searchsorted(high, k)
        found = np.zeros(len(k), bool)
        found[at < len(high)] = low[at[at < len(high)]] <= k[at < len(high)]
        return pd.Series(np.where(found, at, -1).astype(np.int32))

    wanted = keys.select(F.col(key).cast("long").alias("k")).filter("k is not null").distinct().withColumn("at", shard_of("k")).filter("at >= 0")
    wanted = settle(wanted)
    needed = sorted(r.at for r in wanted.select("at").distinct().collect())  # no more than there are shards
    if not needed:
        return spark.createDataFrame([], f"`{key}` long, ids binary")
    places = spark.createDataFrame([(names[n], n) for n in needed], "path string, at int")
    files = spark.read.format("binaryFile").load([names[n] for n in needed]).select("path", "content").join(F.broadcast(places), "path")

    def found(own: pa.Table, shard: pa.Table) -> pa.Table:
        k = np.sort(own.column("k").to_numpy())
        s = Shard(shard.column("content")[0].as_buffer().to_pybytes())
        at = s.ordinal(k)
        k, at = k[at >= 0], at[at >= 0]
        k, at = k[s.keys[at] == k], at[s.keys[at] == k]  # a foreign key may have the fingerprint
        return pa.table({key: pa.array(k), "ids": pa.array([s.ids[s.starts[i] : s.starts[i + 1]].tobytes() for i in at], pa.binary())})

    return wanted.groupBy("at").cogroup(files.groupBy("at")).applyInArrow(found, f"`{key}` long, ids binary")


def token_output(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, **kw) -> DataFrame:
    """Write the shards into the shared folder and return what read_shards() finds there."""
    out = fresh_path(docs.sparkSession, "ids")
    write_shards(docs, out, key, text, path, **kw)
    return read_shards(docs.sparkSession, out)
