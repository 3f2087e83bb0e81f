"""Tables that are kept on storage and changed a little at a time, as folders of Parquet files.

Only Spark's own writers are used: dynamic partition overwrite replaces the partitions that a
change touches and leaves the files of all others as they are. What is read and overwritten is
written beside the table first, so a failure in between loses nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import library
from .tables import fresh_path

#: Parts of a table by a hash of its key, and batches that are kept aside before they are merged.
BUCKETS, DELTAS = 64, 8


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, done: bool = False) -> list[str]:
    """Names of the folders in a folder; with done those that were written to the end."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if not done or fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _folder(spark, path)
    fs.delete(at, True)


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions that rows have some of; all others stay."""
    spark = rows.sparkSession
    aside = fresh_path(spark, "aside")
    rows.write.parquet(aside)
    spark.read.schema(rows.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    remove(spark, aside)


class BucketedTable:
    """The latest row of each key, in hash buckets, with batches of changes beside them.

    add() writes a batch to a folder of its own, so a batch that is repeated after a failure
    replaces itself. After so many batches they are merged: only buckets that they touch are
    read and rewritten. rows() is the table at any time: the base and the batches that aren't
    merged yet. Rows with gone true are deleted keys; their last row stays as a mark."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], version: list[str], by: list[str] | None = None, buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.path, self.key, self.version, self.by, self.buckets, self.deltas = spark, path.rstrip("/"), key, version, by or key, buckets, deltas
        self.schema = spark.createDataFrame([], schema).withColumn("bucket", F.lit(0)).schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", path).parquet(path)

    def _latest(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = library.upsert_latest(out, p, [*self.key, "bucket"], self.version)
        return out

    def batches(self) -> list[str]:
        return sorted(folders(self.spark, f"{self.path}/delta", done=True), key=int)

    def add(self, batch: DataFrame, n: int) -> None:
        """The changes of batch n: of equal keys the row of the highest version counts."""
        done = folders(self.spark, f"{self.path}/merged", done=True)
        if str(n) in done:  # merged before the failure that repeats it
            return
        one = library.upsert_latest(batch.limit(0), batch, self.key, self.version).select(*batch.columns)
        one.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/delta/{n}")
        if len(self.batches()) >= self.deltas:
            self.merge()

    def merge(self) -> list[int]:
        """Bring all batches into the base; returns the buckets that were rewritten."""
        batches = self.batches()
        if not batches:
            return []
        parts = [self._read(f"{self.path}/delta/{n}") for n in batches]
        touched = sorted({int(f.removeprefix("bucket=")) for n in batches for f in folders(self.spark, f"{self.path}/delta/{n}") if f.startswith("bucket=")})
        if folders(self.spark, f"{self.path}/base"):
            parts.insert(0, self._read(f"{self.path}/base").filter(F.col("bucket").isin(touched)))
        overwrite_partitions(self._latest(parts), f"{self.path}/base", "bucket")
        for n in batches:
            # a mark that the batch is part of the base, then its own files go; before that it only counts twice
            self.spark.range(0).write.mode("overwrite").parquet(f"{self.path}/merged/{n}")
            remove(self.spark, f"{self.path}/delta/{n}")
        return touched

    def rows(self, of: DataFrame | None = None) -> DataFrame:
        """All rows, or those in the buckets of some keys (columns by): other files aren't read."""
        parts = [self._read(f"{self.path}/delta/{n}") for n in self.batches()]
        if folders(self.spark, f"{self.path}/base"):
            parts.insert(0, self._read(f"{self.path}/base"))
        if not parts:
            return self.spark.createDataFrame([], self.schema).drop("bucket")
        if of is not None:
            wanted = [r[0] for r in of.select(self._bucket()).distinct().collect()]  # no more than there are buckets
            parts = [p.filter(F.col("bucket").isin(wanted)) for p in parts]
        return self._latest(parts).drop("bucket")


class Library:
    """The best version of each key, kept up to date by batches of changes.

    A change is an insertion or (gone) a deletion of a row: key, id, size, created. All that is
    kept of rows is this; a batch reads the buckets of its keys and renews the state of these
    keys alone. library() equals best_version() over all rows that are there."""

    COLUMNS = "key string, id long, size long, created long, gone boolean, batch long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, deltas: int = DELTAS):
        fields = spark.createDataFrame([], self.COLUMNS).schema
        self.members = BucketedTable(spark, f"{path}/members", fields, ["key", "id"], ["batch"], ["key"], buckets, deltas)
        state = spark.createDataFrame([], "key string, id long, size long, first_seen long, gone boolean, batch long").schema
        self.state = BucketedTable(spark, f"{path}/state", state, ["key"], ["batch"], None, buckets, deltas)

    def change(self, changes: DataFrame, n: int) -> None:
        """Batch n of changes; repeated after a failure it changes nothing more."""
        changes = changes.select("key", "id", F.col("size").cast("long"), F.col("created").cast("long"), F.coalesce("gone", F.lit(False)).alias("gone"), F.lit(n).cast("long").alias("batch"))
        self.members.add(changes, n)
        keys = changes.select("key").distinct()
        # rows that share a null key are versions of one another, too
        own = self.members.rows(keys).join(keys.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left_semi").filter("not gone")
        best = own.groupBy("key").agg(F.min_by("id", F.struct(-F.col("size"), "created", "id")).alias("id"), F.max("size").alias("size"), F.min("created").alias("first_seen"))
        new = keys.withColumnRenamed("key", "_k").join(best, F.col("key").eqNullSafe(F.col("_k")), "left")
        self.state.add(new.select(F.col("_k").alias("key"), "id", "size", "first_seen", F.col("id").isNull().alias("gone"), F.lit(n).cast("long").alias("batch")), n)

    def library(self) -> DataFrame:
        """key, id, size, first_seen."""
        return self.state.rows().filter("not gone").drop("gone", "batch")


def replace_stored_children(new: DataFrame, path: str, parent: str, key: Column, only: Column, order: list[Column], parents: DataFrame | None = None) -> DataFrame:
    """Replace the children of some parents in a table that is partitioned by parent; returns parent,
    section_count of these.

    parents: which (default: those that new has rows of); they may be left without children. New
    rows are deduplicated against the children of all others, of which only the key is read.
    Files of other parents stay as they are."""
    spark = new.sparkSession
    wanted = (parents if parents is not None else new).select(parent).distinct()
    fields = new.select([c for c in new.columns if c != parent] + [parent]).schema
    others = spark.read.schema(fields).parquet(path) if folders(spark, path) else spark.createDataFrame([], fields)
    others = others.join(wanted.withColumnRenamed(parent, "_p"), F.col(parent).eqNullSafe(F.col("_p")), "left_anti").filter(only)
    fresh = library.dedup_against_library(new, others, key, key, only, order)
    aside = fresh_path(spark, "aside")
    fresh.write.parquet(aside)
    fresh = spark.read.schema(fresh.schema).parquet(aside)
    counts = fresh.groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("n"))
    counts = wanted.join(counts, F.col(parent).eqNullSafe(F.col("_p")), "left").select(parent, F.coalesce("n", F.lit(0)).cast("int").alias("section_count"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for r in counts.filter("section_count = 0").select(F.col(parent).cast("string").alias("p")).collect():
        remove(spark, f"{path}/{name(parent, r.p)}")
    return counts
