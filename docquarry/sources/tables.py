"""Reading tables, texts and file listings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MB = 1 << 20
# What uploads may be, and how large.
DOCUMENTS, SHEETS = ("pdf", "doc", "docx"), ("xlsx", "xls")
LIMITS = {**dict.fromkeys(DOCUMENTS, 100 * MB), **dict.fromkeys(SHEETS, 50 * MB)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where the session names none, it is a folder of the warehouse, and in a session of one
    process a temporary one. A warehouse on a local disk is refused where there are others."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith(("file:", "/")):
            raise ValueError("executors don't share the warehouse's folder: set spark.checkpoint.dir to one that they do")
        return f"{warehouse}/_jobs"
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Narrow rows, and whole pages, of one task of costly work.
ROWS_A_TASK, PAGES_A_TASK = 50_000, 2_000


def spread(rows: DataFrame, most: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt evenly, or by a key that hardly repeats, over all cores and about so many a task
    at most (none: ROWS_A_TASK): costly work on each isn't left to the few tasks that hold the row
    groups of a small file. Dealt by a key, rows needn't be dealt anew where they are joined by it."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // (most or ROWS_A_TASK))), *by)


def settled(df: DataFrame) -> DataFrame:
    """The rows, written in the shared folder and read again: they stay as they are dealt."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_join(left: DataFrame, right: DataFrame, on: list[str] | str | Column, how: str = "inner") -> DataFrame:
    """A join of sides that both grow with the tables: neither is sent through the driver, however
    small Spark takes it to be by its compressed file or by what it is derived from."""
    return left.join(right.hint("merge"), on, how)


def manifest(files: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """path, length, accepted, reason of a listing with columns path and length.

    The kind is the name's extension; names that step out of their folder are refused. Nulls
    are refused as unknown."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    limit = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in limits.items()])
    reason = (
        F.when(F.col("path").isNull() | F.contains("path", F.lit("..")), "bad name").when(limit.isNull(), "unknown kind").when(kind == "doc", "old format")
        .when(F.col("length").isNull() | (F.col("length") > limit), "too large")
    )
    return files.select("path", "length", reason.isNull().alias("accepted"), reason.alias("reason"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of files, without their contents; hidden and empty ones left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").filter((F.col("length") > 0) & ~F.regexp_extract("path", r"[^/]+\z", 0).startswith("."))


def latest(files: DataFrame, by: Column | None = None) -> DataFrame:
    """The newest file of a listing, of equally new ones the last by name."""
    when = F.col("modificationTime") if by is None else by
    return files.agg(F.max_by("path", F.struct(when, "path")).alias("path"))
