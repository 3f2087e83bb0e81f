"""Files as they lie in a folder: what kind they are by their first bytes, which may come in,
what they hold, and which is the newest. Codecs of office files are outside; text is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import DOCUMENTS, LIMITS, SHEETS, latest, listing, manifest

# First bytes of file kinds, in hexadecimal.
SIGNATURES = {"pdf": "25504446", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1"}
#: The bytes that a file of each name should begin with; other names are text.
EXPECTED = {"pdf": "pdf", **dict.fromkeys([k for k in (*DOCUMENTS, *SHEETS) if k.endswith("x")], "zip"), "doc": "ole", "xls": "ole"}


def kind_of(head: Column) -> Column:
    """pdf, zip (the newer office kinds), ole (the older ones), text or, with a zero byte, binary."""
    code = F.hex(head)
    known = [F.when(code.startswith(v), F.lit(k)) for k, v in SIGNATURES.items()]
    return F.coalesce(*known, F.when(code.rlike("^(?:..)*?00"), F.lit("binary")).otherwise("text"))


def scan(spark: SparkSession, path: str, pattern: str = "*", limits: dict[str, int] = LIMITS) -> DataFrame:
    """path, length, modificationTime, kind, accepted, reason of the files under a folder.

    First the name and the length decide, as manifest() states, for kinds that have limits; a
    file whose first bytes are of another kind than its name says is refused. Hidden and empty
    files aren't listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.filter((F.col("length") > 0) & ~F.regexp_extract("path", r"[^/]+\z", 0).startswith("."))
    ruled = files.withColumn("kind", kind_of(F.substring("content", 1, 64)))
    name = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1))
    expected = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in EXPECTED.items()], F.lit("text"))
    limit = F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in limits.items()])
    reason = F.when(name == "doc", "old format").when(F.col("length") > limit, "too large").when(F.col("kind") != expected, "another kind than its name says")
    return ruled.select("path", "length", "modificationTime", "kind", reason.isNull().alias("accepted"), reason.alias("reason"))


def texts(spark: SparkSession, path: str, pattern: str = "*", encoding: str = "UTF-8") -> DataFrame:
    """path, text of the files that hold text, whole; bytes that aren't of the encoding become
    replacement characters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.filter(kind_of(F.substring("content", 1, 64)) == "text")
    text = F.expr("make_valid_utf8(cast(content as string))") if encoding.upper() == "UTF-8" else F.decode("content", F.lit(encoding))
    return files.select("path", text.alias("text"))


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("modificationTime").desc(), F.col("path").desc())


def write_files(rows: DataFrame, text: str, folder: str, by: str) -> None:
    """Each row's text as a file of its own in the subfolder that the column by names."""
    one = rows.select(F.col(text).cast("string").alias("value"), F.col(by))
    one.write.partitionBy(by).option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)


__all__ = ["EXPECTED", "SIGNATURES", "kind_of", "latest", "listing", "manifest", "newest_first", "scan", "texts", "write_files"]
