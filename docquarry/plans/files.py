"""Queries over files: given tables are written as files, listed, gated and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as functions, text as X
from ..sources import files
from ..sources.tables import fresh_path, table

QUERIES, SQL = {}, {}

# Texts can't begin with the older kind's bytes, so four kinds of files are made.
_HEADS = ["%PDF-1.7 ", "PK\x03\x04", "\x00\x01", ""]


def _written(spark, d) -> str:
    """Pages as files: by turns they begin like a PDF, an office file, a binary one and a text."""
    out = fresh_path(spark, "files")
    pages = table(spark, d, "pages").filter("html is not null")
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    files.write_files(pages.select(F.concat(head, "html").alias("t"), F.pmod("page_id", F.lit(4)).alias("turn")), "t", out, "turn")
    return out


def file_scan(spark, d):
    """What stands in the folder, by kind; Spark's own names say that all of them are text."""
    found = files.scan(spark, _written(spark, d))
    return found.groupBy("kind", "accepted", "reason").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


QUERIES["file_scan"] = file_scan
SQL["file_scan"] = """SELECT ['pdf', 'zip', 'binary', 'text'][page_id % 4 + 1] AS kind, page_id % 4 = 3 AS accepted, CASE WHEN page_id % 4 <> 3 THEN 'another kind than its name says' END AS reason,
  count(*) AS files, CAST(sum(octet_length(encode(html)) + [9, 4, 2, 0][page_id % 4 + 1] + 1) AS BIGINT) AS bytes FROM pages WHERE html IS NOT NULL GROUP BY ALL"""


def file_texts(spark, d):
    """The texts that are read back; a written row ends with a line end."""
    return files.texts(spark, _written(spark, d)).select(F.md5("text").alias("digest"), F.length("text").alias("n"))


QUERIES["file_texts"] = file_texts
SQL["file_texts"] = "SELECT md5(html || chr(10)) AS digest, length(html) + 1 AS n FROM pages WHERE html IS NOT NULL AND page_id % 4 = 3"


def file_newest(spark, d):
    """Documents arrive by language, one after the other: the newest object is the last one's."""
    out = fresh_path(spark, "files")
    docs = table(spark, d, "documents").filter("lang is not null and text <> ''")
    last = docs.agg(F.max("lang")).first()[0]
    for late in (False, True):
        own = docs.filter(F.col("lang") == last if late else F.col("lang") != last)
        own.groupBy("lang").agg(F.count("*").cast("string").alias("n")).write.mode("append").partitionBy("lang").text(out)
    newest = files.latest(files.listing(spark, out))
    return newest.select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"))


QUERIES["file_newest"] = file_newest
SQL["file_newest"] = "SELECT max(lang) AS lang FROM documents WHERE text <> ''"


def sql_functions(spark, d):
    """Column functions called by their names in SQL, over all documents."""
    functions.register(spark, ["title_key_plain", "strip_markdown", "garbage_document"])
    table(spark, d, "documents").createOrReplaceTempView("named_documents")
    return spark.sql("SELECT doc_id, md5(title_key_plain(text)) AS key, length(strip_markdown(text)) AS n FROM named_documents WHERE garbage_document(text) IS NOT NULL")


QUERIES["sql_functions"] = sql_functions
SQL["sql_functions"] = f"SELECT doc_id, md5({X.title_key_plain.sql('text')}) AS key, length({X.markdown_plain.sql('text')}) AS n FROM documents"
