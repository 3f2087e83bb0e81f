"""The column functions under names that SQL can call, as temporary functions of a session.

A function's body is the SQL text of its own column expression, so both are the same. Those
that bind a name to a value (a transform of one element) have no such text and aren't here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from . import entities as E, lines as L, text as X

#: Name: the function, and the types of its arguments.
FUNCTIONS: dict[str, tuple[Callable[..., Column], list[str]]] = {
    "html_inline": (X.html_inline, ["string"]), "html_template": (X.html_template, ["string"]), "html_block": (X.html_block, ["string"]), "html_paragraphs": (X.html_paragraphs, ["string"]),
    "html_export": (X.html_export, ["string"]), "decode_entities": (X.entities, ["string"]), "title_key_folded": (X.title_key_folded, ["string"]), "title_key_plain": (X.title_key_plain, ["string"]),
    "title_key_compare": (X.title_key_compare, ["string"]), "strip_markdown": (X.markdown_plain, ["string"]), "standard_name": (X.standard_name, ["string"]), "regulation_name": (X.regulation_name, ["string"]),
    "fix_mojibake": (X.fix_mojibake, ["string"]), "parse_quantity": (X.parse_quantity, ["string"]), "search_term": (X.search_term, ["string"]), "confidence_bucket": (X.confidence_bucket, ["double"]),
    "valid_uuid": (X.valid_uuid, ["string"]), "table_line": (L.table_line, ["string"]), "heading_line": (L.heading_line, ["string"]), "role_line": (L.role_line, ["string"]), "garbage_line": (L.garbage_line, ["string"]),
    "garbage_document": (L.garbage_document, ["string"]), "document_class": (L.document_class, ["string", "string"]), "authority": (E.authority, ["string"]), "subject": (E.subject, ["string"]), "order_number": (E.order_number, ["string"]),
}


def body(spark: SparkSession, make: Callable[..., Column], kinds: list[str]) -> tuple[str, str]:
    """The SQL text and the type of a function of columns p0, p1, ..."""
    names = [f"p{n}" for n in range(len(kinds))]
    holder = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))).select(make(*map(F.col, names)).alias("out"))
    # the project's one expression, which is an alias
    text = holder._jdf.queryExecution().analyzed().expressions().head().child().sql()
    return text, holder.schema["out"].dataType.simpleString()


def register(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Make the functions (all, or some by name) callable in the session's SQL; their names."""
    for name in names or FUNCTIONS:
        make, kinds = FUNCTIONS[name]
        text, kind = body(spark, make, kinds)
        args = ", ".join(f"p{n} {k}" for n, k in enumerate(kinds))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {text}")
    return list(names or FUNCTIONS)
