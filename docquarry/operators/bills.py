"""Bills of quantities: raw sheet cells to typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.chains import let, spaced, trim
from ..functions.lines import any_of

# What header cells may say, in order of preference.
ALIASES = {
    "code": ["код", "code", "№", "номер", "поз"],
    "name": ["наименование на видовете работи", "наименование", "name", "описание", "описание на позиция"],
    "unit": ["м.е.", "ед.", "единица", "unit", "measure"],
    "quantity": ["количество", "quantity", "кол"],
}
SCANNED = 25


def _norm(cell: Column) -> Column:
    return spaced(trim(F.lower(F.coalesce(cell, F.lit("")))))


def column_index(normal: Column, aliases: list[str]) -> Column:
    """The column (from 0) of the first alias that some normal cell holds or is part of, the
    leftmost such cell; null if there is none. Empty cells never fit."""
    fits = lambda a: lambda c: (c != "") & (F.contains(c, F.lit(a)) | F.contains(F.lit(a), c))
    hits = [F.nullif(F.array_position(F.transform(normal, fits(a)), F.lit(True)), F.lit(0)) for a in aliases]
    return (F.coalesce(*hits) - 1).cast("int")


def category_row(code: Column, name: Column) -> Column:
    """Headings between rows: sections, uppercase labels, road parts, areas and lengths."""
    return let(trim(code), lambda c: let(trim(name), lambda n: _heading(c, n, trim(F.concat(code, F.lit(" "), name)))))


def _heading(c: Column, n: Column, both: Column) -> Column:
    road, area = r"(?iu)^(улично\s+платно|тротоари|паркинг|отводняване)\z", r"(?iu)^обща\s+(площ|дължина)"
    return (
        let(both, lambda b: (b == "") | b.rlike(r"(?iu)^Сметка\s*[0-9]+")) | c.rlike(r"^[IVXіІ]+\.?\s*\z") | ((c != "") & (n == "") & c.rlike("[А-Я]{3,}"))
        | ((c == "") & (n != "") & n.rlike("[А-Я]{3,}") & (n == F.upper(n))) | any_of(c, [road, area]) | any_of(n, [road, area])
    )


def summary_row(code: Column) -> Column:
    return trim(code).rlike(r"(?iu)^(Сума|Непредвидени|Обща\s+сума|ДДС|Всичко)\s*")


def header_row(name: Column, code: Column) -> Column:
    """A header that is repeated among the rows."""
    fits = lambda n: reduce(lambda x, y: x | y, [F.contains(n, F.lit(a)) | F.contains(F.lit(a), n) for a in ALIASES["name"]])
    return let(_norm(name), lambda n: (F.length(n) > 3) & fits(n)) | _norm(code).isin(*ALIASES["code"])


def bill_headers(cells: DataFrame) -> DataFrame:
    """sheet_id, header_row, code, name, unit, quantity (columns or null), n_rows.

    The header is the first of the first rows that names both a name and a quantity, else
    row 0. cells: sheet_id, row_idx, cells."""
    # only the first rows are looked at; all are counted in the same aggregation. Most rows name no
    # quantity, or no name: other columns are looked for in those that do, and in row 0
    def header(row: Column, cells: Column) -> Column:
        at = lambda k: column_index(cells, ALIASES[k])
        whole = lambda two: F.struct(row.alias("row_idx"), at("code").alias("code"), two["name"].alias("name"), at("unit").alias("unit"), two["quantity"].alias("quantity"))
        first = lambda q: F.when(q.isNotNull() | (row == 0), F.struct(at("name").alias("name"), q.alias("quantity")))
        return let(let(at("quantity"), first), lambda two: F.when((two["name"].isNotNull() & two["quantity"].isNotNull()) | (row == 0), whole(two)))

    at = F.when(F.col("row_idx") < SCANNED, let(F.transform("cells", _norm), lambda cells: header(F.col("row_idx"), cells)))
    top = cells.select("sheet_id", "row_idx", at.alias("at"))
    good = F.when(F.col("at.name").isNotNull() & F.col("at.quantity").isNotNull(), F.col("at"))
    heads = top.groupBy("sheet_id").agg(F.min(good).alias("h"), F.min(F.when(F.col("row_idx") == 0, F.col("at"))).alias("z"), F.count("*").alias("n_rows"))
    heads = heads.select("sheet_id", F.coalesce("h", "z").alias("h"), "n_rows")
    return heads.select("sheet_id", F.col("h.row_idx").alias("header_row"), *[F.col(f"h.{k}").alias(k) for k in ALIASES], "n_rows")


def bill_items(cells: DataFrame) -> DataFrame:
    """sheet_id, row_idx, code, name, unit, quantity, headers_matched of the rows that are work.

    Sheets of one row have none. Missing columns are the first four in turn."""
    heads = bill_headers(cells).filter("n_rows >= 2")
    every = F.col("code").isNotNull() & F.col("name").isNotNull() & F.col("unit").isNotNull() & F.col("quantity").isNotNull()
    heads = heads.select("sheet_id", "header_row", every.alias("headers_matched"), *[F.coalesce(F.col(k), F.lit(i)).alias(f"_{k}") for i, k in enumerate(ALIASES)])
    rows = cells.join(heads, "sheet_id").filter(F.col("row_idx") > F.col("header_row"))
    cell = lambda k: trim(F.coalesce(F.get("cells", F.col(f"_{k}")), F.lit("")))
    work = lambda v: ~((v["code"] == "") & (v["name"] == "")) & ~summary_row(v["code"]) & ~category_row(v["code"], v["name"]) & ~header_row(v["name"], v["code"])
    # the cells are cut once and judged as they are; rows that aren't work have none
    found = let(F.struct(*[cell(k).alias(k) for k in ALIASES]), lambda v: F.when(work(v), v))
    rows = rows.select("sheet_id", "row_idx", "headers_matched", found.alias("_v")).filter("_v is not null")
    rows = rows.select("sheet_id", "row_idx", "headers_matched", "_v.code", "_v.name", "_v.unit", X.parse_quantity(F.col("_v.quantity")).alias("quantity"))
    c, n = F.col("code"), F.col("name")
    empty = lambda col, text: F.when(col == "", text).otherwise(col)
    return rows.select("sheet_id", "row_idx", empty(c, F.concat(F.lit("Поз."), F.col("row_idx").cast("string"))).alias("code"), empty(n, F.lit("(без име)")).alias("name"), empty(F.col("unit"), F.lit("бр.")).alias("unit"), "quantity", "headers_matched")
