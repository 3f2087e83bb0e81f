"""Queries over text functions, and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.chains import WS, quote, sql_sub, sql_trim
from ..sources.tables import table

QUERIES, SQL = {}, {}


def _simple(name: str, source: str, key: str, column: str, make, sql: str) -> None:
    """A query that maps one text column of a table."""
    QUERIES[name] = lambda spark, d: table(spark, d, source).select(key, make(F.col(column)).alias("value"))
    SQL[name] = f"SELECT {key}, {sql} AS value FROM {source}"


for _name, _chain in (("html_text_inline", X.html_inline), ("html_text_template", X.html_template), ("html_text_block", X.html_block), ("html_text_para", X.html_paragraphs), ("decode_entities", X.entities)):
    _simple(_name, "pages", "page_id", "html", _chain, _chain.sql("html"))
_simple("html_text_export", "pages", "page_id", "html", X.html_export, f"CASE WHEN contains(html, '<') THEN {X._export.sql('html')} ELSE html END")
_simple("text_to_html", "documents", "doc_id", "text", X.text_to_html, r"""CASE WHEN coalesce(text, '') = '' THEN '' WHEN starts_with(text, '<') THEN text
  ELSE array_to_string(list_transform(regexp_split_to_array(text, '\n\n+'), lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), '') END""")
for _name, _chain in (("title_key_folded", X.title_key_folded), ("title_key_plain", X.title_key_plain), ("title_key_compare", X.title_key_compare), ("strip_markdown", X.markdown_plain)):
    _simple(_name, "documents", "doc_id", "text", _chain, _chain.sql("text"))
_stop = "[" + ", ".join(map(quote, X.STOP_WORDS)) + "]"
SQL_TOKENS = lambda e: f"list_filter(regexp_split_to_array({X.token_text.sql(e)}, {quote(f'[{WS}]+')}), lambda w: length(w) >= 2 AND NOT list_contains({_stop}, w))"
_simple("tokenize", "documents", "doc_id", "text", lambda c: F.array_join(X.tokens(c), " "), f"array_to_string({SQL_TOKENS('text')}, ' ')")
_simple("sanitize_filename", "documents", "doc_id", "text", lambda c: X.sanitize_filename(c, 25), f"coalesce(nullif({sql_sub('left(' + X._filename.sql('text') + ', 25)', '_$', '')}, ''), 'поръчка')")
_simple("truncate_text", "documents", "doc_id", "text", lambda c: F.left(c, F.lit(8000)), "left(text, 8000)")


def safe_path(spark, d):
    name = F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("Щука.docx"))
    return table(spark, d, "customer").select("c_custkey", X.safe_path(name, F.lit("2024-05-01").cast("date")).alias("path"))


QUERIES["safe_path"] = safe_path
SQL["safe_path"] = "SELECT c_custkey, '2024-05-01_' || regexp_replace(concat_ws(' ', c_name, c_mktsegment, 'Shtuka.docx'), '[^a-zA-Z0-9._-]', '_', 'g') AS path FROM customer"


def fix_mojibake(spark, d):
    """Names of parts with a Cyrillic word, read as Latin-1 for odd keys."""
    name = F.concat(F.lit("Тест "), "p_name")
    garbled = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    return table(spark, d, "part").select("p_partkey", X.fix_mojibake(F.when(F.col("p_partkey") % 2 == 1, garbled).otherwise(name)).alias("name"))


QUERIES["fix_mojibake"] = fix_mojibake
SQL["fix_mojibake"] = "SELECT p_partkey, 'Тест ' || p_name AS name FROM part"


def parse_quantity(spark, d):
    """Quantities as a sheet may write them: 12,5 m or 1 234.5 or n/a."""
    q = F.col("l_quantity").cast("int")
    cell = F.when(q % 4 == 0, F.concat(q, F.lit(",5 м3"))).when(q % 4 == 1, F.concat(F.lit(" 1 "), q, F.lit(".25"))).when(q % 4 == 2, F.concat(F.lit("."), q)).otherwise("няма")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.parse_quantity(cell).alias("quantity"))


QUERIES["parse_quantity"] = parse_quantity
SQL["parse_quantity"] = """SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN CAST(l_quantity AS INT) + 0.5::DOUBLE
  WHEN 1 THEN CAST('1' || CAST(l_quantity AS INT) || '.25' AS DOUBLE) WHEN 2 THEN CAST('0.' || CAST(l_quantity AS INT) AS DOUBLE) ELSE 0.0::DOUBLE END AS quantity FROM lineitem"""


def normalize_standard(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    raw = F.concat(F.lit(" БДС ЕN "), key, F.lit("-"), size, F.when(size % 3 == 0, ":2020/NA:2017").when(size % 3 == 1, "-2006").otherwise("."))
    name = X.standard_name(raw)
    return table(spark, d, "part").select("p_partkey", name.alias("name"), F.regexp_replace(name, r"^БДС\s+", "").alias("key"), X.search_term(name).alias("term"))


QUERIES["normalize_standard"] = normalize_standard
SQL["normalize_standard"] = "SELECT p_partkey, 'БДС EN ' || p_partkey || '-' || p_size AS name, 'EN ' || p_partkey || '-' || p_size AS key, p_partkey || '-' || p_size AS term FROM part"


def normalize_regulation(spark, d):
    day = F.col("o_orderdate")
    raw = F.concat(F.lit("НАРЕДБА  №"), F.col("o_orderkey"), F.lit(" ОТ "), F.date_format(day, "d.M.yyyy"), F.lit("г"))
    name = X.regulation_name(raw)
    p = X.regulation_parts(name)
    return table(spark, d, "orders").select("o_orderkey", name.alias("name"), p["id"].alias("id"), p["year"].alias("year"), p["month"].alias("month"), X.regulation_query(name, F.lit("като съставяне на актове")).alias("query"))


QUERIES["normalize_regulation"] = normalize_regulation
_months = "[" + ", ".join(map(quote, X.MONTHS)) + "]"
SQL["normalize_regulation"] = f"""SELECT o_orderkey, 'Наредба № ' || o_orderkey || ' от ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || ' г.' AS name,
  CAST(o_orderkey AS VARCHAR) AS id, CAST(year(o_orderdate) AS VARCHAR) AS year, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS month,
  'наредба ' || o_orderkey || ' ' || {_months}[month(o_orderdate)] || ' ' || year(o_orderdate) || ' съставяне актове' AS query FROM orders"""


def valid_uuid(spark, d):
    h = F.md5(F.col("c_custkey").cast("string"))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, d, "customer").select("c_custkey", X.valid_uuid(text).alias("valid"))


QUERIES["valid_uuid"] = valid_uuid
SQL["valid_uuid"] = "SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 13, 1) IN ('1','2','3','4','5') AND substr(md5(CAST(c_custkey AS VARCHAR)), 17, 1) IN ('8','9','a','b') AS valid FROM customer"

QUERIES["confidence_bucket"] = lambda spark, d: table(spark, d, "events").select("event_id", X.confidence_bucket(F.col("value")).alias("bucket"))
SQL["confidence_bucket"] = "SELECT event_id, CASE WHEN value >= 80 THEN 'high' WHEN value >= 60 THEN 'medium' ELSE 'low' END AS bucket FROM events"


def tender_summary(spark, d):
    """For each conversation, taken as a tender: which texts are there, how many results."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("intro"), F.max(F.when(F.col("role") == "user", F.col("text"))).alias("raw"), F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("results"))
    there = lambda c: F.length(F.coalesce(X.trim(F.col(c)), F.lit(""))) > 0
    return turns.select("conv_id", there("intro").alias("has_introduction"), there("raw").alias("has_raw"), F.coalesce(F.size("results"), F.lit(0)).cast("long").alias("n_results"))


QUERIES["tender_summary"] = tender_summary
SQL["tender_summary"] = f"""SELECT conv_id, coalesce(max(CASE WHEN role = 'system' THEN length({sql_trim('text')}) END), 0) > 0 AS has_introduction,
  coalesce(max(CASE WHEN role = 'user' THEN length({sql_trim('text')}) END), 0) > 0 AS has_raw, count(CASE WHEN role = 'assistant' THEN turn END) AS n_results FROM conversations GROUP BY conv_id"""


def drop_nested_field(spark, d):
    """Order lines as an array of structs, without the wide field of each."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.repeat("l_returnflag", 50).alias("html_body")))).alias("lines"))
    slim = F.transform("lines", lambda x: x.dropFields("html_body"))
    return lines.select("l_orderkey", F.to_json(slim).alias("lines"))


QUERIES["drop_nested_field"] = drop_nested_field
SQL["drop_nested_field"] = """SELECT l_orderkey, '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS lines FROM lineitem GROUP BY l_orderkey"""


def title_jaccard(spark, d):
    """Each benchmark item with the next one."""
    b = table(spark, d, "benchmark")
    pairs = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return pairs.select(F.col("a.item_id").alias("item_id"), F.round(X.title_jaccard(F.col("a.text"), F.col("b.text")), 9).alias("jaccard"), X.title_mismatch(F.col("a.text"), F.col("b.text")).alias("mismatch"), X.title_mismatch(F.array_join(F.slice(F.split("a.text", " "), 1, 3), " "), F.col("b.text")).alias("short_mismatch"))


QUERIES["title_jaccard"] = title_jaccard
_key = X.title_key_compare.sql
SQL["title_jaccard"] = f"""WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y, list_distinct(list_filter(string_split({_key('a.text')}, ' '), lambda w: length(w) >= 4)) AS s,
    list_distinct(list_filter(string_split({_key('b.text')}, ' '), lambda w: length(w) >= 4)) AS t, {_key('b.text')} AS k, array_to_string(string_split(a.text, ' ')[1:3], ' ') AS f FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
  j AS (SELECT *, CASE WHEN len(s) = 0 OR len(t) = 0 THEN 0.0 ELSE len(list_intersect(s, t))::DOUBLE / len(list_distinct(list_concat(s, t))) END AS j,
    list_filter(string_split({_key('f')}, ' '), lambda w: length(w) >= 4) AS fw, len(regexp_split_to_array({sql_trim('x')}, {quote(f'[{WS}]+')})) AS n, len(regexp_split_to_array({sql_trim('f')}, {quote(f'[{WS}]+')})) AS fn FROM p)
  SELECT item_id, round(j, 9) AS jaccard, j < 0.3 AS mismatch, CASE WHEN fn <= 5 THEN len(fw) > 0 AND len(list_filter(fw, lambda w: contains(k, w))) = 0 ELSE false END AS short_mismatch FROM j"""


def _part(of: str, *columns: str):
    """A query of some columns of another one, and its twin."""
    key = {"normalize_regulation": "o_orderkey", "normalize_standard": "p_partkey", "title_jaccard": "item_id"}[of]
    return lambda spark, d: QUERIES[of](spark, d).select(key, *columns), f"SELECT {key}, {', '.join(columns)} FROM ({SQL[of]})"


for _name, _of, _cols in (
    ("regulation_parts", "normalize_regulation", ("id", "year", "month")),
    ("regulation_query", "normalize_regulation", ("query",)),
    ("search_term", "normalize_standard", ("term",)),
    ("title_mismatch", "title_jaccard", ("mismatch", "short_mismatch")),
):
    QUERIES[_name], SQL[_name] = _part(_of, *_cols)
