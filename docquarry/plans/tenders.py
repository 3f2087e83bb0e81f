"""Queries of matching, citations, bills, HTML tables and entities, and their twins.

Inputs in the words of tenders are derived from the given tables, row by row."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import entities as E, text as X
from ..functions.chains import quote, sql_trim, trim
from ..operators import bills, citations as C, html as H, lines as O, matching as M
from ..sources.tables import spread, table
from .library import folder
from .scalars import SQL_TOKENS

QUERIES, SQL = {}, {}


def _templates(spark, d):
    p = table(spark, d, "part")
    t = p.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("title")).agg(F.min("p_partkey").alias("tpl_id"))
    return t.select("tpl_id", F.col("tpl_id").alias("ord"), "title", F.concat(F.lit("Технология: "), "title").alias("body"))


def _items(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("name")).agg(F.min("p_partkey").alias("item_id")).select("item_id", F.col("item_id").alias("ord"), "name")


_TPL = "(SELECT min(p_partkey) AS tpl_id, p_name || ' ' || p_brand AS title FROM part GROUP BY p_name || ' ' || p_brand)"
_ITEM = "(SELECT min(p_partkey) AS item_id, lower(p_type) || ' ' || p_name AS name FROM part GROUP BY lower(p_type) || ' ' || p_name)"
QUERIES["match_lexical"] = lambda s, d: M.match_lexical(_items(s, d), _templates(s, d)).select("item_id", "tpl_id", "score", "rank")
_LEX = f"""WITH i AS (SELECT item_id, {SQL_TOKENS('name')} AS w FROM {_ITEM}), t AS (SELECT tpl_id, {SQL_TOKENS('title')} AS w FROM {_TPL}),
  s AS (SELECT item_id, tpl_id, i.w AS w, t.w AS v FROM i, t),
  c AS (SELECT item_id, tpl_id, list_sum(list_transform(w, lambda x: CASE WHEN list_contains(v, x) THEN 1.0::DOUBLE WHEN length(x) >= 4 AND len(list_filter(v, lambda y: length(y) >= 4 AND left(y, 4) = left(x, 4))) > 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END)) AS h,
    len(list_distinct(list_concat(w, v))) AS u,
    len(list_filter(range(1, len(w)), lambda k: list_contains(list_transform(range(1, len(v)), lambda m: v[m] || ' ' || v[m + 1]), w[k] || ' ' || w[k + 1]))) AS b FROM s),
  r AS (SELECT item_id, tpl_id, round(h / u + 0.15 * b, 6) AS score FROM c WHERE h > 0)"""
_FILLED = """, b AS (SELECT item_id, tpl_id, score, rank() OVER (PARTITION BY item_id ORDER BY score DESC) AS rank FROM r QUALIFY rank <= 20),
  n AS (SELECT i.item_id, count(tpl_id) AS n FROM i LEFT JOIN b USING (item_id) GROUP BY i.item_id),
  f AS (SELECT n.item_id, t.tpl_id, n FROM n, t WHERE n < 20 AND NOT EXISTS (SELECT 1 FROM b WHERE b.item_id = n.item_id AND b.tpl_id = t.tpl_id)
    QUALIFY row_number() OVER (PARTITION BY n.item_id ORDER BY t.tpl_id) <= 20 - n)
  SELECT * FROM b UNION ALL SELECT item_id, tpl_id, 0.0, n + 1 FROM f"""
SQL["match_lexical"] = f"{_LEX} {_FILLED}"


def match_fill_up(spark, d):
    """Names of which many have no words, or words that few titles have; a pool of all titles."""
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, "и на за").when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.concat_ws(" ", F.lit("доставка"), F.lower("p_type")))
    return M.match_lexical(p.select(F.col("p_partkey").alias("item_id"), name.alias("name")), _templates(spark, d).filter("title like '%1%'"))


QUERIES["match_fill_up"] = match_fill_up
SQL["match_fill_up"] = f"""{_LEX.replace(_ITEM, "(SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'и на за' WHEN 1 THEN p_brand ELSE 'доставка ' || lower(p_type) END AS name FROM part)").replace(_TPL, f"(SELECT * FROM {_TPL} WHERE title LIKE '%1%')")} {_FILLED}"""
QUERIES["match_small_pool"] = lambda s, d: M.match_lexical(table(s, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.col("n_name").alias("name")), table(s, d, "region").select(F.col("r_regionkey").alias("tpl_id"), F.col("r_regionkey").alias("ord"), F.concat_ws(" ", "r_name", F.lit("CANADA AMERICA")).alias("title")))
SQL["match_small_pool"] = f"""{_LEX.replace(_ITEM, "(SELECT n_nationkey AS item_id, n_name AS name FROM nation)").replace(_TPL, "(SELECT r_regionkey AS tpl_id, r_name || ' CANADA AMERICA' AS title FROM region)")} {_FILLED}"""


def match_exact(spark, d):
    """Part names with some letters of the other alphabet."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.translate(F.upper(F.concat_ws(" ", "p_name", "p_brand")), "AEO", "АЕО").alias("name"))
    return M.match_exact(names, _templates(spark, d))


QUERIES["match_exact"] = match_exact
SQL["match_exact"] = f"SELECT p.p_partkey AS item_id, t.tpl_id FROM part p JOIN {_TPL} t ON t.title = p.p_name || ' ' || p.p_brand"
QUERIES["match_all_items"] = lambda s, d: M.match_all(table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("ord"), F.concat_ws(" ", F.lower("p_type"), "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("name")), _templates(s, d), threshold=60).select("item_id", "matched_title", F.round("confidence", 4).alias("confidence"), "text")

_NAMED = "(SELECT p_partkey, lower(p_type) || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END AS name FROM part)"
_LEX_ALL = _LEX.replace(_ITEM, f"(SELECT min(p_partkey) AS item_id, name FROM {_NAMED} GROUP BY name)")
SQL["match_all_items"] = f"""{_LEX_ALL}, best AS (SELECT item_id, tpl_id, least(100.0, score * 100) AS confidence FROM r WHERE true QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tpl_id) = 1),
  named AS (SELECT min(p_partkey) AS item_id, name FROM {_NAMED} GROUP BY name),
  full_ AS (SELECT name, title, confidence FROM best JOIN named USING (item_id) JOIN {_TPL} t USING (tpl_id) WHERE confidence >= 60)
  SELECT p_partkey AS item_id, title AS matched_title, round(coalesce(confidence, 0.0)::DOUBLE, 4) AS confidence, coalesce('Технология: ' || title, '[не е намерен]') AS text FROM {_NAMED} n LEFT JOIN full_ ON full_.name = n.name"""


def match_resolve(spark, d):
    """Each item with the best title, as an answer in free text."""
    best = M.best_score_judge(M.match_lexical(_items(spark, d), _templates(spark, d)).join(_templates(spark, d).select("tpl_id", "ord", "title"), "tpl_id"))
    said = best.select("item_id", E.llm_object(F.concat(F.lit('Ето: {"matchedTitle":"'), "title", F.lit('","confidence":'), (F.col("confidence") * 3).cast("string"), F.lit("} край"))).alias("a"))
    return M.resolve(_items(spark, d), said.select("item_id", F.col("a.matchedTitle").alias("title"), F.col("a.confidence").alias("confidence")), _templates(spark, d)).select("item_id", "tpl_id", F.round("confidence", 4).alias("confidence"))


QUERIES["match_resolve"] = match_resolve
SQL["match_resolve"] = f"""{_LEX} SELECT item_id, tpl_id, round(least(100.0, least(100.0, score * 100) * 3), 4) AS confidence FROM r WHERE true QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, tpl_id) = 1 AND least(100.0, score * 100) * 3 >= 75"""

_PAIRS = [("Технологично фрезоване с дебелини", "Отстраняване (фрезоване)", True), ("Разваляне на пътна основа", "Асфалтобетонова настилка", True), ("Ограда N2W3", "Ограда N2 W5", True), ("Ограда n2 w3", "Ограда N2W3", False), ("Линейни отводнители", "Дъждоприемна шахта", True), ("Ел. шахта", "Ревизионна шахта", True), ("Ел. шахта", "Ревизионна ел. шахта", False), ("Изкореняване на дървета", "Разчистване на площ", True), ("Втори битумен разлив", "Първи битумен разлив", True), ("Изкоп", "Изкоп", False)]


def match_vetoes(spark, d):
    pick = lambda n: F.element_at(F.array(*[F.lit(p[n]) for p in _PAIRS]), (F.col("p_partkey") % len(_PAIRS)).cast("int") + 1)
    return table(spark, d, "part").select("p_partkey", M.vetoed(F.concat_ws(" ", pick(0), "p_name"), F.concat_ws(" ", pick(1), "p_name")).alias("veto"))


QUERIES["match_vetoes"] = match_vetoes
SQL["match_vetoes"] = f"SELECT p_partkey, [{', '.join(str(p[2]).lower() for p in _PAIRS)}][p_partkey % {len(_PAIRS)} + 1] AS veto FROM part"


def cited_texts(spark, d):
    """A text of citations for each order: a standard twice, a regulation, a stray number."""
    key = F.col("o_orderkey").cast("string")
    return spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", F.concat(F.lit("<p>Съгласно БДС EN "), key, F.lit("-1:2012 – Изпитвания за геометрични характеристики , както и EN "), key, F.lit("-1, ISO 9001 и xEN 13.</p> НАРЕДБА №"), key, F.lit(" от "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" г. за съставяне на актове")).alias("text"))


QUERIES["extract_references"] = lambda s, d: C.extract_references(cited_texts(s, d), "o_orderkey").select("o_orderkey", "normalized", "ref_type", "search_term", "extracted_title", "inline_description")
_day = "strftime(o_orderdate, '%d.%m.%Y')"
_REFS = f"""(SELECT o_orderkey, 'БДС EN ' || o_orderkey || '-1' AS normalized, 'standard' AS ref_type, o_orderkey || '-1' AS search_term, 'Изпитвания за геометрични характеристики' AS extracted_title, NULL AS inline_description FROM orders
  UNION ALL SELECT o_orderkey, 'ISO 9001', 'standard', '9001', NULL, NULL FROM orders
  UNION ALL SELECT o_orderkey, 'Наредба № ' || o_orderkey || ' от ' || {_day} || ' г.', 'regulation', 'НАРЕДБА №' || o_orderkey || ' от ' || {_day} || ' г.', NULL, 'съставяне на актове' FROM orders)"""
SQL["extract_references"] = f"SELECT * FROM {_REFS}"
for _n, _c in (("citation_title_after", "extracted_title"), ("citation_inline", "inline_description")):
    QUERIES[_n] = lambda s, d, c=_c: C.extract_references(cited_texts(s, d), "o_orderkey").filter(F.col(c).isNotNull()).select("o_orderkey", "normalized", c)
    SQL[_n] = f"SELECT o_orderkey, normalized, {_c} FROM {_REFS} WHERE {_c} IS NOT NULL"
QUERIES["citation_title_before"] = lambda s, d: C.extract_references(table(s, d, "part").select("p_partkey", F.concat(F.lit("увод; Определяне на вида "), "p_name", F.lit(" – БДС 1"), F.col("p_partkey").cast("string"), F.lit("-2020 и")).alias("text")), "p_partkey").select("p_partkey", "normalized", "extracted_title")
SQL["citation_title_before"] = "SELECT p_partkey, 'БДС 1' || p_partkey AS normalized, 'Определяне на вида ' || p_name AS extracted_title FROM part"
QUERIES["distinct_references"] = lambda s, d: C.distinct_references(C.extract_references(cited_texts(s, d), "o_orderkey"), ["o_orderkey", "pattern", "pos"]).select("normalized", "o_orderkey", "ref_type")
SQL["distinct_references"] = f"SELECT normalized, min(o_orderkey) AS o_orderkey, ref_type FROM {_REFS} GROUP BY ALL"


def registry(spark, d):
    """Cards of numbers: each part has one, replaced ones have a successor and a draft too."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_name"))
    key = F.col("p_partkey").cast("string")
    code = F.element_at(F.array(*map(F.lit, ["60.60", "90.92", "95.99", "90.20"])), (F.col("p_partkey") % 4).cast("int") + 1)
    card = lambda n, title, code_: F.struct((F.col("p_partkey") * 4 + n).alias("ord"), title.alias("title"), code_.alias("status_code"))
    base = F.concat(F.lit("БДС EN 1"), key, F.lit("-1"))
    cards = F.array(card(0, base, code), card(1, F.concat(base, F.lit(":2024 "), "p_name"), F.lit("60.60")), card(2, F.concat(F.lit("prБДС EN 1"), key, F.lit("-1")), F.lit("40.60")), card(3, F.concat(base, F.lit("/NA:2020")), F.lit("60.60")))
    return p.select(F.inline(F.filter(cards, lambda c: (F.col("p_partkey") % 4 == 1) | c["title"].endswith("-1") & ~c["title"].startswith("pr"))))


def _terms(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("1"), F.col("p_partkey").cast("string"), F.lit("-1")).alias("search_term"))


QUERIES["registry_match"] = lambda s, d: C.registry_match(_terms(s, d), registry(s, d)).select("search_term", "title", "status")
SQL["registry_match"] = "SELECT '1' || p_partkey || '-1' AS search_term, 'БДС EN 1' || p_partkey || '-1' AS title, ['valid', 'replaced', 'withdrawn', 'under_review'][p_partkey % 4 + 1] AS status FROM part"
QUERIES["registry_successor"] = lambda s, d: C.registry_successor(C.registry_match(_terms(s, d), registry(s, d)), registry(s, d)).filter("status = 'replaced'").select("search_term", "replaced_by", "draft_version")
SQL["registry_successor"] = "SELECT '1' || p_partkey || '-1' AS search_term, 'БДС EN 1' || p_partkey || '-1:2024 ' || p_name AS replaced_by, 'prБДС EN 1' || p_partkey || '-1' AS draft_version FROM part WHERE p_partkey % 4 = 1"


def lettered(spark, d):
    """Terms with letters; cards of two editions, and of a number that the term is a part of."""
    key = F.col("p_partkey").cast("string")
    p = spread(table(spark, d, "part").select("p_partkey"))
    terms = p.select(F.concat(F.lit("EN 1"), key, F.lit("+A1")).alias("search_term"))
    editions = F.array(*[F.concat(F.lit(x), key, F.lit(y)) for x, y in (("БДС EN 1", "+A1:2012 кран"), ("БДС EN 1", "+A1:2015"), ("БДС 7-EN 1", "+A1"), ("EN 1", "+A12"), ("EN 1", "+B"))])
    cards = p.select(F.posexplode(editions).alias("n", "title"), "p_partkey").select((F.col("p_partkey") * 8 + F.col("n")).alias("ord"), "title", F.when(F.col("n") == 0, "90.92").otherwise("60.60").alias("status_code"))
    return terms, cards


QUERIES["registry_match_lettered"] = lambda s, d: C.registry_match(*lettered(s, d)).select("search_term", "title", "status")
SQL["registry_match_lettered"] = "SELECT 'EN 1' || p_partkey || '+A1' AS search_term, 'БДС EN 1' || p_partkey || '+A1:2012 кран' AS title, 'replaced' AS status FROM part"
QUERIES["registry_successor_lettered"] = lambda s, d: C.registry_successor(C.registry_match(*lettered(s, d)), lettered(s, d)[1]).select("search_term", "replaced_by", "draft_version")
SQL["registry_successor_lettered"] = "SELECT 'EN 1' || p_partkey || '+A1' AS search_term, 'БДС EN 1' || p_partkey || '+A1:2015' AS replaced_by, NULL::VARCHAR AS draft_version FROM part"


def regulations(spark, d):
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))
    month = F.upper(X.month_name(F.date_format("o_orderdate", "MM")))
    title = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "ИЗМЕНЕНИЕ НА ").otherwise(""), F.lit("НАРЕДБА № "), F.col("o_orderkey").cast("string"), F.lit(" ОТ "), F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), month, F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" Г. ЗА РЕДА"))
    return o.select(F.col("o_orderkey").alias("ord"), title.alias("title"), F.concat(F.lit("/view/"), F.col("o_orderkey").cast("string")).alias("url"))


QUERIES["regulation_match"] = lambda s, d: C.regulation_match(C.extract_references(cited_texts(s, d), "o_orderkey").filter("ref_type = 'regulation'"), regulations(s, d)).select("normalized", "url")
SQL["regulation_match"] = f"SELECT 'Наредба № ' || o_orderkey || ' от ' || {_day} || ' г.' AS normalized, '/view/' || o_orderkey AS url FROM orders WHERE o_orderkey % 5 <> 0"


def named_regulations(spark, d):
    """Citations by ids with letters, and the listing's titles; every fifth is of another year."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "dd.MM.yyyy")
    refs = o.select(F.concat(F.lit("Наредба № РД-02-20-"), key, F.lit(" от "), day, F.lit(" г.")).alias("normalized"))
    year = F.when(F.col("o_orderkey") % 5 == 0, F.lit(1901)).otherwise(F.year("o_orderdate")).cast("string")
    title = F.concat(F.lit("Наредба № рд-02-20-"), key, F.lit(", "), X.month_name(F.date_format("o_orderdate", "MM")), F.lit(" "), year, F.lit(" г. за реда"))
    return refs, o.select(F.col("o_orderkey").alias("ord"), title.alias("title"), F.concat(F.lit("/view/"), key).alias("url"))


def regulation_match_named(spark, d):
    hits = C.regulation_match(*named_regulations(spark, d))
    return hits.select("normalized", "url")


QUERIES["regulation_match_named"] = regulation_match_named
SQL["regulation_match_named"] = f"""SELECT 'Наредба № РД-02-20-' || a.o_orderkey || ' от ' || strftime(a.o_orderdate, '%d.%m.%Y') || ' г.' AS normalized, '/view/' || min(b.o_orderkey) AS url
  FROM orders a JOIN orders b ON starts_with(CAST(b.o_orderkey AS VARCHAR), CAST(a.o_orderkey AS VARCHAR)) AND b.o_orderkey % 5 <> 0 AND year(a.o_orderdate) = year(b.o_orderdate) AND month(a.o_orderdate) = month(b.o_orderdate) GROUP BY a.o_orderkey, a.o_orderdate"""


def regulation_status(spark, d):
    page = F.concat(F.lit("<p>Обн. ДВ. бр. "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", ", отм.  ДВ. бр. 2").otherwise(", изм. ДВ."), F.lit("</p>"))
    return table(spark, d, "orders").select("o_orderkey", C.publication_status(page).alias("status"))


QUERIES["regulation_status"] = regulation_status
SQL["regulation_status"] = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'withdrawn' ELSE 'valid' END AS status FROM orders"
QUERIES["status_lookup"] = lambda s, d: table(s, d, "part").select("p_partkey", C.stage_status(F.concat(((F.col("p_size") % 10) * 10).cast("string"), F.lit(".60"))).alias("status"))
SQL["status_lookup"] = "SELECT p_partkey, CASE p_size % 10 WHEN 4 THEN 'valid' WHEN 6 THEN 'valid' WHEN 9 THEN 'under_review' ELSE 'unknown' END AS status FROM part"


def validate(spark, d):
    out = folder(spark)  # texts are searched once, their references looked up several times
    C.distinct_references(C.extract_references(cited_texts(spark, d), "o_orderkey"), ["o_orderkey", "pattern", "pos"]).write.parquet(f"{out}/refs")
    refs = spark.read.parquet(f"{out}/refs")
    cache = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("БДС EN "), F.col("o_orderkey").cast("string"), F.lit("-1")).alias("reference_key"), F.lit("valid").alias("status"), F.lit("2024-01-30 12:00:00").cast("timestamp").alias("checked_at"))
    return C.validate(refs, cache, registry(spark, d), regulations(spark, d), F.lit("2024-01-31 00:00:00")).groupBy("ref_type", "status", "cached").agg(F.count("*").alias("n"))


QUERIES["validate_references"] = validate
SQL["validate_references"] = f"""SELECT ref_type, status, cached, count(*) AS n FROM (
  SELECT 'standard' AS ref_type, CASE WHEN o_orderkey % 3 = 0 THEN 'valid' ELSE coalesce(status, 'unknown') END AS status, o_orderkey % 3 = 0 AS cached FROM orders LEFT JOIN ({SQL["registry_match"]}) m ON m.search_term = o_orderkey || '-1'
  UNION ALL SELECT 'standard', 'unknown', false UNION ALL SELECT 'regulation', CASE WHEN o_orderkey % 5 <> 0 THEN 'valid' ELSE 'unknown' END, false FROM orders) GROUP BY ALL"""


def status_sort(spark, d):
    """Results by how urgent their status is, then by reference as Bulgarian sorts it: place."""
    letters = F.element_at(F.array(*map(F.lit, ["а", "Б", "б", "Я", "БДС ", "бдс ", "Наредба "])), (F.col("o_orderkey") % 7).cast("int") + 1)
    reference = F.concat(letters, (F.col("o_orderkey") % 1000).cast("string"))
    o = table(spark, d, "orders").select("o_orderkey", reference.alias("reference"), F.element_at(F.array(*map(F.lit, ["valid", "withdrawn", "replaced", "under_review", "unknown"])), (F.col("o_orderkey") % 5).cast("int") + 1).alias("status"))
    return C.by_urgency(o, "status", "reference").select("o_orderkey", "reference", "status", "urgency", "place")


QUERIES["status_sort"] = status_sort
SQL["status_sort"] = """WITH o AS (SELECT o_orderkey, ['а', 'Б', 'б', 'Я', 'БДС ', 'бдс ', 'Наредба '][o_orderkey % 7 + 1] || o_orderkey % 1000 AS reference, ['valid', 'withdrawn', 'replaced', 'under_review', 'unknown'][o_orderkey % 5 + 1] AS status, CAST([5, 1, 2, 3, 4][o_orderkey % 5 + 1] AS BIGINT) AS urgency FROM orders)
  SELECT *, rank() OVER (PARTITION BY urgency ORDER BY reference COLLATE bg) AS place FROM o"""


def raw_cells(spark, d):
    """A sheet for each order: a title, a header, its lines, headings and totals between them."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string").alias("q"))
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q"))
    a = lambda *x: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    k, part = F.col("l_partkey") % 6, F.col("l_partkey").cast("string")
    cells = F.when(k == 0, a("І.", "Земни работи", "", "")).when(k == 1, a("ДДС", "20%", "", "")).when(k == 2, a("", F.concat(F.lit("Насип "), part), "", F.concat("q", F.lit(",5")))).when(k == 3, a("№", "Наименование", "м.е.", "кол")).otherwise(a(F.concat(F.lit("п"), part), F.concat(F.lit("Изкоп "), part), "м3", F.col("q")))
    body = li.select(F.col("l_orderkey").alias("sheet_id"), (n + 1).alias("row_idx"), cells.alias("cells"))
    heads = li.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("sheet_id"), F.inline(F.array(F.struct(F.lit(0).alias("row_idx"), a("Обект: ул. Първа", "", "", "").alias("cells")), F.struct(F.lit(1).alias("row_idx"), a("№", "Наименование", "М.е.", "Количество").alias("cells")))))
    return heads.unionByName(body)


_CELLS = """(SELECT l_orderkey AS sheet_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) AS VARCHAR)) + 1 AS row_idx, l_partkey AS p, l_partkey % 6 AS k, CAST(l_quantity AS INT) AS q FROM lineitem)"""
QUERIES["bill_items"] = lambda s, d: bills.bill_items(raw_cells(s, d))
SQL["bill_items"] = f"""SELECT sheet_id, row_idx, CASE WHEN k = 2 THEN 'Поз.' || row_idx ELSE 'п' || p END AS code, CASE WHEN k = 2 THEN 'Насип ' || p ELSE 'Изкоп ' || p END AS name,
  CASE WHEN k = 2 THEN 'бр.' ELSE 'м3' END AS unit, CASE WHEN k = 2 THEN q + 0.5::DOUBLE ELSE q::DOUBLE END AS quantity, true AS headers_matched FROM {_CELLS} WHERE k IN (2, 4, 5)"""
QUERIES["bill_header_row"] = lambda s, d: bills.bill_headers(raw_cells(s, d)).select("sheet_id", "header_row")
SQL["bill_header_row"] = "SELECT DISTINCT l_orderkey AS sheet_id, 1 AS header_row FROM lineitem"
QUERIES["bill_columns"] = lambda s, d: bills.bill_headers(raw_cells(s, d)).select("sheet_id", "code", "name", "unit", "quantity")
SQL["bill_columns"] = "SELECT DISTINCT l_orderkey AS sheet_id, 0 AS code, 1 AS name, 2 AS unit, 3 AS quantity FROM lineitem"
_c = lambda i: F.get("cells", F.lit(i))
QUERIES["bill_category_rows"] = lambda s, d: raw_cells(s, d).filter(bills.category_row(_c(0), _c(1)) & (F.col("row_idx") > 1)).select("sheet_id", "row_idx")
SQL["bill_category_rows"] = f"SELECT sheet_id, row_idx FROM {_CELLS} WHERE k = 0"
QUERIES["bill_rows_clean"] = lambda s, d: raw_cells(s, d).filter(~bills.summary_row(_c(0)) & (F.col("row_idx") > 1)).select("sheet_id", "row_idx")
SQL["bill_rows_clean"] = f"SELECT sheet_id, row_idx FROM {_CELLS} WHERE k <> 1"
QUERIES["bill_repeated_headers"] = lambda s, d: raw_cells(s, d).filter(bills.header_row(_c(1), _c(0)) & (F.col("row_idx") > 1)).select("sheet_id", "row_idx")
SQL["bill_repeated_headers"] = f"SELECT sheet_id, row_idx FROM {_CELLS} WHERE k = 3"


def table_pages(spark, d):
    """Pages with two title tables, a nested table and a stray end before their text."""
    key = F.col("page_id").cast("string")
    cell = lambda n: F.concat(F.lit("<table><tr><td><strong>Раздел "), key, F.lit(f"/{n}</strong></td></tr></table>"))
    inner = F.concat(F.lit("<table><tr><td>данни<table><tr><td>вътре</td></tr></table></td></tr></table>"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("</table>"), cell(1), inner, F.lit("<p>Описание на раздела, достатъчно дълго.</p>"), cell(2), F.lit("<p>Втори текст на раздела: "), key, F.lit("</p>")).alias("html"))


QUERIES["toplevel_tables"] = lambda s, d: H.toplevel_tables(table_pages(s, d), "page_id").select("page_id", "ord", "table")
_T = lambda n: f"'<table><tr><td><strong>Раздел ' || page_id || '/{n}</strong></td></tr></table>'"
_INNER = "'<table><tr><td>данни<table><tr><td>вътре</td></tr></table></td></tr></table>'"
SQL["toplevel_tables"] = f"""SELECT page_id, 1 AS ord, {_T(1)} AS "table" FROM pages UNION ALL SELECT page_id, 2, {_INNER} FROM pages UNION ALL SELECT page_id, 3, {_T(2)} FROM pages"""
QUERIES["title_tables"] = lambda s, d: H.toplevel_tables(table_pages(s, d), "page_id").filter(H.title_table(F.col("table"))).select("page_id", X.html_template(H.first_cell(F.col("table"))).alias("title"))
SQL["title_tables"] = "SELECT page_id, 'Раздел ' || page_id || '/' || n AS title FROM pages, (SELECT unnest([1, 2]) AS n)"
QUERIES["template_blocks"] = lambda s, d: H.template_blocks(table_pages(s, d), "page_id").select("page_id", "title", "body")
SQL["template_blocks"] = """SELECT page_id, 'Раздел ' || page_id || '/1' AS title, 'данни вътре Описание на раздела, достатъчно дълго.' AS body FROM pages UNION ALL SELECT page_id, 'Раздел ' || page_id || '/2', 'Втори текст на раздела: ' || page_id FROM pages"""
QUERIES["table_diagnostics"] = lambda s, d: H.toplevel_tables(table_pages(s, d), "page_id").agg(F.count("*").alias("tables"), F.count_if(H.title_table(F.col("table"))).alias("titles"), F.count_if(H.resource_table(F.col("table"))).alias("resources"))
SQL["table_diagnostics"] = "SELECT count(*) * 3 AS tables, count(*) * 2 AS titles, 0 AS resources FROM pages"
QUERIES["html_table_grid"] = lambda s, d: H.table_grid(table(s, d, "pages").select("page_id", F.concat(F.lit('<table><tr><td colspan="2">Заглавие '), F.col("page_id").cast("string"), F.lit("</td><td>x</td></tr><tr><td>a</td></tr></table>")).alias("table")), "page_id").select("page_id", "row", F.array_join("cells", "|").alias("cells"))
SQL["html_table_grid"] = "SELECT page_id, 0 AS row, 'Заглавие ' || page_id || '||x' AS cells FROM pages UNION ALL SELECT page_id, 1, 'a||' FROM pages"


def resource_pages(spark, d):
    """Pages with three resource tables, the first two without text of their own, and a price table."""
    key = F.col("page_id").cast("string")
    res = lambda n: F.concat(F.lit(f"<table><tr><td>Технология {n} на "), key, F.lit("</td></tr><tr><td>Aнгажирани</td></tr><tr><td>Механизaция</td></tr></table>"))
    text = F.concat(F.lit("<p>"), F.repeat(F.lit("Изпълнението се извършва на пластове. "), 80), key, F.lit("</p>"))
    return table(spark, d, "pages").select("page_id", F.concat(res(1), res(2), res(3), text, F.lit("<table><tr><td>ед. цена</td><td>обща стойност</td></tr></table>край")).alias("html"))


QUERIES["technology_blocks"] = lambda s, d: H.technology_blocks(resource_pages(s, d), "page_id").select("page_id", "ord", "title", F.length("plain").alias("n"))
_RES = "'<table><tr><td>Технология ' || k || ' на ' || page_id || '</td></tr><tr><td>Aнгажирани</td></tr><tr><td>Механизaция</td></tr></table>'"
_RES_TEXT = "CASE WHEN k = 3 THEN '<p>' || repeat('Изпълнението се извършва на пластове. ', 80) || page_id || '</p>' ELSE '' END"
SQL["technology_blocks"] = f"SELECT page_id, k AS ord, 'Технология ' || k || ' на ' || page_id AS title, length({X.html_block.sql('raw')}) AS n FROM (SELECT page_id, k, {_RES} || {_RES_TEXT} AS raw FROM pages, (SELECT unnest([1, 2, 3]) AS k))"
QUERIES["resource_tables"] = lambda s, d: H.toplevel_tables(resource_pages(s, d), "page_id").filter(H.resource_table(F.col("table"))).select("page_id", "ord")
SQL["resource_tables"] = "SELECT page_id, n AS ord FROM pages, (SELECT unnest([1, 2, 3]) AS n)"
QUERIES["donor_fill"] = lambda s, d: H.donor_fill(H.technology_blocks(resource_pages(s, d), "page_id"), "page_id").select("page_id", "ord", (F.length("plain") > 1500).alias("filled"))
SQL["donor_fill"] = "SELECT page_id, n AS ord, true AS filled FROM pages, (SELECT unnest([1, 2, 3]) AS n)"
QUERIES["cut_trailing"] = lambda s, d: resource_pages(s, d).select("page_id", F.length(H.cut_trailing(F.col("html"))).alias("n"), F.length("html").alias("whole"))
SQL["cut_trailing"] = """SELECT page_id, length(h) AS n, length(h || '<table><tr><td>ед. цена</td><td>обща стойност</td></tr></table>край') AS whole FROM (SELECT page_id,
  '<table><tr><td>Технология 1 на ' || page_id || '</td></tr><tr><td>Ангажирани</td></tr><tr><td>Механизация</td></tr></table><table><tr><td>Технология 2 на ' || page_id || '</td></tr><tr><td>Ангажирани</td></tr><tr><td>Механизация</td></tr></table><table><tr><td>Технология 3 на ' || page_id || '</td></tr><tr><td>Ангажирани</td></tr><tr><td>Механизация</td></tr></table><p>'
  || repeat('Изпълнението се извършва на пластове. ', 80) || page_id || '</p>' AS h FROM pages)"""

QUERIES["html_paragraphs"] = lambda s, d: H.paragraphs(table(s, d, "pages"), "page_id").select("page_id", "pos", "raw")
SQL["html_paragraphs"] = r"SELECT page_id, unnest(p) AS raw, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>.*?</p>') AS p FROM pages)"


def role_pages(spark, d):
    """Pages with the heading of a role, a longer bold line, and a role without bold before their own text."""
    key = F.col("page_id").cast("string")
    more = F.concat(F.lit("<p><b>Отговорник "), key, F.lit("</b></p><p><b>1. Етап "), key, F.lit("</b></p><p>инженер "), key, F.lit("</p><p><strong>"), F.repeat(F.lit("дълъг "), 20), F.lit("</strong></p>"))
    return table(spark, d, "pages").select("page_id", F.concat(more, F.coalesce("html", F.lit(""))).alias("html"))


QUERIES["bold_headings"] = lambda s, d: H.paragraphs(role_pages(s, d), "page_id").filter(H.position_heading(F.col("raw"), trim(F.col("text")))).select("page_id", "pos")
_ROLE_P = SQL["html_paragraphs"].replace("(html,", "('<p><b>Отговорник ' || page_id || '</b></p><p><b>1. Етап ' || page_id || '</b></p><p>инженер ' || page_id || '</p><p><strong>' || repeat('дълъг ', 20) || '</strong></p>' || coalesce(html, ''),")
SQL["bold_headings"] = rf"""SELECT page_id, pos FROM (SELECT page_id, pos, raw, {sql_trim(X.html_paragraphs.sql('raw'))} AS t FROM ({_ROLE_P})) WHERE length(t) BETWEEN 3 AND 80 AND NOT regexp_matches(t, '(?i)^[0-9]+\.\s*(Етап|Основни|Задължения|Отговорности)')
  AND NOT regexp_matches(t, '^[✅🔹]') AND NOT regexp_matches(t, '(?i)^(Ключови експерти|Основна цел)') AND regexp_matches(t, '[А-Яа-яЁё]') AND NOT regexp_matches(t, '[.;:!?]$') AND (regexp_matches(raw, '(?i)<strong>|<b>') OR regexp_matches(t, '(?i)ръководител|специалист|експерт|лице\s+по|координатор|инженер|геодез'))"""
QUERIES["heading_blocks"] = lambda s, d: O.heading_blocks(H.paragraphs(table(s, d, "pages"), "page_id"), "page_id", F.col("raw").rlike(r"(?i)<strong>|<b>")).select("page_id", "ord", "title", "body")
_para = X.html_paragraphs.sql("raw")
SQL["heading_blocks"] = f"""WITH p AS (SELECT page_id, pos, {_para} AS text, CASE WHEN regexp_matches(raw, '(?i)<strong>|<b>') THEN 1 ELSE 0 END AS h FROM ({SQL['html_paragraphs']})),
  g AS (SELECT *, sum(h) OVER (PARTITION BY page_id ORDER BY pos) AS ord FROM p)
  SELECT page_id, CAST(ord AS BIGINT) AS ord, max(text) FILTER (h = 1) AS title, {sql_trim("string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (h = 0 AND text <> '')")} AS body FROM g WHERE ord > 0 GROUP BY page_id, ord HAVING length({sql_trim("string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (h = 0 AND text <> '')")}) >= 21"""
QUERIES["extract_links"] = lambda s, d: H.links(table(s, d, "pages"), "page_id").select("page_id", "ord", "url", "title")
SQL["extract_links"] = rf"""SELECT page_id, unnest(u) AS url, generate_subscripts(u, 1) - 1 AS ord, {sql_trim('unnest(t)')} AS title FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"[^>]*>\s*([^<]+)', 1) AS u, regexp_extract_all(html, 'href="([^"]*)"[^>]*>\s*([^<]+)', 2) AS t FROM pages)"""
QUERIES["page_title"] = lambda s, d: table(s, d, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))
SQL["page_title"] = f"SELECT page_id, {sql_trim('nullif(regexp_extract(html, ' + quote('(?i)<title>([^<]+)</title>') + ', 1), ' + quote('') + ')')} AS title FROM pages"
QUERIES["registry_cards"] = lambda s, d: H.registry_cards(table(s, d, "part").select("p_partkey", F.concat(F.lit('<h4 class="x">БДС <b>EN</b> '), F.col("p_partkey").cast("string"), F.lit('</h4><p>'), "p_name", F.lit('</p><span class="label ok">60.60</span>')).alias("html")), "p_partkey")
SQL["registry_cards"] = "SELECT p_partkey, 0 AS ord, 'БДС EN ' || p_partkey AS title, '60.60' AS status_code FROM part"


def asset_dedup(spark, d):
    """Part names as images: one row for each content."""
    return table(spark, d, "part").select(H.image_key(F.col("p_name").cast("binary"), F.lit("jpeg")).alias("key")).distinct()


QUERIES["asset_dedup"] = asset_dedup
SQL["asset_dedup"] = "SELECT DISTINCT left(sha1(p_name), 16) || '.jpg' AS key FROM part"
QUERIES["image_filter"] = lambda s, d: table(s, d, "part").select("p_partkey", H.usable_image(F.unhex(F.concat(F.when(F.col("p_partkey") % 3 == 0, "00000000").otherwise("89504E47"), F.lit("0D0A1A0A0000000D49484452"), F.lpad(F.hex("p_size"), 8, "0"), F.lpad(F.hex(F.col("p_size") * 8), 8, "0"), F.repeat(F.lit("00"), 600))), F.lit("image/png")).alias("usable"))
SQL["image_filter"] = "SELECT p_partkey, p_partkey % 3 <> 0 AND NOT (p_size <= 20 AND p_size * 8 <= 20) AS usable FROM part"


def resolve_placeholders(spark, d):
    pages = table(spark, d, "part").select("p_partkey", F.concat(F.lit('<img src="OFFER_IMG:k'), F.col("p_size").cast("string"), F.lit('.png"> текст')).alias("html"))
    assets = table(spark, d, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("k"), F.col("p_size").cast("string"), F.lit(".png")).alias("key"))
    return H.resolve_placeholders(pages, assets, "p_partkey")


QUERIES["resolve_placeholders"] = resolve_placeholders
SQL["resolve_placeholders"] = """SELECT p_partkey, '<img src="' || CASE WHEN p_size % 2 = 0 THEN '/api/admin/offer-images/' ELSE 'OFFER_IMG:' END || 'k' || p_size || '.png"> текст' AS html FROM part"""
QUERIES["extract_data_uris"] = lambda s, d: H.extract_data_uris(table(s, d, "part").select("p_partkey", F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(F.col("p_name").cast("binary")), F.lit('">')).alias("html")), "p_partkey")[1].select("p_partkey", "ord", "mime", F.col("data").cast("string").alias("data"))
SQL["extract_data_uris"] = "SELECT p_partkey, 0 AS ord, 'image/png' AS mime, p_name AS data FROM part"
QUERIES["merge_icon_paragraphs"] = lambda s, d: H.merge_icons(table(s, d, "part").select("p_partkey", F.posexplode(F.array(F.lit("<p><img a></p>"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>")), F.lit("<p>край</p>"))).alias("pos", "raw")).withColumn("text", X.html_paragraphs(F.col("raw"))), "p_partkey")
SQL["merge_icon_paragraphs"] = "SELECT p_partkey, 1 AS pos, '<p><img a></p>' AS icons, p_name AS text FROM part UNION ALL SELECT p_partkey, 2, '', 'край' FROM part"
QUERIES["append_citations"] = lambda s, d: table(s, d, "part").select("p_partkey", H.append_citations(F.concat(F.lit("увод\n\n1. Предмет "), "p_name", F.lit("\n\n2. Дейности")), F.create_map(F.lit(1), F.array(F.col("p_brand"), F.lit("b.pdf")))).alias("text"))
SQL["append_citations"] = "SELECT p_partkey, '1. Предмет ' || p_name || chr(10) || '[извлечено от ' || p_brand || ', b.pdf]' || chr(10) || chr(10) || '2. Дейности' AS text FROM part"
QUERIES["split_position_blocks"] = lambda s, d: table(s, d, "part").select("p_partkey", F.posexplode(H.split_position_blocks(F.concat("p_name", F.lit("\n──────────────\n"), "p_brand", F.lit("\n---\nкрай")))).alias("pos", "text"))
SQL["split_position_blocks"] = "SELECT p_partkey, 0 AS pos, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, 'край' FROM part"


def trim_at_phrase(spark, d):
    return table(spark, d, "documents").select("doc_id", H.trim_at_phrase(F.concat("text", F.lit("\nВ изпълнение на задълженията: край"))).alias("text"))


QUERIES["trim_at_phrase"] = trim_at_phrase
SQL["trim_at_phrase"] = f"SELECT doc_id, CASE WHEN length(text) + 1 >= 200 THEN {sql_trim('text')} ELSE text || chr(10) || 'В изпълнение на задълженията: край' END AS text FROM documents"


def split_by_titles(spark, d):
    """Conversations as one text, cut at the beginning of each turn."""
    c = table(spark, d, "conversations")
    docs = O.join_lines(c.select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("Част "), F.col("turn").cast("string"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")), "conv_id")
    return H.split_by_titles(docs, c.select("conv_id", F.col("turn").alias("ord"), F.concat(F.lit("Част "), F.col("turn").cast("string"), F.lit(":")).alias("title")), "conv_id").select("conv_id", "ord", "body")


QUERIES["split_by_titles"] = split_by_titles
_body = sql_trim("'Част ' || turn || ': ' || coalesce(text, '')")
SQL["split_by_titles"] = f"SELECT conv_id, CAST(turn AS INT) AS ord, {_body} AS body FROM conversations WHERE length({_body}) >= 50"


def report_lines(spark, d):
    c = table(spark, d, "conversations")
    t = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("introduction"), F.lit("").alias("team"), F.lit("План").alias("communication"))
    return H.report_lines(t, c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("ord"), F.lit("Позиция").alias("title"), "text"), "conv_id")


QUERIES["report_lines"] = report_lines
SQL["report_lines"] = f"""WITH t AS (SELECT conv_id, {sql_trim("max(text) FILTER (role = 'system')")} AS intro, count(*) FILTER (role = 'assistant') > 0 AS found FROM conversations GROUP BY conv_id), u AS (SELECT *, coalesce(intro, '') <> '' AS has FROM t),
  r AS (SELECT conv_id, 0 AS place, 0 AS o, 1 AS level, '1. Въведение' AS text FROM u WHERE has UNION ALL SELECT conv_id, 0, 1, 0, intro FROM u WHERE has
    UNION ALL SELECT conv_id, 1, 0, 1, CASE WHEN has THEN '2' ELSE '1' END || '. Технология на изпълнение' FROM u WHERE found
    UNION ALL SELECT conv_id, 1, turn * 2 + 1, 2, 'Позиция' FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, 1, turn * 2 + 2, 0, text FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT conv_id, 3, 0, 1, (1 + has::INT + found::INT) || '. Комуникация' FROM u UNION ALL SELECT conv_id, 3, 1, 0, 'План' FROM u)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, o) AS ord, level, text FROM r"""

# Entities, from customers and orders in the words of tenders.
_named = lambda s, d, *cols: table(s, d, "customer").select("c_custkey", *cols)
_k = lambda: F.col("c_custkey").cast("string")
QUERIES["extract_authority"] = lambda s, d: _named(s, d, E.authority(F.concat(F.lit("Увод\n"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Възложител: Община  Правец "), _k())).when(F.col("c_custkey") % 3 == 1, "община Горна Баня").otherwise("нищо"), F.lit(", адрес"))).alias("authority"))
SQL["extract_authority"] = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Община Правец ' || c_custkey WHEN 1 THEN 'Община Горна Баня' ELSE 'Възложителя' END AS authority FROM customer"
QUERIES["extract_subject"] = lambda s, d: _named(s, d, E.subject(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Предмет на поръчката: Ремонт на обект "), _k(), F.lit("\nдруго"))).otherwise("нищо")).alias("subject"))
SQL["extract_subject"] = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ремонт на обект ' || c_custkey ELSE 'строително-монтажни работи' END AS subject FROM customer"
QUERIES["extract_order_number"] = lambda s, d: _named(s, d, E.order_number(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Номер на поръчката: 00"), _k(), F.lit("-A"))).otherwise(F.concat(F.lit("референтен номер: Б "), F.lpad(_k(), 5, "0"), F.lit("-2024-0001")))).alias("number"))
SQL["extract_order_number"] = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '00' || c_custkey || '-A' ELSE lpad(c_custkey::VARCHAR, 5, '0') || '-2024-0001' END AS number FROM customer"
QUERIES["extract_main_object"] = lambda s, d: _named(s, d, E.main_object(F.concat(F.lit("Увод „Дълго име на обект“\n\n1. **Предмет на поръчката**\nРемонт на \"Сграда "), _k(), F.lit("\" и \"СУ\" за \"на\"")), F.lit("2024-05-01").cast("date")).alias("object"))
SQL["extract_main_object"] = "SELECT c_custkey, 'СУ' AS object FROM customer"
QUERIES["extract_city"] = lambda s, d: _named(s, d, E.city(F.element_at(F.array(*map(F.lit, ["гр. Правец", "град Тази, община Плевен", "с. Боян", "никъде"])), (F.col("c_custkey") % 4).cast("int") + 1)).alias("city"))
SQL["extract_city"] = "SELECT c_custkey, ['Правец', 'Плевен', 'Боян', NULL][c_custkey % 4 + 1] AS city FROM customer"
_PLACES = [("гр. Правец, ул. „Христо Ботев“", "ул. Христо Ботев, Правец, България"), ("ремонт на бул. Цар Борис и", "бул. Цар Борис, България"), ("път /II-61/ до гр. Перник", "Път II-61, Перник, България"), ("гр. Видин", "ул. Първа, Видин, България"), ("кв. Изток", "кв. Изток, България")]
QUERIES["extract_location"] = lambda s, d: _named(s, d, E.location(F.element_at(F.array(*[F.lit(p) for p, _ in _PLACES]), (F.col("c_custkey") % 5).cast("int") + 1), F.concat(F.lit("ул. „Първа“ "), _k())).alias("place"))
SQL["extract_location"] = f"SELECT c_custkey, [{', '.join(quote(p) for _, p in _PLACES)}][c_custkey % 5 + 1] AS place FROM customer"
QUERIES["extract_key_params"] = lambda s, d: _named(s, d, E.key_parameters(F.concat(F.lit("Вид на процедурата: открита за "), _k(), F.lit(" обекта.\nКритерий за възлагане е най-ниска цена. край"))).alias("params"))
SQL["extract_key_params"] = "SELECT c_custkey, '[Извлечено от Документация за участие – ключови параметри]' || chr(10) || 'Критерий за възлагане: Критерий за възлагане е най-ниска цена.' || chr(10) || chr(10) || 'Процедура: Вид на процедурата: открита за ' || c_custkey || ' обекта.' AS params FROM customer"
_ANSWERS = ['отговор {"matchedTitle":"T","confidence":130,"reasoning":"r"} край', '{"matchedTitle":"T","confidence":"80"}', "{broken", '{"matchedTitle":"NONE","confidence":74}']
QUERIES["parse_llm_object"] = lambda s, d: _named(s, d, E.llm_object(F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("c_custkey") % 4).cast("int") + 1)).alias("a")).select("c_custkey", "a.matchedTitle", "a.confidence")
SQL["parse_llm_object"] = 'SELECT c_custkey, [\'T\', \'T\', NULL, \'NONE\'][c_custkey % 4 + 1] AS "matchedTitle", [100.0, 0.0, NULL, 74.0][c_custkey % 4 + 1]::DOUBLE AS confidence FROM customer'
QUERIES["parse_llm_array"] = lambda s, d: _named(s, d, F.explode(E.llm_rows(F.concat(F.lit('ето [{"docPosition":"p'), _k(), F.lit('","confidence":5},{"docPosition":"q"}]')), "array<struct<docPosition:string,matchedTemplate:string,confidence:double>>")).alias("x")).select("c_custkey", F.col("x.docPosition").alias("position"), F.coalesce("x.matchedTemplate", F.lit("NONE")).alias("template"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"))
SQL["parse_llm_array"] = "SELECT c_custkey, 'p' || c_custkey AS position, 'NONE' AS template, 5.0::DOUBLE AS confidence FROM customer UNION ALL SELECT c_custkey, 'q', 'NONE', 0.0 FROM customer"


def parse_section_list(spark, d):
    """Sections in answers: known kinds with a title, the first technology only; some answers aren't JSON."""
    raw = F.concat(F.lit('ето: [{"type":"introduction","title":"У'), _k(), F.lit('"},{"type":"other","title":""},{"type":"smr_technology","title":"а","offset":7},{"type":"smr_technology","title":"б"},{"type":"друго","title":"в"}] край'))
    raw = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("няма раздели "), _k())).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("[ счупено "), _k(), F.lit("]"))).otherwise(raw)
    return _named(spark, d, F.inline(E.section_list(raw)))


QUERIES["parse_section_list"] = parse_section_list
SQL["parse_section_list"] = """SELECT c_custkey, 'introduction' AS type, 'У' || c_custkey AS title, 0 AS "offset" FROM customer WHERE c_custkey % 5 > 1 UNION ALL SELECT c_custkey, 'smr_technology', 'а', 7 FROM customer WHERE c_custkey % 5 > 1
  UNION ALL SELECT c_custkey, 'other', 'Цялото съдържание', 0 FROM customer WHERE c_custkey % 5 <= 1"""


def _roles(spark, d):
    """Suppliers as wanted roles and customers of some keys as templates."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    wanted = s.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("Роля "), F.col("s_suppkey").cast("string")).alias("name"), F.lit("стаж 5 г.").alias("requirements"))
    templates = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("Шаблон "), F.col("c_custkey").cast("string")).alias("title"))
    verdicts = wanted.select("ord", F.upper("name").alias("doc_position"), F.concat(F.lit("ШАБЛОН "), F.col("ord").cast("string")).alias("template"), F.lit(80.0).alias("confidence"))
    reverse = templates.filter("ord % 2 = 1").select("ord", F.upper("title").alias("title"), F.lit("роля 1").alias("doc_position"), F.lit(40.0).alias("confidence"))
    return M.match_roles(wanted, templates, verdicts, reverse)


_FWD = "SELECT s_suppkey AS ord, 0 AS source, 'Роля ' || s_suppkey AS name, 'стаж 5 г.' AS requirements, 'Шаблон ' || s_suppkey AS template, 80.0::DOUBLE AS confidence FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey IN (SELECT c_custkey FROM customer)"
_REV = "SELECT c_custkey, 1, 'Шаблон ' || c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'стаж 5 г.' ELSE '' END, 'Шаблон ' || c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 40.0 ELSE 0.0 END FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)"
QUERIES["role_results"] = _roles
SQL["role_results"] = f"{_FWD} UNION ALL {_REV}"
QUERIES["role_match_forward"] = lambda s, d: _roles(s, d).filter("source = 0")
SQL["role_match_forward"] = _FWD
QUERIES["role_match_reverse"] = lambda s, d: _roles(s, d).filter("source = 1")
SQL["role_match_reverse"] = f"SELECT * FROM ({SQL['role_results']}) WHERE source = 1"
