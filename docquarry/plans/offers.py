"""Whole offers and specifications, end to end, and their twins.

Offers are made of the given pages: a page without its tags is an offer's introduction, between
its other sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.chains import quote
from ..operators import lines as O, offers
from ..sources.tables import PAGES_A_TASK, spread, table

QUERIES, SQL = {}, {}

_LIST = '{"type":"introduction","title":"Въведение"},{"type":"smr_technology","title":"Технологии"},{"type":"communication","title":"Комуникация"}'
_TABLE = ("<table><tr><td>Технология {n}-", "</td><td>Ангажирани строителни лица, механизация</td></tr></table>")
_TEXT = "<p>Описание {n}, достатъчно дълго за блок от технология.</p>"
_PHRASE = "<p>В изпълнение на задълженията остава всичко друго.</p>"
_PLAN = "<h1>Комуникация</h1><p>План за комуникация с възложителя и с надзора.</p>"


def offer_pages(spark, d):
    """page_id, html, answer. Of every fifth page the answer is no list; every third one has a
    technology in front of its sections, too, under a name that the section has as well."""
    key = F.col("page_id").cast("string")
    block = lambda n: F.concat(F.lit(_TABLE[0].format(n=n)), key, F.lit(_TABLE[1] + _TEXT.format(n=n)))
    intro = F.concat(F.lit("<h1>Въведение</h1><p>"), F.replace(X.html_inline(F.coalesce("html", F.lit(""))), F.lit("<"), F.lit(" ")), F.lit("</p>" + _PHRASE))
    early = F.when(F.col("page_id") % 3 == 0, F.concat(block(1), block(9))).otherwise("")
    html = F.concat(early, intro, F.lit("<h1>Технологии</h1>"), block(1), block(2), F.lit(_PLAN))
    answer = F.when(F.col("page_id") % 5 == 0, "няма раздели").otherwise(F.lit(f"ето: [{_LIST}]"))
    pages = spread(table(spark, d, "pages").select("page_id", "html"), PAGES_A_TASK, ("page_id",))
    return pages.select("page_id", html.alias("html"), answer.alias("answer"))


def parse_offers(spark, d):
    pages = offer_pages(spark, d)
    out = offers.parse_sections(pages, offers.section_rows(pages, "page_id", "answer"), "page_id")
    return out.select("page_id", "section_type", "title", F.md5("plain_text").alias("plain"), "order_index")


QUERIES["parse_offers"] = parse_offers
_T = lambda n: f"({quote(_TABLE[0].format(n=n))} || page_id || {quote(_TABLE[1] + _TEXT.format(n=n))})"
_INTRO = f"'<h1>Въведение</h1><p>' || replace({X.html_inline.sql(chr(39) * 2 + ' || coalesce(html, ' + chr(39) * 2 + ')')}, '<', ' ') || '</p>'"
_EARLY = f"CASE WHEN page_id % 3 = 0 THEN {_T(1)} || {_T(9)} ELSE '' END"
_BETWEEN = "intro || " + quote(_PHRASE + "<h1>Технологии</h1>")
# a short technology gets the description of a long one behind it;
# an answer that isn't a list names one section, whose title isn't on the page: it is the whole page
SQL["parse_offers"] = f"""WITH p AS (SELECT page_id, {_INTRO} AS intro, {_EARLY} AS early, {_T(1)} AS one, {_T(2)} AS two, {_T(9)} AS nine FROM pages),
  i AS (SELECT *, {X.html_block.sql("intro || " + quote(_PHRASE))} AS whole, {X.html_block.sql("intro || '<p>'")} AS cut FROM p),
  r AS (
    SELECT page_id, 'introduction' AS section_type, 'Въведение' AS title, CASE WHEN strpos(whole, 'В изпълнение на задълженията') > 200 THEN cut ELSE whole END AS plain, 0 AS o FROM i WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, 'communication', 'Комуникация', {X.html_block.sql(quote(_PLAN))}, 1 FROM p WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, 'smr_technology', 'Технология 1-' || page_id, {X.html_block.sql("one")}, 2 FROM p WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, 'smr_technology', 'Технология 2-' || page_id, {X.html_block.sql("two")}, 3 FROM p WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, 'smr_technology', 'Технология 9-' || page_id, {X.html_block.sql("nine || " + _BETWEEN)}, 4 FROM p WHERE page_id % 5 <> 0 AND page_id % 3 = 0
    UNION ALL SELECT page_id, 'other', 'Цялото съдържание', {X.html_block.sql("early || " + _BETWEEN + " || one || two || " + quote(_PLAN))}, 0 FROM p WHERE page_id % 5 = 0
    UNION ALL SELECT page_id, 'smr_technology', 'Технология 1-' || page_id, CASE WHEN page_id % 3 = 0 AND length({X.html_block.sql("nine || " + _BETWEEN)}) >= 1200
      THEN {X.html_block.sql("one || " + quote(_TEXT.format(n=9)) + " || " + _BETWEEN)} ELSE {X.html_block.sql("one")} END, 1 FROM p WHERE page_id % 5 = 0
    UNION ALL SELECT page_id, 'smr_technology', 'Технология 9-' || page_id, {X.html_block.sql("nine || " + _BETWEEN)}, 2 FROM p WHERE page_id % 5 = 0 AND page_id % 3 = 0
    UNION ALL SELECT page_id, 'smr_technology', 'Технология 2-' || page_id, {X.html_block.sql("two || " + quote(_PLAN))}, CASE WHEN page_id % 3 = 0 THEN 3 ELSE 2 END FROM p WHERE page_id % 5 = 0)
  SELECT page_id, section_type, title, md5(plain) AS plain, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS order_index FROM r"""


def _specifications(spark, d):
    """Conversations as merged texts: a turn is a file; an assistant's has one of the two sections."""
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    head = F.when(F.col("role") != "assistant", "").when(F.col("turn") % 4 == 1, "Текущо състояние\n").otherwise("5. Проектно решение\n")
    end = F.when(F.col("role") == "assistant", "\nIV. СРОК ЗА ИЗПЪЛНЕНИЕ\nкрай").otherwise("")
    line = F.concat(F.lit("--- "), "role", F.col("turn").cast("string"), F.lit(".txt ---\n"), head, "text", end)
    return O.join_lines(c.select("conv_id", F.col("turn").alias("pos"), line.alias("line")), "conv_id", between="\n\n")


def verbatim_sections(spark, d):
    """The introduction of each specification with its two sections and where they come from."""
    docs = _specifications(spark, d)
    found = offers.verbatim_sections(docs, "conv_id")
    intro = docs.select("conv_id", F.concat(F.lit("1. Увод "), F.col("conv_id").cast("string"), F.lit("\n\n2. Обект")).alias("text"), F.create_map(F.lit(2), F.array(F.lit("a.txt"), F.lit("b.txt"))).alias("sources"))
    out = offers.final_introduction(intro, found, "conv_id")
    return out.select("conv_id", F.md5("text").alias("text")).join(found.select("conv_id", "current_state_source", "solution_source"), "conv_id")


QUERIES["verbatim_sections"] = verbatim_sections
_trim = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279))"
SQL["verbatim_sections"] = f"""WITH f AS (SELECT conv_id, turn, role || turn || '.txt' AS name, {_trim} AS body, CASE WHEN turn % 4 = 1 THEN 'state' ELSE 'solution' END AS kind FROM conversations WHERE role = 'assistant'),
  x AS (SELECT conv_id, min_by(name, turn) FILTER (kind = 'state' AND body <> '') AS cs, min_by(name, turn) FILTER (kind = 'solution' AND body <> '') AS ss,
    min_by(body, turn) FILTER (kind = 'state') AS state, min_by(body, turn) FILTER (kind = 'solution') AS solution FROM f GROUP BY conv_id)
  SELECT c.conv_id, md5('1. Увод ' || c.conv_id || chr(10) || chr(10) || '2. Обект' || chr(10) || '[извлечено от a.txt, b.txt]'
      || CASE WHEN state <> '' THEN chr(10) || chr(10) || '4. Текущо състояние' || chr(10) || chr(10) || state || chr(10) || '[извлечено от ' || cs || ']' ELSE '' END
      || CASE WHEN solution <> '' THEN chr(10) || chr(10) || '5. Проектно решение' || chr(10) || chr(10) || solution || chr(10) || '[извлечено от ' || ss || ']' ELSE '' END) AS text,
    cs AS current_state_source, ss AS solution_source
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN x USING (conv_id)"""
