"""Queries over lines of documents, and their twins.

Tender lines are derived from lineitem: a document for each order, a line for each of its
rows, in the words that bills and specifications use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import entities as E, lines as L
from ..functions.chains import WS, quote, sql_match, sql_sub, sql_trim
from ..operators import lines as O
from ..sources.tables import table

QUERIES, SQL = {}, {}

DOC_LINES = r"(SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l FROM documents))"

_PATTERN = ["КОЛИЧЕСТВЕНА СМЕТКА", "101 Изкоп {q} м3", "2. Обект {p}", "Свободен текст номер {p}, описание.", "", "- съгласно Чертеж {p}", "Сметка {p}", "III. СРОК {p}", "ключови експерти:", "1. Ръководител на проекта – стаж {q} г.", "има опит {p}, диплома"]


def tender_lines(spark, d) -> DataFrame:
    """order, pos, line; pos counts an order's rows."""
    n = len(_PATTERN)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    kind, rule = F.col("l_partkey") % n, None
    for i, p in enumerate(_PATTERN):
        text = F.replace(F.replace(F.lit(p), F.lit("{q}"), F.col("q").cast("string")), F.lit("{p}"), F.col("l_partkey").cast("string"))
        rule = F.when(kind == i, text) if rule is None else rule.when(kind == i, text)
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q")) - 1
    return li.select("l_orderkey", pos.alias("pos"), rule.alias("line"))


_case = " ".join(f"WHEN {i} THEN replace(replace({quote(p)}, '{{q}}', CAST(q AS VARCHAR)), '{{p}}', CAST(l_partkey AS VARCHAR))" for i, p in enumerate(_PATTERN))
TENDER_LINES = f"""(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q) - 1 AS pos, CASE l_partkey % {len(_PATTERN)} {_case} END AS line
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS q FROM lineitem))"""


def tender_docs(spark, d) -> DataFrame:
    return O.join_lines(tender_lines(spark, d), "l_orderkey")


TENDER_DOCS = f"(SELECT l_orderkey, string_agg(line, chr(10) ORDER BY pos) AS text FROM {TENDER_LINES} GROUP BY l_orderkey)"

QUERIES["garbage_document"] = lambda s, d: table(s, d, "documents").select("doc_id", L.garbage_document(F.col("text")).alias("garbage"), L.garbage_document(F.col("text"), "a-zA-Z", r"\x{400}-\x{4FF}").alias("garbage_latin"))
_letters = sql_sub("text", rf"[{WS}\d\p{{P}}]", "")
SQL["garbage_document"] = f"""SELECT doc_id, {L.sql_garbage_document('text')} AS garbage,
  text IS NULL OR length(text) < 80 OR length({_letters}) < 50 OR length({sql_sub(_letters, '[^a-zA-Z]', '')}) < 30 AS garbage_latin FROM documents"""


def garbage_lines(spark, d):
    return O.explode_lines(table(spark, d, "documents"), "doc_id").filter(L.garbage_line(F.col("line"))).select("doc_id", "pos", "line")


QUERIES["garbage_lines"] = garbage_lines
SQL["garbage_lines"] = f"SELECT doc_id, pos, line FROM {DOC_LINES} WHERE {L.sql_garbage_line('line')}"

QUERIES["table_lines"] = lambda s, d: tender_lines(s, d).filter(L.table_line(F.col("line")))
SQL["table_lines"] = f"SELECT l_orderkey, pos, line FROM {TENDER_LINES} WHERE {L.sql_table_line('line')}"
QUERIES["heading_lines"] = lambda s, d: tender_lines(s, d).filter(L.heading_line(F.col("line")))
SQL["heading_lines"] = f"SELECT l_orderkey, pos, line FROM {TENDER_LINES} WHERE {L.sql_any('line', L.HEADING_LINE)}"
QUERIES["role_lines"] = lambda s, d: tender_lines(s, d).filter(L.role_line(F.col("line"))).select("l_orderkey", "pos", L.role_name(F.col("line")).alias("name"), L.role_tail(F.col("line")).alias("tail"))
SQL["role_lines"] = f"""SELECT l_orderkey, pos, CASE WHEN line LIKE '1. Р%' THEN 'Ръководител на проекта' ELSE 'ключови експерти' END AS name,
  CASE WHEN line LIKE '1. Р%' THEN split_part(line, '– ', 2) END AS tail FROM {TENDER_LINES} WHERE line LIKE '1. Р%' OR line LIKE 'ключови%'"""


def heading_candidates(spark, d):
    return O.heading_candidates(table(spark, d, "documents"), "doc_id")


QUERIES["heading_candidates"] = heading_candidates
SQL["heading_candidates"] = f"""WITH l AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o, {sql_trim('line')} AS t FROM {DOC_LINES}),
  c AS (SELECT *, CASE WHEN {sql_match('t', '^[0-9]{1,2}[.]')} THEN 0 WHEN t = upper(t) AND {sql_match('t', '[А-ЯA-Z]{3}')} THEN 1 ELSE 2 END AS class FROM l WHERE length(t) >= 3 AND NOT {sql_match('t', '^[0-9]+$')}
    AND ({sql_match('t', '^([0-9]{1,2}[.]([0-9]{1,2}[.]?)?' + chr(92) + 's+|[IVXivx]+[.]' + chr(92) + 's+)')}
      OR (length(t) BETWEEN 4 AND 120 AND t = upper(t) AND {sql_match('t', '[А-ЯA-Z]')} AND NOT {sql_match('t', '^[0-9]')})
      OR (length(t) BETWEEN 5 AND 120 AND NOT contains(t, '  ') AND NOT {sql_match('t', '[.]{2,}')}
        AND NOT {sql_match('t', '^[0-9]+[,.]?[0-9]*' + chr(92) + 's*(бр|м|кв|куб|лв|кг|т|мм|см|km|m²|m³|%|дни|год|мес)?[.]?' + chr(92) + 's*$')}))),
  f AS (SELECT doc_id, t, o, class, pos FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY class, pos) = 1)
  SELECT doc_id, t AS text, CAST(o AS BIGINT) AS "offset", class, row_number() OVER (PARTITION BY doc_id ORDER BY class, pos) AS ord FROM f QUALIFY ord <= 500"""


def merged_conversations(spark, d) -> DataFrame:
    """Each conversation as a merged text: a file for each turn, under its role's name."""
    c = table(spark, d, "conversations")
    part = F.concat(F.lit("--- "), "role", F.col("turn").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    return O.join_lines(c.select("conv_id", F.col("turn").alias("pos"), part.alias("line")), "conv_id", between="\n\n")


QUERIES["merge_marked_text"] = merged_conversations
MERGED = "(SELECT conv_id, string_agg('--- ' || role || turn || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
SQL["merge_marked_text"] = f"SELECT conv_id, text FROM {MERGED}"


def split_marked_text(spark, d):
    return O.split_marked(merged_conversations(spark, d), "conv_id")


QUERIES["split_marked_text"] = split_marked_text
SQL["split_marked_text"] = f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord, role || turn AS filename, {sql_trim('coalesce(text, ' + chr(39) * 2 + ')')} AS body FROM conversations"

QUERIES["ordered_concat"] = lambda s, d: O.join_lines(table(s, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("line")), "conv_id", between="\n\n")
SQL["ordered_concat"] = "SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id"

QUERIES["erase_table_regions"] = lambda s, d: O.erase_tables(tender_docs(s, d), "l_orderkey").filter("text <> ''")
_state = f"""SELECT *, CASE WHEN {sql_trim('line')} = '' THEN NULL WHEN {L.sql_table_line('line')} THEN 1 WHEN {L.sql_any('line', L.HEADING_LINE)} THEN 0 END AS mark FROM {TENDER_LINES}"""
SQL["erase_table_regions"] = f"""WITH m AS ({_state}), s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS inside FROM m),
  t AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY pos) AS text FROM s WHERE inside = 0 AND (line = '' OR NOT {L.sql_garbage_line('line')}) GROUP BY l_orderkey)
  SELECT l_orderkey, {sql_trim(sql_sub('text', chr(92) + 'n{4,}', chr(10) * 3))} AS text FROM t WHERE {sql_trim('text')} <> ''"""

QUERIES["erase_leaked_rows"] = lambda s, d: O.erase_leaked(tender_docs(s, d), "l_orderkey").filter("text <> ''")
_leak = f"""SELECT *, CASE WHEN t = '' THEN NULL WHEN {L.sql_any('t', O.LEAK_START)} THEN 1 WHEN {sql_match('t', O.LEAK_STOP)} AND NOT {sql_match('t', O.LEAK_STOP_NOT)} THEN 0 END AS mark FROM (SELECT *, {sql_trim('line')} AS t FROM {TENDER_LINES})"""
_squeezed = sql_trim(sql_sub("text", chr(92) + "n{3,}", chr(10) * 2))
_undated = sql_trim(sql_sub(_squeezed, r"(?iu)\s*\d{4}\s*г\.?\s*\z", ""))
SQL["erase_leaked_rows"] = f"""WITH s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS inside FROM ({_leak})),
  k AS (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY pos) AS text FROM s WHERE inside = 0 AND (t = '' OR NOT ({L.sql_any('t', O.LEAK_LINE)} OR ({sql_match('t', O.LEAK_ROW[0])} AND {sql_match('t', O.LEAK_ROW[1])}))) GROUP BY l_orderkey)
  SELECT * FROM (SELECT l_orderkey, {sql_trim(sql_sub(_undated, r"(?iu)\s*гр\.\s*\S+\s*\z", ""))} AS text FROM k) WHERE text <> ''"""


def strip_boilerplate(spark, d):
    """Specification texts with page numbers, signatures and dates among their lines, some of
    them with a page number behind them."""
    key = F.col("l_orderkey")
    number = F.concat(F.lit(" " * 12), (key % 90 + 10).cast("string"))
    signed = F.when(key % 3 == 0, F.concat(F.lit("гр. София"), number)).when(key % 3 == 1, F.concat(F.lit("Съставил край"), number)).otherwise(F.concat(F.lit("обект "), key.cast("string"), number))
    extra = F.concat(F.lit("\nСтраница 3 от 9\n"), F.col("text"), F.lit("\nстр. край\n12/34\nгр. Правец\n2024 г.\n"), signed, F.lit("\nпоследен"))
    return tender_docs(spark, d).select("l_orderkey", O.strip_boilerplate(extra).alias("text"))


QUERIES["strip_boilerplate"] = strip_boilerplate
_SIGNED = "CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Съставил край' ELSE chr(10) || 'обект ' || l_orderkey END"
SQL["strip_boilerplate"] = f"""SELECT l_orderkey, {sql_trim(sql_sub(f"text || chr(10) || 'стр. край' || chr(10) || '12/34' || {_SIGNED} || chr(10) || 'последен'", chr(92) + 'n{3,}', chr(10) * 2))} AS text FROM {TENDER_DOCS}"""

QUERIES["clean_output_lines"] = lambda s, d: O.clean_output(table(s, d, "documents"), "doc_id")
SQL["clean_output_lines"] = f"""WITH l AS (SELECT doc_id, pos, {L.sql_output_line('line')} AS line FROM {DOC_LINES})
  SELECT doc_id, {sql_trim(sql_sub("coalesce(string_agg(line, chr(10) ORDER BY pos), '')", chr(92) + 'n{3,}', chr(10) * 2))} AS text FROM l GROUP BY doc_id"""


def _sections(spark, d):
    docs = tender_docs(spark, d)
    return docs.select("l_orderkey", F.concat(F.lit("Увод\n4. СЪЩЕСТВУВАЩО ПОЛОЖЕНИЕ\n\n"), "text", F.lit("\n5. Проектно решение\nНова настилка.\nСметка 9")).alias("text"))


QUERIES["section_until_stop"] = lambda s, d: _sections(s, d).select("l_orderkey", O.current_state(F.col("text")).alias("current_state"), O.project_solution(F.col("text")).alias("solution"))
SQL["section_until_stop"] = f"""SELECT l_orderkey, nullif({sql_trim("regexp_extract(t, '(?s)^(.*?)(?m:^)(III" + chr(92) + ".|5" + chr(92) + ". Проектно)', 1)")}, '') AS current_state, 'Нова настилка.' AS solution
  FROM (SELECT l_orderkey, {sql_trim("text || chr(10) || '5. Проектно решение'")} AS t FROM {TENDER_DOCS})"""
QUERIES["section_compound"] = lambda s, d: tender_docs(s, d).select("l_orderkey", O.project_solution(F.concat(F.lit("3. Описание и проектно решение на обекта\n"), F.repeat(F.lit("Пласт от асфалт. "), 5), F.col("l_orderkey").cast("string"), F.lit("\n2. ОБЕКТ: втори\nкрай"))).alias("solution"))
SQL["section_compound"] = f"SELECT l_orderkey, repeat('Пласт от асфалт. ', 5) || l_orderkey AS solution FROM {TENDER_DOCS}"


def section_source(spark, d):
    """Turns as files; those of the assistant hold the section."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat("role", F.col("turn").cast("string")).alias("filename"), F.when(F.col("role") == "assistant", F.concat(F.lit("Текущо състояние\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("body"))
    return O.section_source(c, "conv_id", O.current_state)


QUERIES["section_source"] = section_source
SQL["section_source"] = f"SELECT conv_id, arg_min(role || turn, turn) AS source FROM conversations WHERE role = 'assistant' AND {sql_trim('coalesce(text, ' + chr(39) * 2 + ')')} <> '' GROUP BY conv_id"

_NAMES = ["проект на договор", "Документация за участие", "Техническа спецификация", "параметри", "КСС", "обяснителна записка", "друг файл"]


def tender_files(spark, d) -> DataFrame:
    """Turns of conversations as files of all classes."""
    c = table(spark, d, "conversations")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("turn") % len(_NAMES)).cast("int") + 1)
    return c.select("conv_id", F.col("turn").alias("ord"), name.alias("filename"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nчл. 3 X. Гаранция: 5 години за "), F.col("conv_id").cast("string")).alias("body"))


_name_sql = f"{'[' + ', '.join(map(quote, _NAMES)) + ']'}[turn % {len(_NAMES)} + 1]"
FILES = f"(SELECT conv_id, turn AS ord, {_name_sql} AS filename, coalesce(text, '') || chr(10) || 'чл. 3 X. Гаранция: 5 години за ' || conv_id AS body FROM conversations)"
QUERIES["classify_documents"] = lambda s, d: tender_files(s, d).select("conv_id", "ord", L.document_class(F.col("filename"), F.col("body")).alias("class"))
SQL["classify_documents"] = f"SELECT conv_id, ord, {L.sql_document_class('filename', 'body')} AS class FROM {FILES}"
QUERIES["extract_guarantee"] = lambda s, d: tender_files(s, d).select("conv_id", "ord", E.guarantee(F.col("body")).alias("clause"))
SQL["extract_guarantee"] = f"""SELECT conv_id, ord, CASE WHEN i > 1 THEN '[Извлечено от Проект на договор – Гаранционна отговорност]' || chr(10) || {sql_trim('left(substr(body, i), 3000)')} END AS clause
  FROM (SELECT *, instr(body, regexp_extract(body, '(?i)(X[.]|Х[.]|ГАРАНЦИОННА)')) AS i FROM {FILES})"""

# The sections of an introduction that files of a class are sources of.
SECTIONS_OF = {"parameters": [1], "techSpec": [1, 2, 3], "explanatoryNote": [2], "contract": [3], "documentation": [1, 3], "other": [1, 2]}


def files_by_section(spark, d):
    """conv_id, section, files: for each section the files that have something for it."""
    files = tender_files(spark, d)
    cleaned = O.clean_corpus(files.select(F.struct("conv_id", "ord").alias("k"), F.lit(1).alias("ord"), "filename", "body"), "k").filter("text <> ''")
    used = files.join(cleaned.select(F.col("k.conv_id").alias("_c"), F.col("k.ord").alias("_o")), (F.col("conv_id") == F.col("_c")) & (F.col("ord") == F.col("_o")))
    table_ = F.create_map(*[x for c, s in SECTIONS_OF.items() for x in (F.lit(c), F.array(*map(F.lit, s)))])
    rows = used.select("conv_id", "ord", "filename", F.explode(table_[L.document_class(F.col("filename"), F.col("body"))]).alias("section"))
    return rows.groupBy("conv_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "filename"))), lambda x: x["filename"]), ", ").alias("files"))


QUERIES["files_by_section"] = files_by_section
QUERIES["clean_corpus"] = lambda s, d: O.clean_corpus(tender_files(s, d), "conv_id")
# each file's lines outside of tables, and what its class lets through
_PARTS = rf"""f AS (SELECT *, {L.sql_document_class('filename', 'body')} AS class, instr(body, regexp_extract(body, '(?i)(X[.]|Х[.]|ГАРАНЦИОННА)')) AS i FROM {FILES}),
  l AS (SELECT conv_id, ord, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT conv_id, ord, regexp_split_to_array(body, '\r?\n') AS x FROM f)),
  m AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN {L.sql_table_line('t')} THEN 1 WHEN {L.sql_any('t', L.HEADING_LINE)} THEN 0 END AS mark FROM (SELECT *, {sql_trim('line')} AS t FROM l)),
  s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id, ord ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS inside FROM m),
  k AS (SELECT conv_id, ord, string_agg(CASE WHEN t = '' THEN '' ELSE line END, chr(10) ORDER BY pos) AS text FROM s WHERE inside = 0 AND (t = '' OR NOT {L.sql_garbage_line('t')}) GROUP BY conv_id, ord),
  p AS (SELECT f.conv_id, f.ord, f.filename, class, nullif({sql_trim(sql_sub('text', chr(92) + 'n{4,}', chr(10) * 3))}, '') AS whole, body, i FROM f LEFT JOIN k ON k.conv_id = f.conv_id AND k.ord = f.ord),
  parts AS (SELECT *, CASE class WHEN 'kss' THEN NULL WHEN 'documentation' THEN NULL
    WHEN 'contract' THEN CASE WHEN i > 1 THEN '[Извлечено от Проект на договор – Гаранционна отговорност]' || chr(10) || {sql_trim('left(substr(body, i), 3000)')} END
    WHEN 'techSpec' THEN '[Техническа спецификация]' || chr(10) || whole WHEN 'parameters' THEN '[Параметри на поръчката]' || chr(10) || left(body, 3000)
    WHEN 'explanatoryNote' THEN '[Обяснителна записка]' || chr(10) || whole ELSE whole END AS part FROM p)"""
SQL["clean_corpus"] = f"""WITH {_PARTS} SELECT conv_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS text FROM parts WHERE part IS NOT NULL GROUP BY conv_id"""
_of_class = " ".join(f"WHEN '{c}' THEN {x}" for c, x in SECTIONS_OF.items())
SQL["files_by_section"] = f"""WITH {_PARTS}, u AS (SELECT conv_id, ord, filename, unnest(CASE class {_of_class} END) AS section FROM parts WHERE part <> '')
  SELECT conv_id, section, string_agg(filename, ', ' ORDER BY ord, filename) AS files FROM u GROUP BY conv_id, section"""
QUERIES["role_sections"] = lambda s, d: O.role_sections(tender_lines(s, d), "l_orderkey")
QUERIES["role_requirements"] = lambda s, d: O.role_sections(O.explode_lines(_roles(s, d), "l_orderkey"), "l_orderkey").filter("requirements <> ''")


def _roles(spark, d):
    return tender_docs(spark, d).select("l_orderkey", F.concat(F.lit("изисквания към екип\n"), "text", F.lit("\n2) Геодезист - стаж 3 г.\nдиплома")).alias("text"))


def _sql_roles(lines: str) -> str:
    """The roles of lines, whose role lines are those of the pattern and a surveyor's."""
    role = "(line LIKE '1. Р%' OR line LIKE 'ключови%' OR line LIKE '2) Г%')"
    name = "CASE WHEN line LIKE '1. Р%' THEN 'Ръководител на проекта' WHEN line LIKE '2) Г%' THEN 'Геодезист' ELSE 'ключови експерти' END"
    tail = "CASE WHEN line LIKE '1. Р%' THEN split_part(line, '– ', 2) WHEN line LIKE '2) Г%' THEN split_part(line, ' - ', 2) END"
    end = f"({L.sql_any('line', O.ROLE_END)} OR ({sql_match('line', O.ROLE_END_NUMBERED)} AND NOT {sql_match('line', O.ROLE_END_NOT)}))"
    return f"""WITH a AS (SELECT *, {sql_trim('line')} AS t, {role} AS role, {L.sql_any('line', O.ROLE_START)} AS start FROM {lines}),
  b AS (SELECT *, min(pos) FILTER (WHERE {end}) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop_at,
    min(pos) FILTER (WHERE role) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN CURRENT ROW AND 299 FOLLOWING) AS next_at FROM a),
  c AS (SELECT *, least(coalesce(stop_at, 1073741824), pos + 300) AS stop FROM b),
  f AS (SELECT l_orderkey, min(pos) AS first, min_by(stop, pos) AS stop FROM c WHERE start AND next_at < stop GROUP BY l_orderkey),
  g AS (SELECT c.l_orderkey, pos, line, role, list({{'t': t, 'halt': t = '' OR role OR regexp_matches(t, '^[0-9]+[.][0-9]+')}}) OVER (PARTITION BY c.l_orderkey ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING) AS after
    FROM c JOIN f ON f.l_orderkey = c.l_orderkey AND pos >= f.first AND pos < f.stop),
  h AS (SELECT *, coalesce(nullif(list_position(list_transform(after, lambda x: x.halt), true), 0), len(after) + 1) AS n FROM g WHERE role)
  SELECT l_orderkey, pos AS ord, {name} AS name, {sql_trim(f"concat_ws(' ', {tail}, nullif(array_to_string(list_transform(after[1 : n - 1], lambda x: x.t), ' '), ''))")} AS requirements FROM h"""


SQL["role_sections"] = _sql_roles(TENDER_LINES)
_MORE_LINES = f"""(SELECT l_orderkey, 0 AS pos, 'изисквания към екип' AS line FROM {TENDER_LINES} GROUP BY l_orderkey UNION ALL SELECT l_orderkey, pos + 1, line FROM {TENDER_LINES}
  UNION ALL SELECT l_orderkey, max(pos) + 2, '2) Геодезист - стаж 3 г.' FROM {TENDER_LINES} GROUP BY l_orderkey UNION ALL SELECT l_orderkey, max(pos) + 3, 'диплома' FROM {TENDER_LINES} GROUP BY l_orderkey)"""
SQL["role_requirements"] = f"SELECT * FROM ({_sql_roles(_MORE_LINES)}) WHERE requirements <> ''"


def context_assembly(spark, d):
    """The two longest turns of a conversation, cut and numbered."""
    c = table(spark, d, "conversations")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.length("text").desc(), "turn"))
    top = c.withColumn("rank", rank).filter("rank <= 2")
    return O.join_lines(top.select("conv_id", F.col("rank").alias("pos"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.left("text", F.lit(2000))).alias("line")), "conv_id", between="\n\n")


QUERIES["context_assembly"] = context_assembly
SQL["context_assembly"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC NULLS LAST, turn) AS rank FROM conversations)
  SELECT conv_id, coalesce(string_agg('[' || rank || '] ' || left(text, 2000), chr(10) || chr(10) ORDER BY rank), '') AS text FROM r WHERE rank <= 2 GROUP BY conv_id"""
QUERIES["role_names"] = lambda s, d: QUERIES["role_lines"](s, d).select("l_orderkey", "pos", "name")
SQL["role_names"] = f"SELECT l_orderkey, pos, name FROM ({SQL['role_lines']})"
