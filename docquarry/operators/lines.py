"""Operators over the lines of documents.

A document's lines are rows key, pos, line (pos from 0). Windows run over one document, so
work is dealt by document and grows with its lines, not with their square."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import lines as L
from ..functions.chains import let, trim

MARKER = r"^---\s+(.+?)\s+---\z"


def explode_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each line; a null text has none, an empty one an empty line."""
    return docs.select(key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("pos", "line"))


def join_lines(lines: DataFrame, key: str, line: str = "line", between: str = "\n", name: str = "text") -> DataFrame:
    """The texts of documents from their lines, in order of pos; null lines are left out."""
    return lines.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", line)))[line], between).alias(name))


def heading_candidates(docs: DataFrame, key: str, text: str = "text", most: int = 500) -> DataFrame:
    """key, text, offset, class, ord: lines that may be headings, numbered ones first, then
    capitals, then short titles; each text once; the first so many of a document."""
    lines = explode_lines(docs, key, text)
    offset = F.sum(F.length("line") + 1).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    lines = lines.withColumn("offset", F.coalesce(offset, F.lit(0)).cast("long")).withColumn("t", trim(F.col("line")))
    t, n = F.col("t"), F.length("t")
    numbered = t.rlike(r"^([0-9]{1,2}\.([0-9]{1,2}\.?)?\s+|[IVXivx]+\.\s+)")
    caps = (n >= 4) & (n <= 120) & (t == F.upper(t)) & t.rlike("[А-ЯA-Z]") & ~t.rlike("^[0-9]")
    amount = r"^[0-9]+[,.]?[0-9]*\s*(бр|м|кв|куб|лв|кг|т|мм|см|km|m²|m³|%|дни|год|мес)?\.?\s*\z"
    short = (n >= 5) & (n <= 120) & ~F.contains(t, F.lit("  ")) & ~t.rlike(r"[.]{2,}") & ~t.rlike(amount)
    lines = lines.filter((n >= 3) & (numbered | caps | short) & ~t.rlike(r"^[0-9]+\z"))
    kind = F.when(t.rlike(r"^[0-9]{1,2}\."), 0).when((t == F.upper(t)) & t.rlike("[А-ЯA-Z]{3}"), 1).otherwise(2)
    first = lines.withColumn("class", kind).groupBy(key, "t").agg(F.min(F.struct("class", "pos", "offset")).alias("f"))
    first = first.select(key, F.col("t").alias("text"), "f.offset", "f.class", "f.pos")
    ord_ = F.row_number().over(W.partitionBy(key).orderBy("class", "pos"))
    return first.withColumn("ord", ord_).filter(F.col("ord") <= most).select(key, "text", "offset", "class", "ord")


def split_marked(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, filename, body: the files of a merged text, cut at lines --- name ---.

    Text before the first marker is dropped; a text without markers is one file without a
    name; null texts give nothing."""
    lines = explode_lines(docs, key, text)
    name = F.when(F.col("line").rlike(MARKER), F.regexp_extract("line", MARKER, 1))
    lines = lines.withColumn("name", name)
    part = F.count("name").over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("ord", part)
    marked = F.max("ord").over(W.partitionBy(key))
    lines = lines.withColumn("_most", marked).filter((F.col("ord") > 0) | (F.col("_most") == 0))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy(key, "ord", "_most").agg(F.coalesce(F.max("name"), F.lit("")).alias("filename"), body.alias("body"))
    return out.select(key, "ord", "filename", F.when(F.col("_most") > 0, trim(F.col("body"))).otherwise(F.col("body")).alias("body"))


def erase_regions(lines: DataFrame, key: str, start: Column, stop: Column, drop: Column) -> DataFrame:
    """The lines that stay: from a start line on all are dropped until a stop line, which
    stays; blank lines stay outside of regions only; of the other lines outside, those of drop
    go. start, stop and drop are conditions over the column t, the trimmed line."""
    lines = lines.withColumn("t", trim(F.col("line")))
    blank = F.col("t") == ""
    state = F.last(F.when(~blank & start, F.lit("in")).when(~blank & stop, F.lit("out")), ignorenulls=True).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("state", F.coalesce(state, F.lit("out")))
    return lines.filter((F.col("state") == "out") & (blank | ~drop)).drop("state", "t")


def erase_tables(docs: DataFrame, key: str, text: str = "text", compat: bool = True) -> DataFrame:
    """key, text of documents without bill tables and garbage lines, blank lines squeezed."""
    t = F.col("t")
    kept = erase_regions(explode_lines(docs, key, text), key, L.table_line(t), L.heading_line(t), L.garbage_line(t, compat))
    blank = kept.withColumn("line", F.when(trim(F.col("line")) == "", "").otherwise(F.col("line")))
    out = join_lines(blank, key)
    return out.select(key, trim(F.regexp_replace("text", r"\n{4,}", "\n\n\n")).alias("text"))


# What ends a leaked table, and lines that never belong to a section.
LEAK_START = [r"(?iu)^Сметка\s+\d+", r"(?iu)^КОЛИЧЕСТВЕНА\s+СМЕТКА", r"(?iu)^ВЕДОМОСТ\s+No"]
LEAK_STOP, LEAK_STOP_NOT = r"^\d+\.\s*\d+\s+[А-ЯA-Z]", r"^\d{3,4}"
LEAK_LINE = [
    r"(?iu)^Всичко:\s*[\d,.]+", r"(?iu)^-\s*съгласно\s+(Ведомост|Чертеж)", r"(?iu)^\[\s*U\d+\s*\]", r"(?iu)^Позиция\s+No\s", r"(?iu)^Наименование\s+на\s+видовете\s+работи",
    r"(?iu)Съставил\s*:", r"(?iu)^\s*/\s*инж\.\s", r"^/[^/]+/\s*\z", r"^\d{4}\s*г\.?\s*\z", r"(?iu)^гр\.\s*\S+\s*\z", r"^\.{5,}",
]
LEAK_ROW = (r"^\d{3,4}\s+", r"(?iu)\d+\s*(м[23²³]?|бр\.?|тон|кг)\s*\z")


def erase_leaked(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, text of sections without table rows and signatures that leaked into them."""
    t = F.col("t")
    drop = L.any_of(t, LEAK_LINE) | (t.rlike(LEAK_ROW[0]) & t.rlike(LEAK_ROW[1]))
    kept = erase_regions(explode_lines(docs, key, text), key, L.any_of(t, LEAK_START), t.rlike(LEAK_STOP) & ~t.rlike(LEAK_STOP_NOT), drop)
    out = trim(F.regexp_replace(F.col("text"), r"\n{3,}", "\n\n"))
    out = trim(F.regexp_replace(out, r"(?iu)\s*\d{4}\s*г\.?\s*\z", ""))
    return join_lines(kept, key).select(key, trim(F.regexp_replace(out, r"(?iu)\s*гр\.\s*\S+\s*\z", "")).alias("text"))


# Page furniture, as patterns over the whole text and over single lines.
FURNITURE = [
    (r"(?iu)Този документ е съставен[\s\S]*?Европейския съюз и/или ДФЗ\.?", ""), (r"(?iu)\n\s*Страница\s+\d+\s+от\s+\d+\s*\n", "\n"),
    (r"(?iu)\n\s*ОБЩИНА\s+[А-ЯA-Zа-яa-z\s]+\s*\n\s*MUNICIPALITY\s+[A-Za-z\s]+\s*", "\n"), (r"(?m)\n[^\n]*(е-mail:|@)[^\n]*\s{10,}\d{1,2}\s*$", ""),
    (r"(?imu)\n\s*Част:?\s*Пътна\s*\d+/\d+\s*$", ""), (r"(?imu)\n\s*КОЛИЧЕСТВЕНА\s+СМЕТКА\s*\d+/\d+\s*$", ""), (r"(?m)\n\s{15,}\d{1,2}\s*$", ""),
    (r"(?m)\n\s*Съставил\s*:[\s\S]*?(?:/[^/]+/|$)", ""), (r"(?m)\n[^\n]*\s{20,}\d{1,2}\s*$", ""),
]
# Lines that go before, and those that go after, a page number is cut from the ends of lines.
FURNITURE_LINE = [r"(?iu)^\s*m\s+\(m\)\s+шир\s+", r"(?iu)^Част:?\s*Пътна\s*\d+/\d+\z", r"(?iu)^КОЛИЧЕСТВЕНА\s+СМЕТКА\s*\d+/\d+\z"]
PAGE_AT_END = r"(?m)\s{10,}\d{1,2}\s*$"
SIGNED_LINE = [r"(?iu)Съставил\s*:", r"^\d{4}\s*г\.?\s*\z", r"(?iu)^гр\.\s*\S+\s*\z", r"(?iu)^/\s*инж\.\s", r"^/[^/]+/\s*\z", r"^\.{5,}"]
# A line of a page's number of pages, if it has at most so many letters.
PAGE_OF, PAGE_OF_MOST = r"^\d+/\d+\z", 4


def strip_boilerplate(text: Column) -> Column:
    """A text without page furniture; in the row, line by line, nothing is shuffled.

    Page numbers are cut from the ends of lines between the two passes over lines, so that a
    signature goes that has one behind it."""
    out = text
    for pattern, to in FURNITURE:
        out = F.regexp_replace(out, pattern, to)
    without = lambda t, drop: F.array_join(F.filter(F.split(t, "\n", -1), lambda x: ~let(trim(x), drop)), "\n")
    out = without(out, lambda t: L.any_of(t, FURNITURE_LINE) | (t.rlike(PAGE_OF) & (F.length(t) <= PAGE_OF_MOST)))
    out = without(F.regexp_replace(out, PAGE_AT_END, ""), lambda t: L.any_of(t, SIGNED_LINE))
    return F.when(trim(text) == "", text).otherwise(trim(F.regexp_replace(out, r"\n{3,}", "\n\n")))


def clean_output(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, text of written texts without addresses, table lines and thin lines."""
    out = F.filter(F.transform(F.split(text, r"\r?\n", -1), L.output_line), lambda x: x.isNotNull())
    return docs.select(key, trim(F.regexp_replace(F.array_join(out, "\n"), r"\n{3,}", "\n\n")).alias("text"))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The place (from 0) of the earliest match of any pattern; the length if there is none.

    The patterns are tried together: the leftmost match of all is that of one of them."""
    whole = "|".join(re.sub(r"^\(\?([a-z]+)\)(.*)\Z", r"(?\1:\2)", p, flags=re.S) for p in patterns)
    return let(F.regexp_instr(text, F.lit(whole)), lambda at: F.when(at > 0, at - 1).otherwise(F.length(text)))


def section_until(text: Column, heading: str, stops: list[str], least: int = 1) -> Column:
    """The text after the first heading up to the earliest stop; null if none or too short."""
    at, found = F.regexp_instr(text, F.lit(heading)), F.regexp_extract(text, heading, 0)
    after = F.when(at > 0, trim(F.substr(text, at + F.length(found))))
    body = let(after, lambda rest: trim(F.left(rest, first_match(rest, stops))))
    return let(body, lambda b: F.when(F.length(b) >= least, b))


# Headings and ends of the two sections that are taken over word by word.
CURRENT_STATE = r"(?imu)^\d*\.?\s*(?:Текущо\s+състояние|съществуващо\s+положение)\s*$"
CURRENT_STOPS = [r"(?imu)^\d*\.?\s*Проектно\s+решение", r"(?imu)^\d*\.?\s*ПРЕДВИДЕНИ\s+РАБОТИ", r"(?imu)^\d*\.?\s*ПОЛСК[ИО]\s*[–-]?\s*ИЗМЕРВАТЕЛНИ", r"(?m)^III\.\s+", r"(?m)^IV\.\s+", r"(?m)^---\s+.+\s+---$"]
SOLUTION, SOLUTION_IN = r"(?imu)^\d*\.?\s*Проектно\s+решение\s*$", r"(?imu)^[\d.]*\s*[^\n]*проектно\s+решение[^\n]*$"
SOLUTION_STOPS = [
    r"(?imu)^Сметка\s+\d+", r"(?imu)^КОЛИЧЕСТВЕНА\s+СМЕТКА", r"(?imu)^\s*Съставил:\s", r"(?m)^---\s+.+\s+---$", r"(?imu)^ВЕДОМОСТ\s+No", r"(?imu)^ЕЛЕМЕНТИ\s+НА\s+ВЕРТИКАЛНИТЕ", r"(?imu)^НИВЕЛЕТНИ\s+КОТИ",
    r"(?imu)^КООРДИНАТИ\s+НА\s+ГЛАВНИ", r"(?imu)^ОБЕМ\s+НА\s+АСФАЛТОБЕТОНА", r"(?imu)^ДАННИ\s+ЗА\s+ТЕРЕНА", r"(?imu)^\s*Вид\s+нивелета\s*:\s*прави", r"(?imu)^IV\.\s+СРОК\s+ЗА\s+ИЗПЪЛНЕНИЕ",
    r"(?imu)^V\.\s+ИЗИСКВАНИЯ", r"(?imu)^\d+\.\s+ИЗИСКВАНИЯ\s+ЗА\s+СЪОТВЕТСТВИЕ", r"(?imu)^\d+\.\s+ОБЩИ\s+ИЗИСКВАНИЯ\s+ПО\s+ЗУТ", r"(?imu)^\d+\.\s+ИЗИСКВАНИЯ\s+КЪМ\s+СТРОИТЕЛНИТЕ\s+ПРОДУКТИ",
    r"(?imu)^\d+\.\s+ГАРАНЦИОННИ\s+СРОКОВЕ", r"(?imu)^\d+\.\s+ОПИСАНИЕ\s+НА\s+ВИДОВЕТЕ\s+ДЕЙНОСТИ",
]
SECOND = [r"(?imu)^\s*2\.\s*ОБЕКТ\s*:?", r"(?imu)ОБОСОБЕНА\s+ПОЗИЦИЯ\s+No\s+2(?![0-9A-Za-z_])"]


def current_state(text: Column) -> Column:
    return section_until(text, CURRENT_STATE, CURRENT_STOPS)


def project_solution(text: Column) -> Column:
    """Under its own heading, else under one that holds the words; then up to a second object."""
    return F.coalesce(section_until(text, SOLUTION, SOLUTION_STOPS), section_until(text, SOLUTION_IN, SOLUTION_STOPS + SECOND, 51))


def section_source(files: DataFrame, key: str, section) -> DataFrame:
    """key, source: the first named file whose body has the section. files: as split_marked()."""
    found = files.filter((F.col("filename") != "") & section(F.col("body")).isNotNull())
    return found.groupBy(key).agg(F.min_by("filename", "ord").alias("source"))


def clean_corpus(files: DataFrame, key: str) -> DataFrame:
    """key, text: of each file of a merged text what its class lets through, in order.

    files: as split_marked() gives them."""
    from ..functions.entities import guarantee, key_parameters

    cls = L.document_class(F.col("filename"), F.col("body"))
    files = files.withColumn("class", F.when(F.col("filename") == "", "other").otherwise(cls))
    cleaned = erase_tables(files.withColumn("_id", F.struct(key, "ord")), "_id", "body").withColumnRenamed("text", "cleaned")
    both = files.join(cleaned.select(F.col(f"_id.{key}").alias("_k"), F.col("_id.ord").alias("_o"), "cleaned"), (F.col(key) == F.col("_k")) & (F.col("ord") == F.col("_o")), "left")
    full, c = F.nullif(F.coalesce("cleaned", F.lit("")), F.lit("")), F.col("class")
    part = (
        F.when(c == "kss", None).when(c == "contract", guarantee(F.col("body"))).when(c == "documentation", key_parameters(F.col("body")))
        .when(c == "techSpec", F.concat(F.lit("[Техническа спецификация]\n"), full)).when(c == "parameters", F.concat(F.lit("[Параметри на поръчката]\n"), F.left("body", F.lit(3000))))
        .when(c == "explanatoryNote", F.concat(F.lit("[Обяснителна записка]\n"), full)).otherwise(full)
    )
    return join_lines(both.select(key, F.col("ord").alias("pos"), part.alias("line")).filter("line is not null"), key, between="\n\n---\n\n")


def heading_blocks(parts: DataFrame, key: str, heading: Column, least: int = 21) -> DataFrame:
    """key, ord, title, body: each heading and the texts up to the next one; short bodies go.

    parts: rows key, pos, text; heading: a condition over them."""
    rows = parts.withColumn("_h", F.coalesce(heading, F.lit(False)).cast("int"))
    rows = rows.withColumn("ord", F.sum("_h").over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).filter("ord > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_h") == 0) & (F.col("text") != ""), F.struct("pos", "text")))), lambda x: x["text"]), "\n\n")
    out = rows.groupBy(key, "ord").agg(F.max(F.when(F.col("_h") == 1, F.col("text"))).alias("title"), trim(body).alias("body"))
    return out.filter(F.length("body") >= least)


# Where a role section begins and ends.
ROLE_START = [
    r"(?iu)(?:персонал|ръководен\s+(?:екип|състав)|минимален\s+(?:екип|състав)|професионална\s+компетентност|ключови\s+експерти|екип\s+за\s+изпълнение)",
    r"(?iu)участникът\s+(?:следва|трябва)\s+да\s+(?:разполага|осигури|предложи)\s+с\s+(?:\S+\s+)?(?:персонал|екип|ключови)", r"(?iu)изисквания\s+(?:към|за)\s+(?:персонал|екип|ключови\s+експерти)",
]
ROLE_END = [
    r"(?iu)^\d+\.\d+\.\s+(?:Участникът\s+следва|Минимални\s+изисквания\s+за\s+техническ)", r"(?iu)критери[ий]\s+за\s+подбор", r"(?iu)икономическ[ои]\s+и\s+финансов",
    r"(?iu)технически\s+(?:и\s+професионални\s+)?способности",
]
ROLE_END_NUMBERED, ROLE_END_NOT = r"^\d+\.\d+\.\d+\.\s+", r"(?iu)ръководител|експерт|специалист|лице\s+по|координатор|инженер"


def role_sections(lines: DataFrame, key: str, most: int = 300, follow: int = 14) -> DataFrame:
    """key, ord, name, requirements: roles of the first section that has one.

    A section runs from a start line to the next end line, over at most so many lines. A
    role's requirements stand on its line after a dash and on following lines up to a blank
    line, the next role, a numbered clause or the section's end."""
    line, w = F.col("line"), W.partitionBy(key).orderBy("pos")
    end = L.any_of(line, ROLE_END) | (line.rlike(ROLE_END_NUMBERED) & ~line.rlike(ROLE_END_NOT))
    rows = lines.withColumn("_start", L.any_of(line, ROLE_START)).withColumn("_role", L.role_line(line) & (F.length(L.role_name(line)) >= 3))
    rows = rows.withColumn("_end", F.min(F.when(end, F.col("pos"))).over(w.rowsBetween(1, W.unboundedFollowing)))
    # the first role at or after each start line, seen from it
    rows = rows.withColumn("_next", F.min(F.when(F.col("_role"), F.col("pos"))).over(w.rowsBetween(0, most - 1)))
    stop = F.least(F.coalesce("_end", F.lit(1 << 30)), F.col("pos") + most)
    good = F.when(F.col("_start") & (F.col("_next") < stop), F.struct(F.col("pos").alias("first"), stop.alias("stop")))
    rows = rows.withColumn("_s", F.min(good).over(W.partitionBy(key)))
    rows = rows.filter((F.col("pos") >= F.col("_s.first")) & (F.col("pos") < F.col("_s.stop")))
    t = trim(line)
    halt = (t == "") | L.role_line(line) | t.rlike(r"^\d+\.\d+")
    rows = rows.withColumn("_after", F.collect_list(F.struct(t.alias("t"), halt.alias("halt"))).over(w.rowsBetween(1, follow)))
    # lines up to the first that halts
    upto = F.aggregate("_after", F.struct(F.lit("").alias("s"), F.lit(True).alias("go")), lambda a, x: F.struct(F.when(a["go"] & ~x["halt"], F.concat_ws(" ", F.nullif(a["s"], F.lit("")), x["t"])).otherwise(a["s"]).alias("s"), (a["go"] & ~x["halt"]).alias("go")), lambda a: a["s"])
    wanted = trim(F.concat_ws(" ", L.role_tail(line), F.nullif(upto, F.lit(""))))
    return rows.filter("_role").select(key, F.col("pos").alias("ord"), L.role_name(line).alias("name"), wanted.alias("requirements"))
