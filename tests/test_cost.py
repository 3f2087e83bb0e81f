"""Work a row: each of these queries has few patterns, and gives what its plainer form gives."""

import itertools
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F

from docquarry.functions import lines as L, places, text as X
from docquarry.functions.chains import WS, lines, spaced, trim
from docquarry.operators import bills, citations as C, offers
from docquarry.plans import registry

ODD = [
    "", " ", "﻿\xa0 \t", "a", "ab", "a b", " a  b\t", "a\xa0b", "\x0b\f x\r", "1", "123", "12 34", "a@b.bg", "@", "E-MAIL:", "emaIl x", "e mail", "wWw.x", "www", "=====", "- - -", "–––", "\\|#~", "Проектно решение",
    "Проект, решение", "....", "a....", "a" * 15 + "." * 12, "a" * 16 + "." * 19, "б" * 20 + "," * 16, "é" * 40, "é" * 9 + "a", "😀" * 20, "😀 a 😀", "x" * 300, "_" * 20, "КОЛИЧЕСТВЕНА  СМЕТКА", "количествена сметка", " Сметка 7", "xСметка 7",
    "Всичко: 5", "всичко: 1,5 м3", "- съгласно Чертеж 4", "-съгласно ведомост", "101 Изкоп 5 м3", "1013, Изкоп 5 бр", "101 5 л. м", "[ U7 ]", "Позиция No ", "Наименование на видовете  работи", "1. Ръководител на проекта – стаж 5 г.", "2) Геодезист - стаж",
    "- Експерт: качество, друго", "• лице по ЗБУТ", "збут", "–Инженер" + "о" * 90 + " край", "Контрол на качеството, 1", "абвг: Специалист", "експерт" + " x" * 100, "длъжностно лице", "I. Част", "ЧАСТ ", "часТ x", "---", "V. А", "VI. a",
]


def compared(spark, new, old, values=ODD):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "x string").select("x", new(F.col("x")).alias("new"), old(F.col("x")).alias("old")).collect()
    assert [(r.x, r.new) for r in rows] == [(r.x, r.old) for r in rows]


def each(line, patterns):
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in patterns])


def plain_trim(x):
    return F.regexp_replace(x, rf"^[{WS}]+|[{WS}]+\z", "")


def plain_share(x):
    solid = F.regexp_replace(x, rf"[{WS}]", "")
    return F.try_divide(F.length(F.regexp_replace(solid, L._ALNUM, "")), F.length(solid)), F.length(solid)


def test_white_space(spark):
    compared(spark, trim, plain_trim)
    compared(spark, spaced, lambda x: F.regexp_replace(x, rf"[{WS}]+", " "))
    for chain, marks in ((X.title_key_plain, r"[.,;:!?–—\-()]"), (X.title_key_compare, r"[.,;:\-–—()\[\]/\\]")):
        compared(spark, chain, lambda x, m=marks: plain_trim(F.regexp_replace(F.regexp_replace(F.lower(x), m, " "), rf"[{WS}]+", " ")), [*ODD, "А - (б) . В", "..а", "[x]/ y\\"])


@pytest.mark.parametrize("name", ["TABLE_LINE", "HEADING_LINE", "OUTPUT_DROPPED", "ROLE_WORDS"])
def test_patterns_together(spark, name):
    compared(spark, lambda x: L.any_of(x, getattr(L, name)), lambda x: each(x, getattr(L, name)))
    compared(spark, lambda x: L.any_of(x, [r"^a|b", "(?iu)^Я", "c"]), lambda x: each(x, [r"^a|b", "(?iu)^Я", "c"]), ["xb", "a", "я", "Яb", "xЯ", "d"])


@pytest.mark.parametrize("compat", [True, False])
def test_garbage_lines(spark, compat):
    def old(x):
        share, total = plain_share(x)
        rules = F.regexp_replace(x, r"\d", "").rlike(L.RULES_ONLY if compat else L.RULES_STRICT)
        thin = (total >= 3) & (((total > 15) & (share < 0.45)) | ((total <= 15) & (share < 0.55)))
        return ~(plain_trim(x) == "") & (x.rlike(L._EMAIL) | x.rlike(r"(?i)e-?mail\s*:?\s*") | F.contains(x, F.lit("@")) | x.rlike(r"(?i)www\.") | rules | F.coalesce(thin, F.lit(False)))

    compared(spark, lambda x: L.garbage_line(x, compat), old)


def test_output_lines(spark):
    def old(x):
        t = plain_trim(x)
        share, total = plain_share(t)
        table = each(t, L.TABLE_LINE) | (t.rlike(L.TABLE_ROW[0]) & t.rlike(L.TABLE_ROW[1]))
        slim = F.regexp_replace(t, rf"[{WS}]+", " ")
        return F.when(t == "", "").when(~(each(t, L.OUTPUT_DROPPED) | table | F.coalesce((total >= 10) & (share < 0.5), F.lit(False))) & (F.length(slim) > 1), slim)

    compared(spark, L.output_line, old)


def test_role_lines(spark):
    bare = lambda x: F.regexp_replace(plain_trim(x), L.BULLET, "")
    compared(spark, L.role_line, lambda x: (plain_trim(x) != "") & (F.length(plain_trim(x)) <= 200) & each(bare(x), L.ROLE_WORDS))

    def name(x):
        c = plain_trim(bare(x))
        first = lambda p, most: F.when((F.size(F.split(c, p, -1)) > 1) & F.length(F.split(c, p, -1)[0]).between(5, most), plain_trim(F.split(c, p, -1)[0]))
        cut = F.when(F.length(c) > 80, plain_trim(F.regexp_replace(F.left(c, F.lit(80)), r"\s+\S*\z", ""))).otherwise(c)
        return F.coalesce(first(r"\s+[-–—]\s+", 1 << 30), first(r":\s*", 1 << 30), first(",", 80), cut)

    compared(spark, L.role_name, name)


def test_garbage_documents(spark):
    def old(x, script=r"\x{400}-\x{4FF}", other="a-zA-Z"):
        letters = F.regexp_replace(x, rf"[{WS}\d\p{{P}}]", "")
        count = lambda cls: F.length(F.regexp_replace(letters, f"[^{cls}]", ""))
        w, r = count(script), count(other)
        return x.isNull() | (F.length(x) < 80) | (F.length(letters) < 50) | (w + r < 30) | ((w < 0.15 * (w + r)) & (r > 20))

    texts = [a * n + b * m for a in ("б", "б, ", "é", "1.") for n in (0, 29, 30, 49, 50, 80, 200) for b in ("x", "x ", "😀") for m in (0, 20, 21, 30, 60, 1500)]
    compared(spark, L.garbage_document, old, texts)
    compared(spark, lambda x: L.garbage_document(x, "a-zA-Z", r"\x{400}-\x{4FF}"), lambda x: old(x, "a-zA-Z", r"\x{400}-\x{4FF}"), texts)


def test_citations_where_they_may_begin(spark):
    texts = ["БДС EN ISO 1, бдс ЕN 2 eN 3 ıSO 4 İsO 5 xEN 6 ENISO 7 EN\xa08 EN ISO 9", "БДС БДС 1 EN EN 2", "нАРЕДБА №3 от 1.2.2003 г. наредба НАРЕДБА РД-1 ОТ 1.2.2003", "", None, "БДС", "EN " * 50 + "1"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    both = docs.select(places.all_matches(F.col("t"), C.STANDARDS + C.REGULATIONS, C.BEGINS).alias("new"), places.all_matches(F.col("t"), C.STANDARDS + C.REGULATIONS).alias("old")).collect()
    assert [r.new for r in both] == [r.old for r in both] and sum(len(r.old or ()) for r in both) >= 10
    # the classes hold every form of the first letters
    for begin, letter in zip(C.BEGINS, "ББББEIНН", strict=True):
        assert set(re.findall(f"(?i){letter}", "".join(map(chr, range(0x20000))))) == set(re.match(r"\[(.*?)\]", begin)[1])


def test_titles_and_descriptions(spark):
    def after(x):
        rest = F.regexp_extract(F.regexp_replace(x, r"^(?::[0-9]{4}(?:/[A-Z0-9:]+)*)?\s*", ""), r"^(?:–|—|-{1,2})\s*([А-ЯA-Z][\s\S]*)", 1)
        return F.regexp_extract(rest, r"^[^\n]{15,250}", 0)

    def inline(x):
        short = F.regexp_replace(F.left(x, F.lit(120)), r"^:[0-9]{4}(?:/[A-Z0-9:]+)*", "")
        d = F.regexp_extract(short, r"^\s*(?:за|–|-|—|:)\s+([^,.\n;(]{5,80})", 1)
        return F.nullif(plain_trim(F.regexp_replace(d, r"\s*(?:БДС(?=[A-Za-z0-9_])|(?:EN|ISO)(?![A-Za-z0-9_])|Наредба(?=[A-Za-z0-9_])).*", "")), F.lit(""))

    titles = ["Изпитвания за свойства", "Изпитвания\nза свойства", "изпитвания за свойства", "Aб", "Аб " * 120, "акт EN 5 и", "EN и друго", "12345 : нещо"]
    tails = [a + b + c + t for a in ("", ":2012", ":2012/A1:2015", ":201", ":2012/", ":2012 :", "\n") for b in ("", " ", "\n ") for c in ("", "–", "-", "--", "---", "— ", "за ", ": ") for t in titles]
    # words of a title that is found are those of its first line, which the last steps only shorten
    plain = lambda x: F.when(after(x) != "", C.title_after(F.concat(F.lit("– "), after(x))))
    compared(spark, C.title_after, plain, tails)
    compared(spark, C.inline_description, inline, tails)
    heads = [h + d + s for h in ("", "Изпитвания за свойства", "увод; Изпитвания за свойства ", "-" * 20) for d in ("", "–", "—", "-", "--") for s in ("", " ", "\n\t", "\xa0", "x")]
    cand = lambda x: plain_trim(F.regexp_extract(x, r"^([\s\S]*?)(?:–|—|-{1,2})\s*\z", 1))
    compared(spark, C.title_before, lambda x: F.when(cand(x) != "", C.title_before(F.concat(cand(x), F.lit(" –")))), heads)


def test_no_terms_no_walk(spark):
    from docquarry.operators import terms

    rows = spark.createDataFrame([("а 1",), (None,)], "t string")
    none = terms.standing(rows, "t", spark.createDataFrame([("",), (None,)], "w string"), "w")
    assert none.columns == ["t", "w"] and none.count() == 0
    assert "Arrow" not in none._jdf.queryExecution().optimizedPlan().toString()


def test_headers(spark):
    rows = [["x"], ["№", "Име", "М.е.", "Количество"], ["код", "  НАИМЕНОВАНИЕ ", "мярка", "кол"], ["№", "описание"], ["", None], []]
    cells = spark.createDataFrame([(s, i, r) for s in range(len(rows)) for i, r in enumerate(rows[s:] + rows[:s])] + [(99, 30, rows[2]), (98, 1, rows[0]), (97, 0, None)], "sheet_id int, row_idx int, cells array<string>")
    normal = cells.filter("row_idx < 25").withColumn("n", F.transform("cells", lambda c: F.regexp_replace(plain_trim(F.lower(F.coalesce(c, F.lit("")))), rf"[{WS}]+", " ")))
    at = normal.select("sheet_id", "row_idx", *[bills.column_index(F.col("n"), a).alias(k) for k, a in bills.ALIASES.items()]).orderBy("row_idx").collect()
    for h in bills.bill_headers(cells).collect():
        own = [r for r in at if r.sheet_id == h.sheet_id]
        best = ([r for r in own if r.name is not None and r.quantity is not None] or [r for r in own if r.row_idx == 0] or [None])[0]
        assert tuple(h)[1:6] == (tuple(best)[1:] if best else (None,) * 5), h


#: Before: hundreds in clean_output_lines, then 15, 18, 49, 4, 177, 81, 76, 25 and 60.
MOST = {"clean_output_lines": 10, "garbage_lines": 10, "sql_functions": 9, "bill_items": 23, "bill_columns": 2, "role_requirements": 16, "role_lines": 5, "role_names": 3, "strip_boilerplate": 15, "extract_references": 37}


@pytest.mark.parametrize("name", MOST)
def test_few_patterns_a_row(spark, data, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_replace\(|RLIKE|regexp_extract\(", plan)) <= MOST[name]


def test_lines(spark):
    def old(x):
        for pattern, to in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
            x = F.regexp_replace(x, pattern, to)
        return x

    runs = ["".join(r) for n in range(6) for r in itertools.product(" \t\n", repeat=n)]
    compared(spark, lines, old, ["а" + r + "b" for r in runs] + [r + "\xa0" + r + "\r" for r in runs] + ODD)
    # one pattern over the text, where there were four
    docs = spark.createDataFrame([("a",)], "t string")
    assert docs.select(lines(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_offers_in_their_rows(spark, data):
    """A page is made, cut and searched for tables once, and meets nothing but its list of sections."""
    plan = registry.queries()["parse_offers"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 2 and plan.count("(?iu)&nbsp;") == 1
    assert not re.search(r"Window|min_by|LeftAnti", plan)


def test_offers_of_odd_pages(spark):
    table = lambda n, x="": f"<table><tr><td>Технология {n}</td><td>Ангажирани лица, механизация</td></tr></table><p>Описание {n}, достатъчно дълго за блок{x}.</p>"
    page = table(1) + "<h1>Увод</h1><p>" + "дума " * 60 + "<h1>Технологии</h1>" + table(1, ", второ") + table(2) + "<h1>Край</h1><p>" + "план " * 20 + "</p>"
    pages = spark.createDataFrame([(1, page), (2, page), (3, "без нищо"), (4, ""), (5, None), (6, "<p>къс</p>"), (None, page), (None, "също без нищо")], "k long, html string")
    sections = spark.createDataFrame([(1, 0, "introduction", "Увод"), (1, 1, "smr_technology", "Технологии"), (1, 2, "other", "Край"), (3, 0, "other", "Цялото"), (4, 0, "other", "x"), (9, 0, "other", "y")], "k long, ord int, type string, title string")
    got = offers.parse_sections(pages, sections, "k").collect()
    of = lambda k: [(r.order_index, r.section_type, r.title) for r in sorted(got, key=lambda r: r.order_index) if r.k == k]
    technologies = ["Технология 1", "Технология 2"]
    assert of(1) == [(0, "introduction", "Увод"), (1, "other", "Край"), *[(i, "smr_technology", t) for i, t in enumerate(technologies, 2)]]
    # of equal names that of the section; a page without a list has those of the whole page
    assert {r.k: "второ" in r.plain_text for r in got if r.k and r.title == technologies[0]} == {1: True, 2: False}
    assert [t for *_, t in of(2)] == technologies and of(3) == of(6) == [(0, "other", "Цялото съдържание")] and not of(4) + of(5) + of(9)
    # rows without a key are pages of their own
    assert sorted(of(None)) == sorted([*of(2), *of(3)])


def test_tables_of_each_text(spark):
    texts = [["<table>1</table>", "", None, "<table>2"], [], None, ["x<table><table></table></table>"]]
    rows = spark.createDataFrame([(t,) for t in texts], "t array<string>").coalesce(1)
    got = rows.select("t", places.table_spans_each(F.col("t")).alias("s")).collect()
    one = {r.x: r.s for r in spark.createDataFrame([(x,) for t in texts for x in t or ()], "x string").select("x", places.table_spans(F.col("x")).alias("s")).collect()}
    assert [r.s for r in got] == [None if t is None else [one[x] for x in t] for t in texts]


def test_introductions_up_to_the_phrase(spark):
    """Cut as if the whole text had been read, whatever stands around the phrase."""
    words, phrase = "дума " * 38, offers.DUTIES
    heads = [words + w for w in ("", "дума дума ", "дума дума\n\n\n", "дума <p> ", "дума &nbsp;&nbsp;\t", "<a <p>дълга дума ", "<a дълга дума ", "дълга дума < ", "<> дълга дума ", phrase.replace(" ", "  "), phrase.replace(" ", " <b>", 1), "дума" * 3 + "\xa0\r")]
    tails = ["", " остава", "> остава", "<p>още " + phrase, "</b> &lt;край&gt; "]
    bodies = ["<p>" + h + p + t for h in heads for p in (phrase, phrase.replace("на", "<i>на"), phrase.upper()) for t in tails] + [phrase + words, words, "", "а" * offers.MOST_PLAIN + phrase, "а" * (offers.MOST_PLAIN - len(phrase)) + phrase]
    rows = spark.createDataFrame([(t, b) for b in bodies for t in ("introduction", "other")], "type string, body string")
    got = rows.select("type", "body", offers._section(F.struct("type", "body", F.lit("").alias("title"))).alias("x"), X.html_block(F.col("body")).alias("p")).select("*", X.html_block(F.col("x.html_content")).alias("again"), offers.H.title_place(F.col("body"), F.lit(phrase), F.lit(1)).alias("at")).collect()
    cuts = 0
    for r in got:
        late = r.type == "introduction" and r.p[: offers.MOST_PLAIN].find(phrase) >= offers.DUTIES_FROM and (r["at"] or 0) > 1
        assert r.x.html_content == (r.body[: r["at"] - 1].strip(" \t\n\x0b\f\r\xa0\ufeff") if late else r.body), r.body[150:]
        assert r.x.plain_text == r.again[: offers.MOST_PLAIN], r.body[150:]
        cuts += late
    assert 20 < cuts < len(got) / 2
