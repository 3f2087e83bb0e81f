"""Worked examples of functions and operators, and what nulls and empty texts give."""

from pyspark.sql import functions as F

from docquarry.functions import entities as E, lines as L, text as X
from docquarry.operators import bills, citations as C, html as H, library as B, lines as O


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expr(F.col("x"))).collect()]


def test_numbers(spark):
    assert one(spark, X.parse_quantity, "1,234.5", "12м", ".5", "5.", "abc", "", None) == [1.234, 12.0, 0.5, 5.0, 0.0, 0.0, 0.0]


def test_standards(spark):
    assert one(spark, X.standard_name, "БДС EN 12697-6:2020", "БДС 1517-2020", "БДС ЕN 13108-1:2006/NA:2017", None) == ["БДС EN 12697-6", "БДС 1517", "БДС EN 13108-1", None]
    assert one(spark, X.regulation_name, "НАРЕДБА № 3 от 31.07.2003 г.", "Наредба РД-02-20-1 от 01.04.2024 г") == ["Наредба № 3 от 31.07.2003 г.", "Наредба РД-02-20-1 от 01.04.2024 г."]


def test_names(spark):
    assert one(spark, X.fix_mojibake, "Ð¢Ðµ", "Тест.docx", "plain", None) == ["Те", "Тест.docx", "plain", None]
    assert one(spark, lambda c: X.safe_path(c, F.lit("2024-01-02").cast("date")), "Щука 1.docx") == ["2024-01-02_Shtuka_1.docx"]
    assert one(spark, X.title_key_folded, "Изкоп тpaншeя", "„Изкоп.“") == ["изкоп траншея", "изкоп"]


def test_garbage_lines(spark):
    assert one(spark, L.garbage_line, "a@b.bg", "=====", "Проектно решение", "4. Heading, x", "", "ab") == [True, True, True, False, False, True]
    assert one(spark, lambda c: L.garbage_line(c, False), "Проектно решение", "-----") == [False, True]


def test_role_lines(spark):
    assert one(spark, L.role_name, "1. Ръководител на проекта – стаж 5 г.", "- Експерт: качество") == ["Ръководител на проекта", "Експерт"]


def test_answers(spark):
    got = spark.createDataFrame([('x {"matchedTitle":"X","confidence":130} y',), ("{broken",), (None,)], "x string").select(E.llm_object(F.col("x")).alias("a")).select("a.matchedTitle", "a.confidence").collect()
    assert [tuple(r) for r in got] == [("X", 100.0), (None, None), (None, None)]


def test_citations_once_each(spark):
    docs = spark.createDataFrame([(1, "БДС EN 933-1 и EN 933-1, БДС EN ISO 9001:2015, БДС EN 933-, xEN 13"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in C.extract_references(docs, "doc_id").select("doc_id", "normalized").orderBy("normalized").collect()]
    assert got == [(1, "ISO 9001"), (1, "БДС EN 933-1"), (1, "БДС EN ISO 9001")]


def test_registry_numbers_stand_alone(spark):
    refs = spark.createDataFrame([("933-1",), ("12697-2",)], "search_term string")
    cards = spark.createDataFrame([(0, "БДС EN 16933-1", "60.60"), (1, "БДС 301 933-1", "60.60"), (2, "БДС EN 12697-23", "60.60"), (3, "БДС EN 933-1:2012", "90.92")], "ord long, title string, status_code string")
    assert [tuple(r) for r in C.registry_match(refs, cards).collect()] == [("933-1", "БДС EN 933-1:2012", "90.92", "replaced")]


def test_headers_that_are_parts_of_aliases(spark):
    cells = spark.createDataFrame([("a", 0, ["a", "b", "c", "d"]), ("b", 0, ["x1", "x2", "x3", "x4"])], "sheet_id string, row_idx int, cells array<string>")
    got = {r.sheet_id: (r.code, r.name, r.unit, r.quantity) for r in bills.bill_headers(cells).collect()}
    assert got == {"a": (2, 0, 0, 0), "b": (None, None, None, None)}


def test_stray_table_ends(spark):
    pages = spark.createDataFrame([(1, "</table><table><tr><td><table></table></td></tr></table>x<table>y"), (2, None)], "page_id long, html string")
    got = [(r.ord, r.table) for r in H.toplevel_tables(pages, "page_id").orderBy("ord").collect()]
    assert got == [(1, "<table><tr><td><table></table></td></tr></table>"), (2, "<table>y")]


def test_filled_blocks_give_on(spark):
    long = "</table>" + "<p>" + "описание на пласт " * 100 + "</p>"
    blocks = spark.createDataFrame([(1, 1, "a", "<table>a</table>", "a"), (1, 2, "b", "<table>b</table>", "b"), (1, 3, "c", "<table>c" + long, "описание " * 200)], "d long, ord int, title string, html_body string, plain string")
    assert all(r.n > 1500 for r in H.donor_fill(blocks, "d").select(F.length("plain").alias("n")).collect())


def test_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    log = spark.createDataFrame([(1, "update", "c", 1), (1, "update", None, 2), (2, "delete", None, 3), (3, "update", "x", 4), (2, "create", "z", 5)], "k long, op string, v string, t long")
    got = [tuple(r) for r in B.apply_changes(base, log, "k", ["v"], ["t"]).orderBy("k").collect()]
    assert got == [(1, "c", 1), (2, "z", 5)]


def test_marked_text(spark):
    docs = spark.createDataFrame([(1, "--- a.txt ---\n x \n--- b.txt ---\ny"), (2, "без знак"), (3, None)], "id long, text string")
    assert [tuple(r) for r in O.split_marked(docs, "id").orderBy("id", "ord").collect()] == [(1, 1, "a.txt", "x"), (1, 2, "b.txt", "y"), (2, 0, "", "без знак")]


def test_signature_with_a_page_number_behind_it(spark):
    from docquarry.operators.lines import strip_boilerplate

    texts = {"а\nгр. София" + " " * 12 + "12\nб": "а\nб", "а\nгр. София\nб": "а\nб", "а\n/Иванов/" + " " * 10 + "7\nб": "а\nб", "а\n12/3\nб": "а\nб", "а\n12/34\nб": "а\n12/34\nб", "а\nСъставил: б" + " " * 11 + "3": "а", "": "", " ": " "}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.out for r in docs.select("text", strip_boilerplate(docs["text"]).alias("out")).collect()} == texts
