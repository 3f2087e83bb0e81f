"""Matches with places, nested tables and citations in the row, without any shuffle."""

import re

from pyspark.sql import functions as F

from docquarry.functions import places
from docquarry.operators import citations, html


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_matches(spark):
    texts = [None, "", "без", "а1б22в333", "😀1 ЖЖ жж 2", "1" * 3000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", places.all_matches(F.col("t"), [r"[0-9]+", r"(?iu)ж{2}", r"\d\s"]).alias("m")).collect()
    for r in got:
        want = None if r.t is None else [(n, m.start(), m[0]) for n, p in enumerate(["[0-9]+", "(?i)ж{2}", r"[0-9][ \t\n\x0b\f\r]"]) for m in re.finditer(p, r.t)]
        assert (None if r.m is None else [tuple(x) for x in r.m]) == want


PAGES = {
    1: "</table>x<table a><tr><TABLE>in</TABLE></tr></table></table>y<table>2</table>",
    2: "<table>open" + "z" * 50, 3: "<table>open <table>inner</table> tail", 4: None, 5: "", 6: "no tables",
    7: "<table>" * 300 + "</table>" * 300 + "<table></table>",
}


def test_nested_tables_in_the_row(spark):
    pages = spark.createDataFrame([*PAGES.items(), (6, "<table>q</table>")], "id long, html string")
    out = html.toplevel_tables(pages, "id", most=20)
    assert "Exchange" not in plan_of(out)
    got = sorted((r.id, r.ord, r.start, r.stop, r.table) for r in out.collect())
    assert [(i, o) for i, o, *_ in got] == [(1, 1), (1, 2), (2, 1), (3, 1), (6, 1), (7, 1), (7, 2)]
    assert [t for i, *_, t in got if i == 1] == ["<table a><tr><TABLE>in</TABLE></tr></table>", "<table>2</table>"]
    assert got[2][2:] == (0, 20, "<table>open" + "z" * 9) and got[3][4] == "<table>open <table>i"
    assert all((PAGES[i] or "")[a:b] == t for i, _, a, b, t in got if i != 6)


def test_blocks_without_a_shuffle(spark):
    title = lambda n: f"<table><tr><td><strong>Раздел {n}</strong></td></tr></table>"
    page = title(1) + "а" * 30 + "<table><tr><td>данни<table>вътре</table></td></tr></table>" + title(2) + "кратко" + title(3) + "<p>" + "б" * 25 + "</p>"
    out = html.template_blocks(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id")
    assert "Exchange" not in plan_of(out)
    assert [(r.ord, r.title, r.body) for r in out.orderBy("ord").collect()] == [(1, "Раздел 1", "а" * 30 + " данни вътре"), (4, "Раздел 3", "б" * 25)]
    lists = lambda n: f"<table><tr><td>Технология {n}</td><td>Ангажирани лица, механизация</td></tr></table>"
    page = lists(1) + "<p>" + "в" * 30 + "</p>" + lists(2) + "<p>" + "г" * 30 + "</p><table>ед. цена и обща стойност</table> край"
    out = html.technology_blocks(spark.createDataFrame([(1, page)], "id long, html string"), "id")
    assert "Exchange" not in plan_of(out)
    assert [(r.ord, r.title, r.html_body.endswith("</p>")) for r in out.orderBy("ord").collect()] == [(1, "Технология 1", True), (2, "Технология 2", True)]


def test_citations_without_a_shuffle(spark):
    text = "Вижте EN 13-1 и БДС EN 13-1:2012 – Изпитвания за геометрия, после EN 13-1. Наредба № 2 от 1.2.2020 г. за актове; НАРЕДБА №2 от 1.2.2020 г."
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "нищо"), (4, "ISO 9001- и EN 5 " * 2000)], "id long, text string")
    out = citations.extract_references(docs, "id")
    assert "Exchange" not in plan_of(out)
    got = out.collect()
    one = sorted((r.normalized, r.extracted_title, r.inline_description) for r in got if r.id == 1)
    assert one == sorted([("БДС EN 13-1", "Изпитвания за геометрия, после", None), ("Наредба № 2 от 1.2.2020 г.", None, "актове")] * 2)
    assert [r.normalized for r in got if r.id == 4] == ["EN 5"]
