"""Files in folders, functions by their SQL names, and the order of Bulgarian."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import sql
from docquarry.operators import citations
from docquarry.sources import files


def test_scan_listing_latest_texts(spark, tmp_path):
    made = {
        "a.pdf": b"%PDF-1.4 x", "b.pdf": b"not one", "c.docx": b"PK\x03\x04zz", "d.doc": bytes.fromhex("D0CF11E0A1B11AE1") + b"x", "e.txt": "текст\nдва".encode(), "f.xlsx": b"PK\x03\x04" + b"1" * 90,
        ".hidden": b"x", "empty.txt": b"", "g.bin": b"ab\x00c", "sub/h.html": b"<p>\xff</p>", "i.xls": bytes.fromhex("D0CF11E0A1B11AE1"), "j.DOCX": b"PK\x03\x04",
    }
    import os

    for n, (name, data) in enumerate(made.items()):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
        os.utime(p, (1_700_000_000 + n, 1_700_000_000 + n))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.accepted, r.reason) for r in files.scan(spark, str(tmp_path), limits={"xlsx": 50}).collect()}
    other = "another kind than its name says"
    assert got == {
        "a.pdf": ("pdf", True, None), "b.pdf": ("text", False, other), "c.docx": ("zip", True, None), "d.doc": ("ole", False, "old format"), "e.txt": ("text", True, None), "f.xlsx": ("zip", False, "too large"),
        "g.bin": ("binary", False, other), "h.html": ("text", True, None), "i.xls": ("ole", True, None), "j.DOCX": ("zip", True, None),
    }
    listed = files.listing(spark, str(tmp_path))
    names = [r.path.rsplit("/", 1)[1] for r in files.newest_first(listed).collect()]
    assert names == ["j.DOCX", "i.xls", "h.html", "g.bin", "f.xlsx", "e.txt", "d.doc", "c.docx", "b.pdf", "a.pdf"]
    assert files.latest(listed).first().path.endswith("j.DOCX") and files.latest(files.listing(spark, str(tmp_path), "*.pdf")).first().path.endswith("b.pdf")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.texts(spark, str(tmp_path)).collect()} == {"e.txt": "текст\nдва", "b.pdf": "not one", "h.html": "<p>�</p>"}


def test_functions_in_sql_are_the_column_functions(spark, data):
    names = sql.register(spark)
    assert len(names) >= 25
    odd = spark.createDataFrame([(None,), ("",), ("'a' \\ \"b\" <p>x&amp;lt;</p>",), ("Наредба №3 от 1.2.2020г",), ("БДС EN 1:2012",), ("1 234,5м",), ("Възложител: Община София",)], "text string")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text").union(odd)
    docs.createOrReplaceTempView("texts")
    for name in names:
        make, kinds = sql.FUNCTIONS[name]
        args = [("text", F.col("text")) if k == "string" else ("length(text) * 1.0D", F.length("text") * F.lit(1.0)) for k in kinds]
        by_name = spark.sql(f"SELECT text, {name}({', '.join(a for a, _ in args)}) AS v FROM texts")
        by_column = docs.select("text", make(*[c for _, c in args]).alias("v"))
        assert by_name.exceptAll(by_column).count() == 0 and by_name.schema["v"].dataType == by_column.schema["v"].dataType, name
    assert spark.sql("SELECT title_key_plain('А. Б')").first()[0] == "а б"


@pytest.mark.parametrize("parts", [1, 7])
def test_order_of_bulgarian(spark, parts):
    rows = [(n, r, s) for n, (r, s) in enumerate([("Я", "valid"), ("Б", "valid"), ("а", "valid"), ("б", "valid"), ("б", "valid"), (None, "valid"), ("z", "withdrawn"), ("я", None), ("х", "odd")])]
    out = citations.by_urgency(spark.createDataFrame(rows, "n long, ref string, status string").repartition(parts), "status", "ref").collect()
    assert [(r.ref, r.urgency, r.place) for r in out] == [("z", 1, 1), (None, 5, 1), ("а", 5, 2), ("б", 5, 3), ("б", 5, 3), ("Б", 5, 5), ("Я", 5, 6), ("х", 6, 1), ("я", 6, 2)]
