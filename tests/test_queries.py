"""Every registered query with a twin gives the twin's rows; the others give rows."""

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions

from docquarry.operators import citations, html, matching, vectors
from docquarry.plans import registry
from docquarry.sources import stored
from docquarry.streaming import jobs

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_twin(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_lists_find_nine_of_ten_neighbours(spark, data):
    for d in (data, data.replace("0.001", "0.1")):
        exact = {tuple(r) for r in QUERIES["vector_topk_batch"](spark, d).select("q_id", "vec_id").collect()}
        found = {tuple(r) for r in QUERIES["vector_topk_ivf"](spark, d).select("q_id", "vec_id").collect()}
        assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


def test_probes_hold_for_queries_that_they_were_not_fitted_on(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)).tolist()
    rows = spark.createDataFrame([*enumerate(x), (3000, None), (3001, [0.0] * 16), (3002, x[7])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(x) if i % 5 == 0] + [(5000, None), (5001, [0.0] * 16)], "q_id long, q array<float>")
    indexed, centres = vectors.assign_lists(rows, vectors.lists_for(3003))
    indexed = indexed.cache()
    assert len(centres) == 55
    probes, measured = vectors.fit_probes(queries, indexed, centres, sample=150)
    assert 0.9 <= measured and probes < 55
    exact = {tuple(r) for r in vectors.topk_batch(queries, rows).select("q_id", "vec_id").collect()}
    found = vectors.topk_ivf(queries, indexed, centres, probes=probes, block=20).cache()
    assert len(exact & {tuple(r) for r in found.select("q_id", "vec_id").collect()}) >= 0.9 * len(exact)
    every = {(r.q_id, r.vec_id, r.rank) for r in vectors.topk_ivf(queries, indexed, centres, probes=55, block=20).collect()}
    assert every == {(r.q_id, r.vec_id, r.rank) for r in vectors.topk_batch(queries, rows).collect()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5


def test_cache_in_a_stream_answers_as_in_a_loop(spark, data):
    from docquarry.plans.library import _STATUS_OF

    got = {r.event_id: r.state for r in QUERIES["stream_ttl_cache"](spark, data).collect()}
    held, want = {}, {}
    for r in sorted(spark.read.parquet(f"{data}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        old = held.get(r.user_id)
        fresh = old is not None and (r.ts - old[0]).total_seconds() < 86400 and old[1] != "unknown"
        want[r.event_id] = "fresh" if fresh else "check"
        if not fresh:
            held[r.user_id] = (r.ts, _STATUS_OF.get(r.event_type, "under_review"))
    assert got == want


def test_searches_without_a_query(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "vec_id long, embedding array<float>")
    none = spark.createDataFrame([(None,)], "q array<float>")
    assert vectors.topk(rows, none).count() == 0
    assert [r.vec_id for r in vectors.topk(rows, spark.createDataFrame([([2.0, 0.1],)], "q array<float>")).collect()] == [1, 4]
    embed = lambda texts: [[1.0, 0.5] for _ in texts]

    def broken(texts):
        raise RuntimeError("the model is away")

    asked = spark.createDataFrame([("ремонт",)], "text string")
    newest = [rows["vec_id"].desc()]
    assert [r.vec_id for r in vectors.search_sections(rows, asked, embed, newest, k=1).collect()] == [4]
    assert [(r.vec_id, r.similarity) for r in vectors.search_sections(rows, asked, broken, newest, k=2).collect()] == [(4, 0.5), (3, 0.5)]
    for text in ("  ", None):
        assert vectors.search_sections(rows, spark.createDataFrame([(text,)], "text string"), embed, newest).count() == 0


def test_queries_of_several_lengths(spark):
    rows = spark.createDataFrame([(i, [1.0, i / 10] + [0.5] * (i % 3)) for i in range(12)], "vec_id long, embedding array<float>")
    queries = rows.selectExpr("vec_id as q_id", "embedding as q").union(spark.createDataFrame([(99, [1.0] * 7)], "q_id long, q array<float>"))
    got = vectors.topk_batch(queries, rows, 1).collect()
    assert {(r.q_id, r.vec_id) for r in got} == {(i, i) for i in range(12)}


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    schema = "k long, v long, at long"
    for run, rows in enumerate([[(1, 10, 1), (2, 20, 1)], [(2, 21, 2)], [(1, 9, 0), (3, 30, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = jobs.file_source(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        kept = jobs.upsert_stream(source, str(tmp_path / "table"), str(tmp_path / "state"), ["k"], ["at"], buckets=4)
        assert len(kept.batches()) == run + 1
    got = kept.rows()
    assert {tuple(r) for r in got.collect()} == {(1, 10, 1), (2, 21, 2), (3, 30, 3)}
    assert stored.BucketedTable(spark, str(tmp_path / "none"), source.schema, ["k"], ["at"]).rows().count() == 0


def test_judge_from_a_function(spark):
    candidates = spark.createDataFrame([(1, "Изкоп", 1, 5, "Изкоп машинен"), (1, "Изкоп", 2, 4, "Насип"), (2, "Бордюр", 1, 1, "Тротоар")], "item_id long, name string, rank int, ord long, title string")
    judge = matching.python_judge(lambda name, titles: f'ето {{"matchedTitle":"{titles[0]}","confidence":{len(titles) * 40}}}')
    assert {tuple(r) for r in judge(candidates).collect()} == {(1, "Изкоп машинен", 80.0), (2, "Тротоар", 40.0)}


def test_cache_after_new_results(spark):
    cache = spark.createDataFrame([("a", "valid", "2024-01-01 00:00:00"), ("b", "unknown", "2024-01-01 00:00:00")], "reference_key string, status string, checked_at string")
    results = spark.createDataFrame([("b", "replaced", False), ("c", "valid", False), ("a", "withdrawn", True)], "reference string, status string, cached boolean")
    got = citations.save_cache(cache, results, functions.lit("2024-02-01 00:00:00")).collect()
    assert {(r.reference_key, r.status, str(r.checked_at)[:7]) for r in got} == {("a", "valid", "2024-01"), ("b", "replaced", "2024-02"), ("c", "valid", "2024-02")}


def test_registry_terms(spark):
    cards = spark.createDataFrame([(1, "БДС EN 933-1:2012 нещо", "60.60"), (2, "БДС EN 1933-1", "60.60"), (3, "EN 933-10", "60.60"), (4, "EN 12 933-1", "60.60"), (5, "ISO 9001/A1", "90.20"), (6, "EN 13242+A1", "95.99")], "ord long, title string, status_code string")
    refs = spark.createDataFrame([("933-1",), ("9001",), ("EN 13242+A1",), ("77",), ("без",)], "search_term string")
    got = {r.search_term: r.title for r in citations.registry_match(refs, cards).collect()}
    assert got == {"933-1": "БДС EN 933-1:2012 нещо", "9001": "ISO 9001/A1", "EN 13242+A1": "EN 13242+A1"}


def test_regulations_by_number_and_name(spark):
    listing = spark.createDataFrame([(1, "НАРЕДБА № 3 ОТ 31 ЮЛИ 2003 Г. ЗА АКТОВЕТЕ", "/a"), (2, "НАРЕДБА № 31 ОТ 1 ЮЛИ 2003 Г.", "/b"), (3, "Наредба № РД-02-20-1 от 5 февруари 2015 г.", "/c"), (4, "НАРЕДБА ЗА ИЗМЕНЕНИЕ НА НАРЕДБА № 3 ОТ ЮЛИ 2003", "/d")], "ord long, title string, url string")
    refs = spark.createDataFrame([("Наредба № 3 от 31.07.2003 г.",), ("Наредба № РД-02-20-1 от 05.02.2015 г.",), ("Наредба № 3 от 31.08.2003 г.",)], "normalized string")
    assert {r.normalized[8:15]: r.url for r in citations.regulation_match(refs, listing).collect()} == {"№ 3 от ": "/a", "№ РД-02": "/c"}


def test_titles_with_tags_between_their_words(spark):
    text = "увод " * 12 + "Технология <b>на</b> ИЗПЪЛНЕНИЕ <i>(и)</i> контрола " + "стъпка " * 12 + "Край на всичко: " + "още " * 20
    docs = spark.createDataFrame([(1, text)], "k long, text string")
    titles = spark.createDataFrame([(1, 1, "увод"), (1, 2, "технология изпълнение и контрола"), (1, 3, "Край на всичко:"), (1, 4, "липсва тук нещо")], "k long, ord int, title string")
    got = {r.ord: r.body for r in html.split_by_titles(docs, titles, "k", least=1).collect()}
    assert got[1].endswith("увод") and got[2].startswith("Технология <b>") and got[2].endswith("стъпка")
    assert got[3] == "К" and got[4].startswith("рай на всичко:")
