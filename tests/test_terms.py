"""Terms with letters in titles: as a search by pattern, and no more rows than matches."""

import random
import re

from pyspark.sql import functions as F

from docquarry.operators import citations, terms


def test_standing_as_patterns(spark):
    rnd = random.Random(3)
    own = ["EN 1", "EN 13", "EN 13+A1", "A1", "1-A", "н 5", "", None, "+"]
    texts = ["".join(rnd.choice(["EN ", "1", "3", "+A1", "-", " ", "A", "н ", "5", "x"]) for _ in range(rnd.randint(0, 12))) for _ in range(400)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    words = spark.createDataFrame([(t,) for t in own * 2], "term string")
    for ok, form in ((terms.apart, r"(?<![0-9])(?<![0-9][\s\-]){}(?![0-9])"), (None, "{}")):
        for letters in (1 << 21, 5):
            got = sorted((r.id, r.term) for r in terms.standing(rows, "text", words, "term", ok, letters).collect())
            assert got == sorted((n, t) for n, x in enumerate(texts) if x for t in own if t and re.search(form.format(re.escape(t)), x))
    assert terms.standing(rows.limit(0), "text", words, "term").count() == 0
    assert terms.standing(rows, "text", words.limit(0), "term").count() == 0


def test_many_lettered_terms_make_as_many_rows_as_matches(spark):
    """All terms and titles share their first number: they met in one task, pair by pair."""
    own = spark.range(100_000).select(F.format_string("EN ISO 9001+A%d", "id").alias("search_term"))
    cards = spark.range(100_000).select(F.col("id").alias("ord"), F.format_string("БДС EN ISO 9001+A%d:2015", "id").alias("title"), F.lit("60.60").alias("status_code"))
    got = citations.registry_match(own, cards)
    assert got.count() == 100_000 and got.filter("title <> concat('БДС ', search_term, ':2015')").count() == 0
    assert citations._cards_of(own, cards).count() == 100_000


def test_terms_meet_texts_of_their_keys_only(spark):
    """Each of many terms stands in many texts, but in few of its own key; no term is sent to the tasks."""
    own = spark.range(3000).select(F.format_string("Н-%d", "id").alias("term"), (F.col("id") % 50).alias("k"))
    rows = spark.range(3000).select(F.format_string("x Н-%d, Н-%d0", "id", "id").alias("text"), (F.col("id") % 50).alias("k"))
    got = {(r.text, r.term) for r in terms.standing(rows, "text", own, "term", keys=["k"]).collect()}
    want = {(f"x Н-{n}, Н-{n}0", f"Н-{m}") for n in range(3000) for m in range(n % 50, 3000, 50) if f"Н-{m}" in f"Н-{n}, Н-{n}0"}
    assert got == want


def test_a_number_that_all_cards_share_makes_no_rows(spark):
    """The parts of cards' numbers, as 1 and 2024, were rows of one key each."""
    own = spark.range(2000).select(F.format_string("1%d-1", "id").alias("search_term"))
    cards = spark.range(2000).select(F.col("id").alias("ord"), F.format_string("БДС EN 1%d-1:2024", "id").alias("title"), F.lit("60.60").alias("status_code"))
    sent = []
    walk = terms._parts
    try:
        terms._parts = lambda *a: sent.append(walk(*a)) or sent[-1]
        assert citations._cards_of(own, cards).count() == 2000
    finally:
        terms._parts = walk
    assert cards.mapInArrow(sent[0], "ord long, title string, status_code string, search_term string").count() == 2000


def test_costly_rows_are_dealt_by_their_number(spark, monkeypatch):
    from docquarry.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    assert tables.spread(spark.range(0, 1000, 1, 6)).rdd.getNumPartitions() == 10


def _sides(spark):
    """Sides that Spark takes to be small, as tables of compressed files are: 16 bytes a row."""
    own = spark.range(3000).select(F.format_string("EN 1%d+A1", "id").alias("search_term"))
    cards = spark.range(6000).select(F.col("id").alias("ord"), F.format_string("БДС EN 1%d+A1:20%d", F.col("id") % 3000, F.when(F.col("id") < 3000, 12).otherwise(15)).alias("title"), F.when(F.col("id") < 3000, "90.92").otherwise("60.60").alias("status_code"))
    return own, cards


def _sent_whole(df):
    df.collect()
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_cards_and_terms_are_not_sent_through_the_driver(spark):
    """They were broadcast, as Spark takes what is derived from a small file to be small."""
    own, cards = _sides(spark)
    got = citations.registry_match(own, cards)
    assert not _sent_whole(got)
    assert got.filter("title = concat('БДС ', search_term, ':2012') and status = 'replaced'").count() == got.count() == 3000


def test_replaced_standards_are_not_sent_through_the_driver(spark):
    own, cards = _sides(spark)
    got = citations.registry_successor(citations.registry_match(own, cards), cards)
    assert not _sent_whole(got)
    assert got.filter("replaced_by = concat('БДС ', search_term, ':2015') and draft_version is null").count() == got.count() == 3000


def test_references_and_their_cache_are_not_sent_through_the_driver(spark):
    """Only the years and months that are cited are: there are few."""
    own, cards = _sides(spark)
    standards = own.select(F.concat(F.lit("БДС "), "search_term").alias("normalized"), F.lit("standard").alias("ref_type"), "search_term")
    rules = spark.range(300).select(F.format_string("Наредба № %d от 01.03.2015 г.", "id").alias("normalized"), F.lit("regulation").alias("ref_type"), F.lit("").alias("search_term"))
    none = F.lit(None).cast("string")
    refs = standards.unionByName(rules).withColumns({"extracted_title": none, "inline_description": none})
    cache = own.filter("search_term like '%5+A1'").select(F.concat(F.lit("БДС "), "search_term").alias("reference_key"), F.lit("valid").alias("status"), F.lit("2024-01-30 12:00:00").alias("checked_at"))
    listing = spark.range(0, 300, 2).select(F.col("id").alias("ord"), F.format_string("НАРЕДБА № %d ОТ 1 МАРТ 2015 Г.", "id").alias("title"), F.format_string("/%d", "id").alias("url"))
    got = citations.validate(refs, cache, cards, listing, F.lit("2024-01-31 00:00:00"))
    rows = got.groupBy("ref_type", "status", "cached", F.col("replaced_by").isNotNull().alias("new")).count().collect()
    seen = {(r.ref_type, r.status, r.cached, r.new): r["count"] for r in rows}
    assert seen == {("standard", "valid", True, False): 300, ("standard", "replaced", False, True): 2700, ("regulation", "valid", False, False): 150, ("regulation", "unknown", False, False): 150}
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    assert all("year" in line for line in plan if "BroadcastHashJoin" in line)
