"""Tables on storage: which files a change touches, and that nothing is lost or counted twice."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from docquarry.operators import library
from docquarry.sources import stored

SCHEMA = "k long, at long, v string"


def files(path):
    return {p.relative_to(path): (p.stat().st_size, p.stat().st_mtime_ns) for p in Path(path).rglob("*.parquet")}


def held(table):
    return {tuple(r) for r in table.rows().collect()}


def test_few_keys_touch_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    fields = spark.createDataFrame([], SCHEMA).schema
    table = stored.BucketedTable(spark, path, fields, ["k"], ["at"], buckets=32, deltas=2)
    rows = spark.range(1000).select("id", F.lit(1), F.col("id").cast("string"))
    table.add(spark.createDataFrame([], fields).union(rows), 0)
    table.merge()
    before = files(f"{path}/base")
    assert len({p.parts[0] for p in before}) == 32 and table.batches() == []
    change = spark.createDataFrame([(n, 2, "new") for n in range(10)] + [(5, 3, "newer"), (6, 0, "old"), (2000, 1, "x")], SCHEMA)
    table.add(change, 1)
    assert files(f"{path}/base") == before and table.batches() == ["1"]
    want = {(n, 1, str(n)) for n in range(10, 1000)} | {(n, 2, "new") for n in range(10)} - {(5, 2, "new")} | {(5, 3, "newer"), (2000, 1, "x")}
    assert held(table) == want
    plan = table.rows(spark.createDataFrame([(7,)], "k long"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    touched = table.merge()
    after = files(f"{path}/base")
    same = {p for p in before if p.parts[0] not in {f"bucket={b}" for b in touched}}
    assert 0 < len(touched) <= 11 and len(same) >= 21 and all(after[p] == before[p] for p in same)
    assert held(table) == want and table.batches() == []


def test_batches_that_are_repeated(spark, tmp_path):
    fields, rnd = spark.createDataFrame([], SCHEMA).schema, random.Random(1)
    table = stored.BucketedTable(spark, str(tmp_path / "t"), fields, ["k"], ["at"], buckets=4, deltas=3)
    want = {}
    for n in range(8):
        rows = [(rnd.randint(0, 20), n * 10 + rnd.randint(0, 9), f"{n}/{i}") for i in range(6)]
        rows = list({(k, at): (k, at, v) for k, at, v in rows}.values())
        for k, at, v in rows:
            want[k] = max(want.get(k, (k, -1, "")), (k, at, v), key=lambda r: r[1])
        for _ in range(2 if n % 3 != 1 else 1):  # some are run twice, also right after a merge
            stored.BucketedTable(spark, str(tmp_path / "t"), fields, ["k"], ["at"], buckets=4, deltas=3).add(spark.createDataFrame(rows, SCHEMA), n)
        assert held(table) == set(want.values())
    assert len(table.batches()) < 3


def test_library_is_kept_by_changes(spark, tmp_path):
    rnd, there = random.Random(2), {}
    kept = stored.Library(spark, str(tmp_path / "lib"), buckets=4, deltas=2)
    for n in range(6):
        rows = [(rnd.choice(["a", "b", "c", "d", None]), 100 * n + i, rnd.randint(1, 4), 100 * n + i, False) for i in range(5)]
        for r in rnd.sample(sorted(there.values(), key=str), len(there) // 2):
            rows.append((*r[:4], True))
        for r in rows:
            there.pop(r[1], None) if r[4] else there.__setitem__(r[1], r)
        kept.change(spark.createDataFrame(rows, "key string, id long, size long, created long, gone boolean"), n)
        if n == 3:
            kept.change(spark.createDataFrame(rows, "key string, id long, size long, created long, gone boolean"), n)
        want = set()
        for k in {r[0] for r in there.values()}:
            own = [r for r in there.values() if r[0] == k]
            best = min(own, key=lambda r: (-r[2], r[3], r[1]))
            want.add((k, best[1], best[2], min(r[3] for r in own)))
        assert {tuple(r) for r in kept.library().collect()} == want


def test_children_of_one_parent_are_replaced(spark, tmp_path):
    path, fields = str(tmp_path / "sections"), "offer string, kind string, title string, n long"
    key, only, order = F.lower("title"), F.col("kind") == "t", [F.col("n")]
    rows = [("a/1", "t", "One", 1), ("a/1", "o", "One", 2), ("b", "t", "Two", 3), ("b", "o", "x", 4), ("c", "t", "Three", 5), (None, "t", "Null", 6)]
    spark.createDataFrame(rows, fields).write.partitionBy("offer").parquet(path)
    before = files(path)
    new = spark.createDataFrame([("b", "t", "ONE", 10), ("b", "t", "New", 11), ("b", "t", "new", 12), ("b", "o", "y", 13), ("d", "t", "three", 14)], fields)
    counts = stored.replace_stored_children(new, path, "offer", key, only, order, spark.createDataFrame([("b",), ("d",), ("a/1",)], "offer string"))
    assert {tuple(r) for r in counts.collect()} == {("b", 3), ("d", 0), ("a/1", 0)}
    after = files(path)
    assert all(after[p] == before[p] for p in before if p.parts[0] in ("offer=c", "offer=__HIVE_DEFAULT_PARTITION__"))
    got = {(r.offer, r.title) for r in spark.read.parquet(path).collect()}
    assert got == {("b", "ONE"), ("b", "New"), ("b", "y"), ("c", "Three"), (None, "Null")}


def test_first_of_a_hot_key_is_an_aggregation(spark):
    rows = spark.range(50_000).select("id", F.lit(None).cast("string").alias("k"), (F.col("id") % 7).alias("o"))
    out = library.first_per_key(rows, ["k"], [-F.col("o"), F.col("id")])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in out._jdf.queryExecution().toString() and [tuple(r) for r in out.collect()] == [(6, None, 6)] and out.columns == ["id", "k", "o"]


def test_arriving_files_have_bounded_rows(spark, data, monkeypatch):
    from docquarry.plans import library

    seen = []
    plain_source = library.jobs.file_source

    def source(spark, path, schema, files):
        seen.append((spark.read.parquet(path).select(F.input_file_name()).distinct().count(), files))
        return plain_source(spark, path, schema, files)

    monkeypatch.setattr(library.jobs, "file_source", source)
    monkeypatch.setattr(library, "FILE_ROWS", 25)
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    got = library.stream_section_ingest(spark, data)
    assert got.count() > 0 and seen[0][0] >= docs / 25 * 0.9 and seen[0][1] >= docs / 50
