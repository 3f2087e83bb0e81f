"""The stored index: what a search reads, what new rows do, and how much it finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import vectors


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 24)) * 2
    return centre[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")


def test_second_search_reads_probed_lists_only(spark, points, tmp_path):
    rows = frame(spark, points).union(spark.createDataFrame([(9000, None), (9001, [0.0] * 24), (9002, [1.0] * 5)], "vec_id long, embedding array<float>"))
    index = vectors.StoredLists(spark, str(tmp_path / "index")).build(rows, 50)
    assert index.rows().count() == 4003 and index.rows().filter("list is null").count() == 3
    fitted = rows.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    probes, _ = vectors.fit_probes(fitted, index.rows(), index.centres())
    others = rows.filter("vec_id % 40 = 7").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    again = vectors.StoredLists(spark, str(tmp_path / "index"))
    exact = {tuple(r) for r in vectors.topk_batch(others, rows).select("q_id", "vec_id").collect()}
    found = {tuple(r) for r in again.search(others, probes=probes).select("q_id", "vec_id").collect()}
    assert probes < 25 and len(exact & found) >= 0.9 * len(exact) == 0.9 * 300
    one = again.search(others.limit(1), probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [list") + plan.count("PartitionFilters: [isnotnull(list") >= 1
    assert one.count() == 3
    scanned = [f for f in again.rows().filter(F.col("list").isin([1, 2])).inputFiles()]
    assert 0 < len({f for f in scanned if "/list=1/" in f or "/list=2/" in f})


def test_new_rows_are_assigned_to_stored_centres(spark, points, tmp_path):
    index = vectors.StoredLists(spark, str(tmp_path / "index")).build(frame(spark, points[:3000]), 30)
    before = index.centres()
    for _ in range(2):  # repeated after a failure
        index.add(frame(spark, points[3000:], 3000), 1)
    assert (index.centres() == before).all() and index.rows().count() == 4000
    queries = frame(spark, points[3000:3010], 3000).toDF("q_id", "q")
    got = {(r.q_id, r.vec_id) for r in index.search(queries, k=1, probes=1).collect()}
    assert got == {(i, i) for i in range(3000, 3010)}
    every = {(r.q_id, r.vec_id, r.rank) for r in index.search(queries, probes=30).collect()}
    assert every == {(r.q_id, r.vec_id, r.rank) for r in vectors.topk_batch(queries, index.rows()).collect()}


def test_bounds_in_bytes(monkeypatch, spark, points):
    assert vectors.lists_for(10**9, 1536) * 8 * 1536 <= vectors.MOST_SENT and vectors.lists_for(10_000, 64) == 100
    queries, rows = frame(spark, points[:50]).toDF("q_id", "q"), frame(spark, points[:500])
    whole = sorted(tuple(r) for r in vectors.topk_batch(queries, rows).select("q_id", "vec_id", "rank").collect())
    monkeypatch.setattr(vectors, "MOST_SENT", 8 * 24 * 20)
    assert sorted(tuple(r) for r in vectors.topk_batch(queries, rows).select("q_id", "vec_id", "rank").collect()) == whole


def test_a_task_holds_similarities_of_few_rows(points):
    """Memory of the search of many queries grows neither with the batch of rows nor with the queries."""
    import tracemalloc
    from types import SimpleNamespace

    import pandas as pd

    q = points[:2000] / np.linalg.norm(points[:2000], axis=1)[:, None]
    sent = SimpleNamespace(value={24: (np.arange(2000), q)})
    rows = pd.DataFrame({"vec_id": np.arange(4000), "embedding": list(points)})
    tracemalloc.start()
    got = pd.concat(vectors._nearest(sent, 3, "embedding", "vec_id", "q_id")(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # 8000 bytes x 4000 for one array of all similarities of a block, of which there were five
    s = q @ (points / np.linalg.norm(points, axis=1)[:, None]).T
    want = np.argsort(-s, axis=1, kind="stable")[:, :3]
    assert {tuple(x) for x in got[["q_id", "vec_id"]].to_numpy().tolist()} == {(i, int(j)) for i, x in enumerate(want) for j in x}
