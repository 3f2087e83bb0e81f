"""Exact clustering against a plain version in integers of any size."""

import hashlib
import random

import numpy as np
import pytest

from docquarry.llm import centroids


def plain(rows, k, rounds, dim=64, seed=2):
    """Everything by its definition, one vector and one centroid at a time."""
    limit = centroids.largest(dim)
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(256 * x)) for x in v]
            if max(map(abs, whole)) <= limit:
                kept.append((key, whole))
    first = sorted((hashlib.sha256(f"{seed}:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)[:k]
    found = [v for _, v in first]
    if not found:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(found))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(found)):
            of = [v for (_, v), o in zip(kept, own) if o == n]
            if of:
                found[n] = [sum(x) // len(of) for x in zip(*of)]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, n in last if n == c) for c in range(len(found))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return sorted((str(key), n, d, inertia[n], sum(inertia), sha[n]) for (key, _), (d, n) in zip(kept, last))


def got(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_search_is_exact():
    rng = np.random.default_rng(3)
    for k, size in ((1, 3), (7, 300), (40, 40), (90, 2)):
        x = rng.integers(-size, size + 1, (2000, 8))
        c = rng.integers(-size, size + 1, (k, 8))
        c[k // 2] = c[0]  # a tie for every vector that is nearest to it
        search = centroids.Search(c)
        number, distance = search.nearest(x)
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (distance == full.min(1)).all() and (number == full.argmin(1)).all()
    clear = centroids.Search(np.arange(400).reshape(-1, 1) * np.ones((1, 8), np.int64))
    clear.nearest(rng.integers(0, 400, (500, 8)))
    assert clear.measured < 0.2 * clear.possible


def test_large_components_are_exact():
    most, dim = centroids.largest(4), 4
    x = np.array([[most] * dim, [-most] * dim, [most - 1] * dim, [0, most, -most, 1]])
    number, distance = centroids.Search(x[1:]).nearest(x)
    full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in x[1:]] for v in x]
    assert distance.tolist() == [min(f) for f in full] and number.tolist() == [f.index(min(f)) for f in full]


@pytest.mark.parametrize("k", [3, 40])
def test_clusters_as_plain(spark, k):
    rnd = random.Random(k)
    rows = [(i % 150, [rnd.choice([-0.3, 0.0, 0.25, rnd.random()]) for _ in range(64)]) for i in range(160)]
    rows += [(None, rows[0][1]), (200, rows[1][1]), (201, rows[1][1]), (202, None), (203, []), (204, [1.0] * 63), (205, [1.0] * 65)]
    rows += [(206, [float("nan")] + [0.0] * 63), (207, [float("inf")] * 64), (208, [None] + [0.0] * 63), (209, [1e30] * 64), (210, [700_000.0] * 64), (211, [-0.0] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, _cluster int").repartition(5)
    assert got(centroids.centroid_clusters(df, k, 3)) == plain(rows, k, 3)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [3.0, 3.0])], "vec_id long, embedding array<float>")
    assert got(centroids.centroid_clusters(df, 40, 2, dim=2)) == plain([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [3.0, 3.0])], 40, 2, dim=2)
    assert centroids.centroid_clusters(df).count() == 0  # no vector of 64
    assert centroids.centroid_clusters(df.limit(0), dim=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
