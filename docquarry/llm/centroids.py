"""Centroid clustering: exact integer k-means with an equal-average equal-variance search.

Vectors become integers, so that sums, means and distances are exact and the same however the
rows are dealt. For n components of sum S and deviation V (the length of the vector minus its
mean), the squared distance of x and c is at least (S_x - S_c)^2 / n + (V_x - V_c)^2. Centroids
are sorted by S; each vector scans outward from its own S, ends when the first term alone is
beyond the best distance, skips centroids by both, and measures the rest in integers.

A round is one pass over the rows: a task returns a sum for each centroid and component, so
what is shuffled and collected has the size of the centroids, not of the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Components are multiplied by this and cut down to integers.
SCALE = 256
#: Vectors that are searched together.
BLOCK = 8192


def largest(dim: int) -> int:
    """The largest integer component with which every squared distance fits a long."""
    return int((((1 << 63) - 1) / dim) ** 0.5 / 2) - 1


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that are kept, and their integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sized = np.asarray(column.value_lengths().fill_null(-1)) == dim
    at = np.flatnonzero(sized)
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.fill_null(float("nan")), np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * SCALE)
        sound = (np.abs(x) <= largest(dim)).all(1)  # false for what is not a number, too
    return at[sound], x[sound].astype(np.int64)


def _features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of components, deviations, and what the deviations may be off by."""
    sums, f = x.sum(1), x.astype(np.float64)
    squares = (f * f).sum(1)
    spread = squares - sums.astype(np.float64) ** 2 / x.shape[1]
    return sums, np.sqrt(np.maximum(spread, 0)), np.sqrt(squares * 64 * np.finfo(float).eps)


class Search:
    """The nearest of some centroids for many vectors, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        sums, deviations, slack = _features(centroids)
        order = np.argsort(sums, kind="stable")
        self.number, self.centroids = order, centroids[order]
        self.sums, self.deviations, self.slack = sums[order], deviations[order], slack[order]
        #: distances measured, of how many there are
        self.measured = self.possible = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances."""
        parts = [self._block(x[at : at + BLOCK]) for at in range(0, len(x), BLOCK)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, dim = len(x), len(self.centroids), x.shape[1]
        sums, deviations, slack = _features(x)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)
        up = np.searchsorted(self.sums, sums)
        down = up - 1
        alive = np.arange(n)
        self.possible += n * k
        while len(alive):
            lo, hi = down[alive], up[alive]
            below = np.where(lo >= 0, sums[alive] - self.sums[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[alive], np.inf)
            step = np.minimum(below, above)
            # the others are farther from the vector's mean than this one
            going = step**2 / dim * (1 - 1e-12) <= best[alive]
            alive, lower, lo, hi, step = alive[going], (below <= above)[going], lo[going], hi[going], step[going]
            at = np.where(lower, lo, hi)
            down[alive] -= lower
            up[alive] += ~lower
            apart = np.maximum(np.abs(deviations[alive] - self.deviations[at]) - slack[alive] - self.slack[at], 0)
            near = (step**2 / dim + apart**2) * (1 - 1e-12) <= best[alive]
            who, which = alive[near], at[near]
            gap = x[who] - self.centroids[which]
            found, name = np.einsum("ij,ij->i", gap, gap), self.number[which]
            self.measured += len(who)
            better = (found < best[who]) | ((found == best[who]) & (name < number[who]))
            best[who[better]], number[who[better]] = found[better], name[better]
            alive = alive[(down[alive] >= 0) | (up[alive] < k)]
        return number, best


def first_centroids(vectors: DataFrame, k: int, dim: int = 64, seed: int = 2, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The k kept vectors with the smallest sha256 of `seed:key`, in that order.

    Rows without a key start nothing; rows that share a key stand in the order of their vectors."""
    rows = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("hash"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("hash").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x * F.lit(float(SCALE)))) <= largest(dim)))
    found = rows.filter(sound).orderBy("hash", "v").limit(k).toArrow()
    return integers(found.column("v"), dim)[1] if found.num_rows else np.empty((0, dim), np.int64)


def next_centroids(vectors: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> np.ndarray:
    """Every centroid becomes the floor of its vectors' mean; those without vectors stay."""
    k, dim = centroids.shape
    held = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows, whatever the table

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Search(held.value), np.zeros((k, dim), object), np.zeros(k, np.int64)
        for batch in batches:
            x = integers(batch.column(0), dim)[1]
            own = search.nearest(x)[0]
            order = np.argsort(own, kind="stable")
            names, at = np.unique(own[order], return_index=True)
            if len(names):
                total[names] += np.add.reduceat(x[order], at, axis=0)
                count += np.bincount(own, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(used, dim)), "place": pa.array(np.tile(np.arange(dim), len(used))),
            "total": pa.array([str(t) for t in total[used].ravel()], pa.string()), "n": pa.array(np.repeat(count[used], dim)),
        })

    parts = vectors.select(F.col(vector).cast("array<double>")).mapInArrow(sums, "cluster long, place long, total string, n long")
    out = centroids.copy()
    for c, place, total, n in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")), F.sum("n")).collect():
        out[c, place] = int(total) // n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance of each vector that is kept."""
    dim = centroids.shape[1]
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(held.value)
        for batch in batches:
            at, x = integers(batch.column(1), dim)
            number, distance = search.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(number), pa.array(distance)], [key, "cluster", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(rows, f"`{key}` {kind}, cluster long, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Kept are vectors of exactly dim components, none of them null or non-finite, nor so large
    (741,455 for 64 components) that a squared distance wouldn't fit a long. Rows without a key
    belong to clusters but start none. Rows that share a key or a vector count each. With fewer
    than k kept vectors there are as many centroids; without any, no rows. Equal distances go to
    the smaller number. Sums of distances that don't fit a long are null. Other columns are not
    read, whatever their names. The rows are read once for each round, for the start, for the
    sums of distances and for the result."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, dim, seed, key, vector)
    if not len(centroids):
        kind = vectors.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids, vector)
    rows = assigned(vectors, centroids, key, vector)
    inertia = {c: int(d) for c, d in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    about = [(c, fits(inertia.get(c, 0)), whole, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    # one row for each centroid
    table = spark.createDataFrame(about, "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.withColumn("cluster", F.col("cluster").cast("int")).join(F.broadcast(table), F.col("cluster") == F.col("_cluster"))
    return out.select(f"`{key}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
