"""Connected components: union-find by hooking to the smallest neighbour, as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half step: neighbours move from a node to the smallest that it sees.

    The large step moves larger neighbours, over edges seen from both ends; the small step
    moves smaller ones, seen from the larger end."""
    seen = edges.select(F.col("a").alias("n"), F.col("b").alias("v"))
    if large:
        seen = seen.union(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
    least = seen.groupBy("n").agg(F.least(F.min("v"), F.col("n")).alias("m"))
    moved = seen.join(least, "n")
    if large:
        out = moved.filter("v > n").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _contracted(edges: DataFrame, at_once: int = 100_000) -> DataFrame:
    """Links replaced by those of each node to the smallest that some links of its task reach.

    Union-find runs over a bounded number of links at a time; what they join stays joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= at_once:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)]
        nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
        n = len(ends[0])
        root = list(range(len(nodes)))
        for x, y in zip(place[:n].tolist(), place[n:].tolist(), strict=True):
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)
        for x in range(len(root)):  # roots are smaller, so one pass flattens
            root[x] = root[root[x]]
        to = nodes[np.array(root, np.int64)]
        moved = to != nodes
        return pa.RecordBatch.from_pydict({"a": pa.array(nodes[moved], pa.int64()), "b": pa.array(to[moved], pa.int64())})

    return edges.mapInArrow(run, "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one link upwards, and none that has one is above another."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each node of the links reaches.

    links: its first two columns, integers. Loops and repeated links don't matter; null ends
    are no links; without links there are no rows. Each round is written to the shared folder,
    so lost executors cost no more than a round, and rounds grow with the logarithm of the
    longest chain. Nothing is gathered on the driver but one answer for each round."""
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    edges = settle(_contracted(edges).distinct())
    for _ in range(most_rounds):
        if _are_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        edges = settle(_stars(_stars(edges, True), False))
    raise RuntimeError(f"links aren't joined after {most_rounds} rounds")
