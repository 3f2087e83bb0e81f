"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Only vectors with equal labels are compared. Each vector has the cell of its nearest centre
as home and is also copied to each other cell whose border is so near that a partner may lie
beyond it: two vectors of cosine t differ by at most d = sqrt(2 - 2 t), and along the line
between the centres their places differ by at most d |b - a|; so one of the two lies within
half of that of the border. Each pair is thus compared in the home of one of the two, and no
link is lost. Cells are compared in blocks; a block pair returns counts of links and a
spanning forest of them, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import settle
from .graph import components

#: Vectors that fit the centres; a bound whatever the size of the table.
SAMPLE = 20_000
#: Vectors of a cell that are aimed at, most centres of vectors of one length.
CELL, MOST_CELLS = 1000, 1024
#: Vectors of a label below which it is one cell, and bytes of all centres together.
LEAST_CELL, CENTRE_BYTES = 32, 1 << 26
#: Most vectors of a block, and most bytes of it.
BLOCK, BLOCK_BYTES = 8192, 1 << 25


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that no square is too large or too small."""
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k unit centres; an empty cell takes the vector that is farthest from its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = x @ centres.T
        home = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        far = near.max(1).argsort()
        for n, c in enumerate(np.flatnonzero(np.bincount(home, minlength=k) == 0)):
            sums[c] = x[far[n % len(far)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def copied(x: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's home, and for each cell whether the vector has a copy in it."""
    near = x @ centres.T
    home = near.argmax(1)
    gap = near[np.arange(len(x)), home][:, None] - near
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    reach = np.sqrt(2 - 2 * least) / 2 * apart[home] + 1e-9
    out = gap <= reach
    out[np.arange(len(x)), home] = False
    return home, out


def near_links(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal vectors, their links to other classes, and a forest of the links.

    classes: node (a number of its own, as vectors that share a key may be of several classes),
    rep (smallest key), label, v, n; counts: node, links (rows of other classes within the
    cosine); edges: a, b, nodes."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.filter(sound).withColumn("v", F.expr("transform(v, x -> x + 0.0D)"))  # -0.0 is 0.0
    classes = rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))  # written, the numbers stay
    found = _compare(classes.withColumn("dim", F.size("v")), _centres(classes, cell, sample), least, block)
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    return classes, counts, found.filter("b is not null").select("a", "b")


def _centres(classes: DataFrame, cell: int, sample: int) -> dict[int, np.ndarray]:
    """For each length of vectors the centres: at least two, about one for a cell of the largest label.

    Lengths of which no label has LEAST_CELL vectors have none, nor have those whose centres would
    go beyond CENTRE_BYTES: their labels are one cell, which is compared in blocks all the same."""
    sizes = classes.groupBy(F.size("v").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("most"))
    out, held = {}, 0
    # one job for each length of which there are many
    for dim, most in map(tuple, sizes.filter(F.col("most") > min(cell, LEAST_CELL)).orderBy(F.desc("most"), "dim").collect()):
        k = min(MOST_CELLS, max(2, -(-most // cell)))
        held += 8 * k * dim
        if held > CENTRE_BYTES:
            break
        # the bound on the sample is its documented parameter; the rows are the smallest by a hash
        drawn = classes.filter(F.size("v") == dim).select("v", F.xxhash64("rep", "v").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
        x = unit(_matrix(drawn.column(0).combine_chunks(), dim))
        out[dim] = spherical_kmeans(x, min(k, len(x)))
    return out


def _compare(classes: DataFrame, centres: dict[int, np.ndarray], least: float, block: int) -> DataFrame:
    """a, b, links: for each home class and block its links (b null), and edges of forests."""
    held = classes.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():  # vectors of different lengths have no cosine
                yield cells(batch.filter(pa.array(dims == dim)), dim)

    def cells(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        n = batch.num_rows
        home, more = copied(unit(_matrix(batch.column("v"), dim)), held.value[dim], least) if dim in held.value else (np.zeros(n, np.int64), np.zeros((n, 1), bool))
        row, at = np.nonzero(more)
        row, at, guest = np.concatenate((np.arange(n), row)), np.concatenate((home, at)), np.concatenate((np.zeros(n, bool), np.ones(len(row), bool)))
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("dim", "label", "node", "n", "v")), pa.array(at), pa.array(guest), pa.array(home[row])], ["dim", "label", "node", "n", "v", "cell", "guest", "home"])

    kind = classes.schema["label"].dataType.simpleString()
    dealt = settle(classes.select("dim", "label", "node", "n", "v").mapInArrow(deal, f"dim int, label {kind}, node long, n long, v array<double>, cell long, guest boolean, home long"))
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))))
    sizes = dealt.groupBy("dim", "label", "cell").agg(F.count("*").alias("rows")).select("dim", "label", "cell", F.ceil(F.col("rows") / most).alias("blocks"))
    placed = dealt.join(sizes, ["dim", "label", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # block i meets block j >= i: a row goes to each pair that its block is part of; most cells are one block
    several = placed.filter("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = placed.filter("blocks <= 1").withColumn("other", F.col("block")).unionByName(several).drop("blocks")
    jobs = placed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")

    def job(table: pa.Table) -> pa.Table:
        dim, cell, lo, hi = (table.column(c)[0].as_py() for c in ("dim", "cell", "lo", "hi"))
        v, node, n = unit(_matrix(table.column("v").combine_chunks(), dim)), table.column("node").to_numpy(), table.column("n").to_numpy()
        guest, home, own_block = (table.column(c).to_numpy() for c in ("guest", "home", "block"))
        left, right = np.flatnonzero(own_block == lo), np.flatnonzero(own_block == hi)
        has = copied(v, held.value[dim], least)[1] if dim in held.value else np.zeros((len(v), 1), bool)
        links, tree, joined = np.zeros(len(v), np.int64), [], np.arange(len(v))
        for at in range(0, len(left), 512):
            i = left[at : at + 512]
            close = v[i] @ v[right].T >= least
            close &= ~(guest[i][:, None] & guest[right][None, :])
            # where both homes see the pair, the smaller home counts it
            seen = has[i][:, home[right]] & has[right][:, home[i]].T
            close &= ~(seen & (np.minimum(home[i][:, None], home[right][None, :]) != cell))
            if lo == hi:
                close &= i[:, None] < right[None, :]
            links[i] += close @ n[right]
            links[right] += n[i] @ close
            for row in np.flatnonzero(close.any(1)):
                ends = right[close[row]]
                trees, first = np.unique(joined[ends], return_index=True)
                new = trees != joined[i[row]]
                if new.any():  # a link to each tree that the row isn't part of yet
                    tree += [(i[row], e) for e in ends[first[new]]]
                    joined[np.isin(joined, trees)] = joined[i[row]]
        some = np.flatnonzero(links)
        a = [*node[some].tolist(), *[int(node[x]) for x, _ in tree]]
        b = [*[None] * len(some), *[int(node[y]) for _, y in tree]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([*links[some].tolist(), *[0] * len(tree)], pa.int64())})

    return settle(jobs.groupBy("dim", "label", "cell", "lo", "hi").applyInArrow(job, "a long, b long, links long"))


def embedding_dedup(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", **kw) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row. Vectors of any length are compared with
    those of their own.

    Rows whose key, label or vector is null, whose vector is empty or zero or holds a null or
    non-finite component, link with nothing: 0 links, their own key as component, kept. Equal
    vectors are compared once and counted as often as they occur. Rows that share a key are each
    compared by their own vector; their component is the smallest key that its links reach. An empty table gives no
    rows. Other columns are not read, whatever their names."""
    classes, counts, edges = near_links(vectors, least, key, vector, label, **kw)
    found = components(edges)
    named = found.withColumnRenamed("node", "of").join(classes.select("node", "rep"), F.col("of") == F.col("node")).select("of", "component", "rep")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select("of", "least")
    own = classes.join(counts, "node", "left").join(named, F.col("node") == F.col("of"), "left")
    own = own.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "rep").alias("component"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.expr(f"transform(cast(`{vector}` as array<double>), x -> x + 0.0D)").alias("_vec"), F.col(label).alias("_lab"))
    out = rows.join(own, (F.col("_lab") == F.col("_label")) & (F.col("_vec") == F.col("_v")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
