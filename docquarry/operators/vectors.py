"""Vector search: filtered top-k, many queries at once, inverted lists, and fallbacks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null if a vector is missing or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def topk(sections: DataFrame, query: DataFrame, k: int = 3, vector: str = "embedding", key: str = "vec_id", kind: Column | None = None) -> DataFrame:
    """The k rows nearest to the query, which is the one row of column q. A null or zero query
    finds nothing; rows without a vector, or with a zero one, are left out; equally near ones
    come by key. Only k rows a task leave it."""
    rows = sections.filter(F.col(vector).isNotNull())
    rows = rows.filter(kind) if kind is not None else rows
    scored = rows.crossJoin(F.broadcast(query.limit(1).filter("q is not null"))).withColumn("similarity", cosine(F.col(vector), F.col("q")))
    scored = scored.filter(F.col("similarity").isNotNull())
    return scored.orderBy(F.col("similarity").desc_nulls_last(), key).limit(k).drop("q")


#: Query vectors of one block, and bytes of vectors (queries or centres) that are sent to all executors at a time.
BLOCK, MOST_SENT = 2048, 1 << 26
#: Rows that a block of queries is multiplied with at a time: a task's memory is that of BLOCK x ROWS similarities.
ROWS = 512


def topk_batch(queries: DataFrame, sections: DataFrame, k: int = 3, vector: str = "embedding", key: str = "vec_id", query: str = "q_id") -> DataFrame:
    """query, key, similarity, rank: the k nearest rows of each query vector.

    queries: query, q. Blocks of about MOST_SENT bytes of query vectors are sent out, one after the
    other; each task multiplies its rows with them and keeps k for each query, so what is
    shuffled is k rows for each query and task. Vectors are compared with those of their own
    length; null and zero ones have no neighbours."""
    spark = sections.sparkSession
    named = queries.filter("q is not null").select(query, "q")
    parts = max(1, -(-8 * (named.agg(F.sum(F.size("q"))).first()[0] or 0) // MOST_SENT))
    found = None
    for part in range(parts):
        own = named if parts == 1 else named.filter(F.pmod(F.xxhash64(query), F.lit(parts)) == part)
        held = own.toPandas()
        if not len(held):
            continue
        sent = {}
        for dim, own in held.groupby(held["q"].map(len)):
            q = np.array(own["q"].tolist(), np.float64)
            size = np.linalg.norm(q, axis=1)
            sent[dim] = (own[query].to_numpy()[size > 0], q[size > 0] / size[size > 0, None])
        sent = spark.sparkContext.broadcast(sent)
        out = sections.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(_nearest(sent, k, vector, key, query), f"{query} long, {key} long, similarity double")
        found = out if found is None else found.union(out)
    if found is None:
        found = spark.createDataFrame([], f"{query} long, {key} long, similarity double")
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.round("similarity", 12).desc(), key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _nearest(sent, k: int, vector: str, key: str, query: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {dim: (np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)) for dim, (ids, _) in sent.value.items()}
        for pdf in batches:
            for dim, own in pdf.groupby(pdf[vector].map(len)):
                for at in range(0, len(own) if dim in best else 0, ROWS):
                    best[dim] = better(best[dim], sent.value[dim][1], own.iloc[at : at + ROWS])
        for dim, (s, n) in best.items():
            if s.shape[1]:
                yield pd.DataFrame({query: np.repeat(sent.value[dim][0], s.shape[1]), key: n.ravel(), "similarity": s.ravel()})

    def better(best: tuple[np.ndarray, np.ndarray], q: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(rows[vector].tolist(), np.float64)
        size = np.linalg.norm(x, axis=1)
        x, keys = x[size > 0] / size[size > 0, None], rows[key].to_numpy()[size > 0]
        if not len(x) or not len(q):
            return best
        parts = []
        for at in range(0, len(q), BLOCK):
            s = np.concatenate((best[0][at : at + BLOCK], q[at : at + BLOCK] @ x.T), 1)
            n = np.concatenate((best[1][at : at + BLOCK], np.broadcast_to(keys, (len(s), len(keys)))), 1)
            order = np.lexsort((n, -np.round(s, 12)), axis=1)[:, :k]
            parts.append((np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)))
        s, n = (np.concatenate(p) for p in zip(*parts, strict=True))
        return s, n

    return run


def lists_for(rows: int, dim: int = 64) -> int:
    """So many lists that a list has about as many rows as there are lists, but no more than
    MOST_SENT bytes of centres, which every task gets; longer lists are searched in blocks."""
    return max(1, min(round(rows**0.5), MOST_SENT // (8 * max(1, dim))))


def _unit(vector: str) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    return F.when(size > 0, F.transform(vector, lambda v: v.cast("double") / size))


def _ranked(held, most: int):
    """For each unit vector the numbers of the nearest centres, in order: one product for a batch."""

    @F.pandas_udf("array<int>")
    def near(u: pd.Series) -> pd.Series:
        out = [None] * len(u)
        sound = np.flatnonzero([v is not None and len(v) == held.value.shape[1] for v in u])
        for at in range(0, len(sound), 1024):
            own = sound[at : at + 1024]
            order = np.argsort(-(np.stack([np.asarray(u.iloc[i], np.float64) for i in own]) @ held.value.T), axis=1, kind="stable")[:, :most]
            for i, x in zip(own, order.tolist(), strict=True):
                out[i] = x
        return pd.Series(out, dtype=object)

    return near


def assigned(sections: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """sections with list, the nearest centre; null for rows without a vector, or of another length."""
    held = sections.sparkSession.sparkContext.broadcast(centres)
    return sections.withColumn("list", F.get(_ranked(held, 1)(_unit(vector)), F.lit(0)))


def fit_centres(sections: DataFrame, lists: int, vector: str = "embedding", sample: int = 20_000, seed: int = 42) -> np.ndarray:
    """So many unit centres, fitted on a bounded sample: 20,000 rows, or 32 a list where that is more.
    Vectors of the most frequent length count."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = sections.select(_unit(vector).alias("_u")).filter("_u is not null")
    dim = rows.groupBy(F.size("_u").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rows = rows.filter(F.size("_u") == (dim.dim if dim else 0))
    drawn = rows.orderBy(F.xxhash64("_u")).limit(max(sample, 32 * lists)).select(array_to_vector("_u").alias("features")).cache()
    centres = np.array(KMeans(k=lists, seed=seed, maxIter=10).fit(drawn).clusterCenters())
    drawn.unpersist()
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def assign_lists(sections: DataFrame, lists: int, vector: str = "embedding", sample: int = 20_000, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """sections with list, the nearest of so many centres, and the centres (fit_centres())."""
    centres = fit_centres(sections, lists, vector, sample, seed)
    return assigned(sections, centres, vector), centres


class StoredLists:
    """An index on storage: rows in a folder for each batch and list, and the centres beside them.

    It is built once; new rows are assigned to the centres that are there, in a batch of their
    own (a batch that is repeated replaces itself). A search reads the lists that some of its
    queries probe, and no others."""

    def __init__(self, spark, path: str, vector: str = "embedding", key: str = "vec_id"):
        self.spark, self.path, self.vector, self.key = spark, path.rstrip("/"), vector, key

    def build(self, sections: DataFrame, lists: int | None = None) -> StoredLists:
        """Fit centres and write all rows as batch 0; rows without a vector go to no list."""
        if lists is None:
            found = sections.agg(F.count("*"), F.max(F.size(self.vector))).first()
            lists = lists_for(found[0], found[1] or 1)
        centres = fit_centres(sections, lists, self.vector)
        rows = self.spark.createDataFrame([(n, c) for n, c in enumerate(centres.tolist())], "list int, centre array<double>")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        self.add(sections, 0)
        return self

    def centres(self) -> np.ndarray:
        return np.array([r.centre for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()])

    def add(self, sections: DataFrame, batch: int) -> None:
        dealt = assigned(sections, self.centres(), self.vector).repartition("list", F.pmod(F.xxhash64(self.key), F.lit(4)))
        dealt.write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/rows/batch={batch}")

    def rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").drop("batch")

    def search(self, queries: DataFrame, k: int = 3, probes: int = 8, query: str = "q_id") -> DataFrame:
        """As topk_ivf(); of the rows only the lists that are probed are read."""
        centres = self.centres()
        held = self.spark.sparkContext.broadcast(centres)
        wanted = queries.select(F.explode(_ranked(held, probes)(_unit("q"))).alias("list")).distinct()
        # no more numbers than there are lists
        rows = self.rows().filter(F.col("list").isin([r.list for r in wanted.collect()]))
        return topk_ivf(queries, rows, centres, k, probes, self.vector, self.key, query)


#: Queries that the number of probes is fitted on, at most.
FITTED = 512


def fit_probes(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int = 3, recall: float = 0.9, sample: int = FITTED, vector: str = "embedding", key: str = "vec_id", query: str = "q_id") -> tuple[int, float]:
    """The fewest probes with which topk_ivf() finds the share recall of the true k nearest, and
    the share that they find, both measured against topk_batch().

    At most sample queries are measured, the smallest by a hash. Where there are more, the mean
    must be above recall by two standard errors."""
    sound = queries.filter("q is not null")
    drawn = sound.orderBy(F.xxhash64(query), query).limit(sample + 1).select(query, "q").cache()
    all_of_them = drawn.count() <= sample
    exact = topk_batch(drawn.orderBy(F.xxhash64(query), query).limit(sample), indexed, k, vector, key, query).select(query, key)
    near = exact.join(indexed.select(key, "list"), key).groupBy(query).agg(F.collect_list("list").alias("lists"))
    shares = []
    for q, lists in near.join(drawn, query).select("q", "lists").toLocalIterator():
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ np.asarray(q, np.float64)), kind="stable")] = np.arange(len(centres))
        shares.append(np.bincount(place[lists], minlength=len(centres)).cumsum() / len(lists))
    drawn.unpersist()
    if not shares:
        return 1, 1.0
    mean, error = np.mean(shares, 0), 0.0 if all_of_them else np.std(shares, 0) / len(shares) ** 0.5
    probes = int(np.flatnonzero(mean - 2 * error >= recall - 1e-12)[0])  # with all lists the mean is 1
    return probes + 1, float(mean[probes])


def topk_ivf(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int = 3, probes: int = 8, vector: str = "embedding", key: str = "vec_id", query: str = "q_id", block: int = BLOCK) -> DataFrame:
    """As topk_batch(), over the probes nearest lists of each query only.

    The queries and the rows of a list meet in blocks, dealt by hashes of their keys; a pair of
    blocks gives k rows for each query."""
    near = _ranked(queries.sparkSession.sparkContext.broadcast(centres), probes)
    sound = F.exists("q", lambda x: x != 0) & F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x))
    probed = queries.filter(sound).withColumn("list", F.explode(near(_unit("q")))).select("list", F.col(query).cast("long").alias("id"), F.col("q").cast("array<double>").alias("v"))
    rows = indexed.filter("list is not null").select("list", F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = lambda x, name: x.groupBy("list").agg(F.ceil(F.count("*") / block).alias(name))
    sizes = F.broadcast(blocks(probed, "left").join(blocks(rows, "right"), "list"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = probed.join(sizes, "list").withColumn("i", own("left")).withColumn("j", every("right")).select("list", "i", "j", "id", "v")
    right = rows.join(sizes, "list").withColumn("j", own("right")).withColumn("i", every("left")).select("list", "i", "j", "id", "v")
    jobs = left.groupBy("list", "i", "j").cogroup(right.groupBy("list", "i", "j"))
    scored = jobs.applyInArrow(_best_pairs(k, key, query), f"{query} long, {key} long, similarity double")
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.round("similarity", 12).desc(), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best_pairs(k: int, key: str, query: str):
    def unit(t: pa.Table) -> np.ndarray:
        x = np.array(t.column("v").to_pylist(), np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, keys = left.column("id").combine_chunks(), right.column("id").combine_chunks()
        at, to, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(ids) and len(keys):
            s = unit(left) @ unit(right).T
            r = np.round(s, 12)
            # the k-th and all as near as it; then the first k by key
            at, to = np.nonzero(r >= np.partition(r, max(0, len(keys) - k), axis=1)[:, [max(0, len(keys) - k)]])
            order = np.lexsort((keys.fill_null(-(2**63)).to_numpy()[to], -r[at, to], at))
            at, to = at[order], to[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, to = at[first], to[first]
            best = s[at, to]
        return pa.table({query: ids.take(pa.array(at)), key: keys.take(pa.array(to)), "similarity": pa.array(best)})

    return run


def recent(sections: DataFrame, order: list[Column], k: int = 3, kind: Column | None = None) -> DataFrame:
    """The newest k rows with similarity 0.5: what a search gives where vectors are missing."""
    rows = sections.filter(kind) if kind is not None else sections
    return rows.orderBy(*order).limit(k).withColumn("similarity", F.lit(0.5))


def hashing_embedder(dim: int = 64):
    """A deterministic stand-in for a model: counts of hashed words, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            for w in (t or "").lower().split():
                row[zlib.crc32(w.encode()) % dim] += 1.0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed_sections(sections: DataFrame, text: str, embed, most: int = 8000, name: str = "embedding", batch: int = 64) -> DataFrame:
    """sections with a vector from embed(texts), called in batches; blank texts have none, and a
    batch that fails has none either."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), batch):
                part = [t or "" for t in texts.iloc[at : at + batch]]
                try:
                    got = embed([t[:most] for t in part])
                except Exception:
                    got = [None] * len(part)
                out += [v if v and t.strip() else None for v, t in zip(got, part, strict=True)]
            yield pd.Series(out)

    return sections.withColumn(name, run(F.col(text)))


def search_sections(sections: DataFrame, text: DataFrame, embed, order: list[Column], k: int = 3, kind: Column | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k sections nearest to the one text of text (column text), with similarity.

    A blank or null text finds nothing. Where its embedding fails, the newest k by order are
    given instead, with similarity 0.5. kind filters the sections before both."""
    asked = text.limit(1).filter(F.trim("text") != "")
    q = embed_sections(asked.select("text"), "text", embed, name="q").first()
    if q is None:
        return recent(sections, order, 0, kind)
    if q.q is None:
        return recent(sections, order, k, kind)
    held = sections.sparkSession.createDataFrame([(q.q,)], "q array<float>")
    return topk(sections, held, k, vector, key, kind)
