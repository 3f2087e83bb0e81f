"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

Each distinct word shingle ranks all places of a signature by a permutation of its own; the
place's value is the rank and a random part, and the least value over all shingles stays. The
ranks of one shingle are correlated, which lowers the variance, and a shingle stops as soon
as its rank is above all values held. Work is by ranks: all shingles of many documents take
their first rank together, then those of documents with a place still open their second.

Documents with equal shingle sets are one class. A class meets the first class of each bucket
of its bands, and these pairs are confirmed on the full shingle sets. Where their links don't
join a bucket, its classes are compared by their signatures, in blocks; those alike enough to
be candidates make clusters, and the classes of a cluster are compared on their full sets, in
blocks as well. Jobs return spanning forests, so no stage makes more rows than it reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ANY_WORD, LOWER, forget, mix, settle, text_words
from .graph import components

SHINGLE, LEAST = 5, 75
#: Bands and rows. A pair of similarity 0.75 has no equal band with probability 5e-6.
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Shingles whose permutations are held at a time.
AT_ONCE = 1 << 17
#: Of 128 places, a pair of similarity 0.75 agrees in 96 on average; in fewer than 70 with a
#: probability below 2e-7 (of independent places; those of one permutation vary less).
LEAST_PLACES = 70
#: Signatures of a bucket that one job holds (128 bytes each), twice so many where two blocks meet.
BLOCK = 8192
#: Bytes of the shingle sets of a cluster that one job holds, twice so many where two blocks meet.
SET_BYTES = 1 << 25
#: So many document ids are sent to all executors (8 bytes each); more are joined by shuffle.
MOST_SENT = 500_000


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles; of all its words if fewer."""
    w = text_words((text or "").encode(), ANY_WORD, LOWER)
    n = len(w) - k + 1
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        if n < 1:
            h = np.zeros(1, np.uint64)
            for x in w:
                h = mix(h * np.uint64(31) + x, len(w))
            return h
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(31) + w[i : i + n])
    return np.unique(h)


def superminhash(shingles: np.ndarray, owner: np.ndarray, docs: int, places: int = PLACES) -> np.ndarray:
    """docs x places signatures. owner: the document of each shingle, ascending.

    A value holds the rank in its upper 8 bits and the random part below."""
    out = np.full((docs, places), ~np.uint64(0))
    flat = out.reshape(-1)
    order, low = None, np.uint64((1 << 56) - 1)
    for rank in range(places):
        value = (mix(shingles, 2 * rank + 2) & low) | np.uint64(rank << 56)
        pick = (mix(shingles, 2 * rank + 3) >> np.uint64(33)).astype(np.int64) % (places - rank)
        if order is None and rank:
            order = np.tile(np.arange(places, dtype=np.uint8), (len(shingles), 1))
            _swap(order, 0, first)  # noqa: F821  set in the round before
        if rank:
            place = _swap(order, rank, pick + rank)
        else:
            place = first = pick
        np.minimum.at(flat, owner * places + place, value)
        # open: documents where a later rank can still lower a value
        open_ = (out >> np.uint64(56)).max(1) > rank
        if not open_.any():
            break
        keep = open_[owner]
        if not keep.all():
            shingles, owner = shingles[keep], owner[keep]
            if order is not None:
                order = order[keep]
            elif not rank:
                first = first[keep]
    return out


def _swap(order: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """One step of each row's shuffle: the place that comes i-th."""
    rows = np.arange(len(order))
    got = order[rows, j].copy()
    order[rows, j] = order[:, i]
    order[:, i] = got
    return got.astype(np.int64)


def _sign(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x bands) and one byte of each place (documents x places)."""
    size = np.array([len(s) for s in sets])
    sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets), bands * rows)
    h = np.zeros((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * np.uint64(31) + sig[:, r::rows])
        h = mix(h + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64), (mix(sig) >> np.uint64(56)).astype(np.uint8)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (128 bits; null for the empty set), bands, places."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, sets, held = [], [], 0
            for at in range(batch.num_rows):
                s = shingle_set(batch.column(2)[at].as_py(), k)
                ids.append((batch.column(0)[at].as_py(), batch.column(1)[at].as_py()))
                sets.append(s)
                held += len(s)
                if held > AT_ONCE or len(ids) == 1000:
                    yield answer(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield answer(ids, sets)

    def answer(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        some = [n for n, s in enumerate(sets) if len(s)]
        keys, band, place = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if some:
            b, p = _sign([sets[n] for n in some], bands, rows)
            for row, n in enumerate(some):
                keys[n], band[n], place[n] = xxhash.xxh3_128_digest(sets[n].tobytes()), b[row], p[row].tobytes()
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([i for i, _ in ids], pa.int64()), "text_key": pa.array([t for _, t in ids], pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_key": pa.array(keys, pa.binary()),
            "bands": pa.array(band, pa.list_(pa.int64())), "places": pa.array(place, pa.binary()),
        })

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(sign, "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, places binary")


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """node, held: the full shingle set of each node, from a text of its class."""
    wanted = settle(nodes.join(classes.select("node", "doc_id", "set_key"), "node"))
    ids = wanted.select("doc_id").distinct()
    few = wanted.count() <= MOST_SENT
    docs = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = [shingle_set(t, k).tobytes() for t in batch.column(0).slice(at, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in found], pa.binary()), pa.array(found, pa.binary())], ["set_key", "held"])

    # rows that share a key may differ in their texts: the set's own key tells which is meant
    made = docs.select("text").mapInArrow(sets, "set_key binary, held binary")
    made = made.join(F.broadcast(wanted.select("set_key", "node")) if few else wanted.select("set_key", "node"), "set_key")
    return settle(made.select("node", "held").dropDuplicates(["node"]))


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, least: int = LEAST, k: int = SHINGLE) -> DataFrame:
    """Those pairs a, b of nodes whose full shingle sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b, ok = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for n, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                if a[n] != last:
                    last, left = a[n], np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(left) + len(right) - len(np.unique(np.concatenate((left, right))))
                ok.append(100 * both >= least * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    made = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs, k)
    both = pairs.join(made.select(F.col("node").alias("b"), F.col("held").alias("y")), "b").join(made.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _in_jobs(rows: DataFrame, group: str, size: str, block: int, work: Callable[[pa.Table, bool], list[tuple[int, int]]]) -> DataFrame:
    """a, b: what work finds in the rows of each group, in blocks.

    A group is cut in as many blocks as its sum of size needs. Each block meets itself and each
    other block in a job; work gets the job's rows and whether only pairs across blocks count."""
    sizes = rows.groupBy(group).agg(F.ceil(F.sum(size) / block).alias("blocks"))
    placed = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # most groups are one block, which needs no copies
    several = placed.filter("blocks > 1").withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    placed = placed.filter("blocks <= 1").withColumn("other", F.col("block")).unionByName(several)
    jobs = placed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (group, "lo", "hi")])
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0).any(0)) + 1, [batch.num_rows]))
            found = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and tuple(key[:, a]) != last:
                    found += answer(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(key[:, a])
            yield pairs(found)
        if held:
            yield pairs(answer(held))

    def answer(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(held).combine_chunks()
        return work(t, t.column("lo")[0].as_py() != t.column("hi")[0].as_py())

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    dealt = jobs.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


def _rows_outside(comp: np.ndarray) -> np.ndarray:
    """The rows that aren't of the largest component: one end of each pair across components is such a row."""
    of, at, n = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(at != n.argmax())


def alike(node: np.ndarray, n: np.ndarray, comp: np.ndarray, places: np.ndarray, block: np.ndarray | None, least: int = LEAST) -> list[tuple[int, int]]:
    """A forest over the nodes that joins all pairs of different components, of different
    blocks if there are blocks, whose signatures agree enough for a pair of that similarity."""
    cluster, out = np.arange(len(node)), []
    enough = LEAST_PLACES * places.shape[1] / PLACES
    for i in _rows_outside(comp):
        # a pair within a cluster will meet anyway
        near = (cluster != cluster[i]) & (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= least * np.maximum(n, n[i]))
        if block is not None:
            near &= block != block[i]
        j = np.flatnonzero(near)
        j = j[(places[j] == places[i]).sum(1) >= enough] if len(j) else j
        if len(j):
            joined, first = np.unique(cluster[j], return_index=True)
            out += [(int(node[i]), int(node[x])) for x in j[first]]
            cluster[np.isin(cluster, joined)] = cluster[i]
    return out


def linked(sets: list[np.ndarray], comp: np.ndarray, block: np.ndarray | None, least: int = LEAST) -> list[tuple[int, int]]:
    """Pairs of rows that join all components between which there is a link, by full sets.

    Two similar sets share one of their rarest elements: of n elements at most n less the least
    overlap can be missing in the other. Rows that share none of these aren't looked at."""
    n = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(n)))
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    word = rank[word]
    owner = np.repeat(np.arange(len(sets)), n)
    word = word[np.lexsort((word, owner))]  # each set from its rarest element on
    prefix = n - -(-least * n // 100) + 1
    rare = np.arange(len(word)) - start[owner] < prefix[owner]
    order = np.argsort(word[rare], kind="stable")
    post, by = owner[rare][order], word[rare][order]
    lo, hi = np.searchsorted(by, np.arange(len(count))), np.searchsorted(by, np.arange(len(count)), "right")
    comp, out, mark = np.unique(comp, return_inverse=True)[1], [], np.zeros(len(count), bool)
    outside = _rows_outside(comp)
    is_outside = np.zeros(len(sets), bool)
    is_outside[outside] = True
    for i in outside:
        own = word[start[i] : start[i + 1]]
        # rows beside it of which one link after the other is looked for, until all are of its component
        lists = [post[lo[w] : hi[w]] for w in own[: prefix[i]] if hi[w] - lo[w] > 1]
        if not lists:
            continue
        j = np.unique(np.concatenate(lists))
        j = j[(comp[j] != comp[i]) & (~is_outside[j] | (j > i)) & (100 * np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))]
        if block is not None:
            j = j[block[j] != block[i]]
        mark[own] = True
        while len(j):
            now, j = j[:2048], j[2048:]
            at = np.concatenate(([0], np.cumsum(n[now])[:-1]))
            where = np.repeat(start[now] - at, n[now]) + np.arange(n[now].sum())
            both = np.add.reduceat(mark[word[where]].astype(np.int64), at)
            good = now[100 * both >= least * (n[now] + n[i] - both)]
            for x in good:
                if comp[x] != comp[i]:
                    out.append((int(i), int(x)))
                    comp[comp == comp[x]] = comp[i]
            j = j[comp[j] != comp[i]]
        mark[own] = False
    return out


def _open_links(met: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, least: int, k: int, block: int, set_bytes: int) -> DataFrame:
    """Links between classes of one bucket that are of different components so far."""
    seen = met.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    open_ = seen.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    members = seen.join(open_, "bucket").join(classes.select("node", "places"), "node").withColumn("one", F.lit(1))

    def compare(t: pa.Table, across: bool) -> list[tuple[int, int]]:
        if t.num_rows < 2:
            return []
        node, n, comp, blk = (t.column(c).to_numpy() for c in ("node", "n_shingles", "component", "block"))
        places = np.frombuffer(b"".join(t.column("places").to_pylist()), np.uint8).reshape(len(node), -1)
        return alike(node, n, comp, places, blk if across else None, least)

    clusters = components(settle(_in_jobs(members, "bucket", "one", block, compare).distinct())).withColumnRenamed("component", "cluster")
    clusters = settle(clusters.join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "cluster", F.coalesce("component", "node").alias("component")))
    held = clusters.join(_sets(clusters.select("node"), classes, docs, k), "node").withColumn("bytes", F.octet_length("held"))

    def compare_sets(t: pa.Table, across: bool) -> list[tuple[int, int]]:
        if t.num_rows < 2:
            return []
        node, comp, blk = (t.column(c).to_numpy() for c in ("node", "component", "block"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("held")]
        return [(int(node[x]), int(node[y])) for x, y in linked(sets, comp, blk if across else None, least)]

    return settle(_in_jobs(held, "cluster", "bytes", set_bytes, compare_sets))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE, block: int = BLOCK, set_bytes: int = SET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text) for each row.

    Documents without words or text have no shingles and link with nothing. Rows that share a
    key are each compared by their own text; those with equal texts keep together. A row
    without a key links with nothing, has no component and is kept. Repeated rows come back
    repeated. Other columns are not read. An empty table gives no rows."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = settle(signatures(docs, bands, rows, k))
    classes = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "places")).alias("c"))
    # nodes are numbers of their own, as one key may have texts of several classes; written, they stay
    classes = settle(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "c.*"))
    placed = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    first_of = placed.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("first"), F.count("*").alias("members")).filter("members > 1")
    met = settle(placed.join(first_of.select("bucket", "members", F.col("first.node").alias("first"), F.col("first.n_shingles").alias("first_n")), "bucket"))
    sized = 100 * F.least("n_shingles", "first_n") >= least * F.greatest("n_shingles", "first_n")
    pairs = settle(met.filter(sized & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    links = settle(confirm(pairs, classes, docs, least, k))
    more = _open_links(met.filter("members > 2"), components(links), classes, docs, least, k, block, set_bytes)
    found = components(links.union(more))
    ids = found.join(classes.select("node", "doc_id"), "node")
    ids = ids.join(ids.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select(F.col("node").alias("of"), "component_id")
    of = classes.select("set_key", "node", "doc_id").join(ids, F.col("node") == F.col("of"), "left").select(F.col("set_key").alias("class_key"), F.coalesce("component_id", "doc_id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key", "text_key").join(of, (F.col("set_key") == F.col("class_key")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")
