"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary
text. A window that is shorter compressed with the toxic dictionary than with the ordinary one
speaks for toxicity, by as many bytes. Windows are words: a text that insults does so with a
few words among many, and a longer window drowns them in noise (README has the figures). A
constant tail, which both dictionaries hold, follows each window, as zstandard finds no match
in a block's last bytes.

Windows are told apart for training by their contexts, which Spark counts over whole texts. A
text's score comes from how many of its windows pass each margin; the weights of the margins
are fitted on labelled rows that trained neither dictionary (calibrated thresholds)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept, settle, words

#: Labelled rows that are looked at, of each label; the smallest by a hash of the key. Half of
#: them train, half calibrate; all by their whole texts.
SAMPLE = {1: 3000, 0: 6000}
#: Bytes of the dictionaries, and the most windows of each label that train them.
TOXIC_BYTES, ORDINARY_BYTES = 1 << 12, 1 << 14
TOXIC_WINDOWS, ORDINARY_WINDOWS, HARD_WINDOWS = 2_000, 20_000, 1_000
MARGINS = (2, 3, 4, 5, 6)
#: At this level zstandard weighs all matches; lower ones often miss the best.
LEVEL = 19
#: A window that shares no run of so many bytes with the toxic dictionary can't gain by it.
SHARED = 4
#: Distinct contexts in which a window must stand to be a training sample, and how many times more often in toxic text.
CONTEXTS, TIMES = 6, 30
TAIL = b"@#0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ[]"


def windows(text: str | None) -> Iterator[list[bytes]]:
    """The text's words, A-Z lower-cased and stripped of marks at the ends, list by list."""
    for part in words((text or "").encode().lower()):
        yield [w.strip(b".,;:!?\"'()[]{}*#$%&-_") for w in part]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """Dictionary content: what zstandard's trainer selects, then samples that it left out.

    The trainer refuses few or short samples; then the samples alone are the dictionary."""
    try:
        raw = zstandard.train_dictionary(max(256, size // 2), samples * 4).as_bytes()
        content = raw[raw.find(samples[0][:1]) :]
    except (zstandard.ZstdError, IndexError):
        content = b""
    left, room = [], size - len(content)
    for s in samples:
        if s not in content and room >= len(s):
            left.append(s)
            room -= len(s)
    return b"".join(left[::-1]) + content


@dataclass
class Model:
    """Both dictionaries and the weights of the thresholds; a few dozen kilobytes."""

    toxic: bytes
    ordinary: bytes
    weights: list[float]

    def shared_scorer(self) -> Scorer:
        """The process's scorer: later tasks of a worker find the margins of earlier ones."""
        return kept(("scorer", self.toxic, self.ordinary, *self.weights), lambda: Scorer(self))


class Scorer:
    def __init__(self, model: Model, most_known: int = 150_000):
        def make(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)  # or it would be read again for each window
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.toxic, self.ordinary, self.weights = make(model.toxic), make(model.ordinary), np.array(model.weights)
        self.known, self.most = {}, most_known
        self.runs = {model.toxic[i : i + SHARED] for i in range(len(model.toxic) - SHARED + 1)}

    def margin(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        m = self.known.get(window)
        if m is None:
            if len(self.known) >= self.most:
                self.known.clear()
            x, m = b" " + window + b" ", 0
            if any(x[i : i + SHARED] in self.runs for i in range(len(x) - SHARED + 1)):
                m = len(self.ordinary.compress(x + TAIL)) - len(self.toxic.compress(x + TAIL))
            self.known[window] = m
        return m

    def features(self, text: str | None) -> np.ndarray:
        """log2(1 + windows that pass each margin), then log2(1 + windows), then 1."""
        n, passed = 0, Counter()
        for part in windows(text):
            n += len(part)
            for w, k in Counter(part).items():
                m = self.margin(w)
                if m >= MARGINS[0]:
                    passed[min(m, MARGINS[-1])] += k
        at = np.cumsum([passed[m] for m in reversed(MARGINS)])[::-1]
        return np.array([*np.log2(1 + at), np.log2(1 + n), 1.0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, toxic_share: float = 0.25) -> list[float]:
    """Logistic regression by Newton steps; toxic texts have that share of the weight."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum())) * len(y)
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


#: What speaks for nothing: without texts of one of the labels all scores are 0.
NOTHING = Model(b"", b"", [0.0] * (len(MARGINS) + 1) + [-30.0])


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def contexts(rows: DataFrame) -> DataFrame:
    """window, toxic, ordinary: in how many different surroundings each window stands in texts
    of either label (columns label, text). Copies of a text count once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w in filter(None, windows(text.as_py())):
                    n = len(w)
                    yield pa.RecordBatch.from_pydict({"label": pa.array([label] * n, pa.int32()), "before": pa.array([b"", *w[:-1]], pa.binary()), "window": pa.array(w, pa.binary()), "after": pa.array([*w[1:], b""], pa.binary())})

    found = rows.select("label", "text").mapInArrow(cut, "label int, before binary, window binary, after binary").filter("length(window) > 0")
    once = found.select("label", "window", F.xxhash64("before", "after").alias("around")).distinct()
    return once.groupBy("window").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("ordinary"))


def dictionaries(counts: DataFrame, toxic_texts: int) -> Model:
    """Both dictionaries from the windows of contexts(); no weights yet."""
    nt, no = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    least = min(CONTEXTS, max(1, toxic_texts // 8))

    def top(rows: DataFrame, by: str, n: int) -> list[bytes]:
        # equal counts in no order of the texts
        return [b" %b " % bytes(r.window) for r in rows.orderBy(F.col(by).desc(), F.xxhash64("window"), "window").limit(n).select("window").toLocalIterator()]

    telling = (F.col("toxic") >= least) & (F.col("toxic") / max(1, nt) > TIMES * (F.col("ordinary") + 0.5) / max(1, no))
    plain = counts.filter("ordinary > 0")
    model = Model(train_dictionary(top(counts.filter(telling), "toxic", TOXIC_WINDOWS), TOXIC_BYTES), train_dictionary(top(plain, "ordinary", ORDINARY_WINDOWS), ORDINARY_BYTES), [0.0] * (len(MARGINS) + 2))
    # ordinary windows that look toxic so far join the ordinary dictionary
    for _ in range(2):
        margin = _by_scorer(plain, model, "long", lambda s, w: s.margin(bytes(w)))
        more = b"".join(x for x in top(plain.filter(margin("window") >= MARGINS[0]), "ordinary", HARD_WINDOWS) if x not in model.ordinary)
        if not more:
            break
        model = Model(model.toxic, (more + model.ordinary)[-2 * ORDINARY_BYTES :], model.weights)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: dict[int, int] = SAMPLE) -> Model:
    """Fit a model on labelled rows whose crc32(key as text) mod 5 isn't 0.

    At most sample[label] rows of each label are used, by their whole texts: this parameter is
    the bound, whatever the tables' sizes. Rows without key, text or label are passed over;
    equal texts count once in training. Without texts of one label there is nothing to learn,
    and all scores are 0. Only chosen windows and counts come to the driver, never texts."""
    named = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & F.col("_key").isNotNull() & ~held_out(F.col("_key"))).distinct()
    drawn = [named.filter(F.col("_label") == v).withColumn("_rank", F.xxhash64("_key")).orderBy("_rank", "_key").limit(n) for v, n in sample.items()]
    ids = drawn[0].union(drawn[1])
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), F.col("_doc") == F.col("_key")).filter("text is not null")
    # copies of a text train and calibrate together, or neither would be told from the other
    rows = settle(rows.select(F.col("_label").alias("label"), (F.xxhash64("text") % 2 == 0).alias("trains"), "text").repartition(32))
    trains, tells = rows.filter("trains"), rows.filter("not trains")
    some = {(r.label, r.trains): r.n for r in rows.groupBy("label", "trains").agg(F.count("*").alias("n")).collect()}
    if len({v for v, _ in some}) < 2:
        return NOTHING
    if len(some) < 4:  # a handful of texts does both
        trains = tells = rows
    counts = settle(contexts(trains))
    model = dictionaries(counts, some.get((1, True), 0))
    features = _by_scorer(tells, model, "array<double>", lambda s, t: s.features(t))
    got = tells.select("label", features("text").alias("features")).toPandas()
    return Model(model.toxic, model.ordinary, _fit(np.array(got["features"].tolist()), got["label"].to_numpy()))


def _by_scorer(rows: DataFrame, model: Model, kind: str, value):
    """A function of a column: value(scorer, cell) of each."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = held.value.shared_scorer()
        for cells in batches:
            yield pd.Series([value(s, c) for c in cells], dtype=object if kind.startswith("array") else None)

    return run


def score_of(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score of each whole text of docs, 0 to 1; null and empty texts have no windows and
    get the score of such."""
    return _by_scorer(docs, model, "double", lambda s, t: s.score(t))(F.col(text).cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; a row without a key isn't held out.

    Null and empty texts get the score of a text without windows. Repeated rows come back
    repeated, with equal scores. An empty table gives no rows. No text is shuffled, and other
    columns are not read, whatever their names."""
    model = learn(docs, labels, key, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), score_of(docs, model, text).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
