"""A training corpus from raw documents: five operators, each stage written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from docquarry.llm import decontaminate, minhash_dedup, mixing, token_output, toxicity
from docquarry.llm.common import settle, table
from docquarry.llm.queries import MOST_PASSES


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, all their columns as they are.

    Null and empty texts have no window that speaks for toxicity and stay; rows without a key
    are scored by their text like all others; repeated rows share their fate; without labels of
    both kinds nothing is rejected; an empty table stays empty."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_of(docs, model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest key.

    Rows that share a key are one document: of those that stay as the first of their groups, one
    stays, the first by its text's and then by its row's hash; a row whose text is a near copy
    of another key's goes, whatever else its key has. Rows without a key link with nothing and
    all stay, as do texts that are null or without words, once for each key. An empty table
    stays empty."""
    near = minhash_dedup.near_duplicates(docs).filter("kept and doc_id is not null")
    # one text for each key, and how many rows have just it
    near = settle(near.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.min(F.struct("text_key", "n")).alias("first")).select("doc_id", "first.*"))
    found = docs.join(near, (docs["doc_id"] == near["doc_id"]) & (F.xxhash64(docs["text"]) == near["text_key"]), "left_semi")
    if near.filter("n > 1").limit(1).count():
        # only then are rows brought together by key; the columns travel as one
        rows = found.select(F.struct("*").alias("row"), F.xxhash64("*").alias("hash"))
        first = F.row_number().over(W.partitionBy("row.doc_id").orderBy("hash"))
        found = rows.withColumn("n", first).filter("n = 1").select("row.*")
    return found.unionByName(docs.filter("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, all their columns as they are.

    Null and empty texts hold none; rows without a key and repeated rows are looked at each by
    itself; without benchmark items all stay; an empty table stays empty."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to MOST_PASSES times.

    A null source is a source of its own; texts without words cost nothing and are taken in
    each whole pass; rows without a key and repeated rows are taken like others; columns of any
    name pass through; an empty table stays empty."""
    return mixing.mixture(docs, most_passes=MOST_PASSES).select(*[F.col(f"`{c}`") for c in docs.columns])


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row of the mix, as the shard files have them.

    Null texts count as empty; rows without a key come first; rows that share a key, as the
    mix makes them, stand beside each other; an empty table gives no rows."""
    return token_output.token_output(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token_output", write_ids)]

#: Compression lengths and a tokenizer's ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
