"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, centroids, conversation_repair, decontaminate, embedding_dedup, minhash_dedup, mixing, oracles, pii, sharding, token_counts, token_output, toxicity, warc
from .common import table

#: The pseudonyms' key; a real run takes its own.
PII_KEY = "document-pseudonyms"
#: No source is repeated more often than this.
MOST_PASSES = 2.0


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of documents and benchmark items. Null texts overlap with nothing; rows come as
    contamination() states."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all pages, read back from archives. A null html is an empty payload."""
    return warc.page_digests(table(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, how many values were replaced, and by what. A null text stays
    null, with 0 values."""
    docs = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    changed = F.expr("filter(values, v -> v.value <> v.pseudonym)")
    return docs.select("doc_id", "text", F.size(changed).cast("long").alias("n_replaced"), F.array_join(F.transform(changed, lambda v: v["pseudonym"]), "|").alias("pseudonyms"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by their key. A null key counts as 0, a null text as empty."""
    return sharding.shard_table(table(spark, sf_dir, "documents"), 8)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids in the shard files. A null text is empty."""
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document; null and empty texts have that of a text without windows."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document; null and empty texts link with nothing."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector; null and zero vectors link with nothing."""
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the mix takes each document, small sources up to MOST_PASSES times. A null source is
    one of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixture(docs, most_passes=MOST_PASSES).drop("text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths; null and empty texts have length 0."""
    return token_counts.length_histogram(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to. A null text is empty."""
    return byte_bpe.byte_bpe_digests(table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each vector of 64 sound components, after 5 rounds with 40 centroids."""
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each damaged conversation, and its cheapest repair. Nulls are one space."""
    return conversation_repair.repaired(conversation_repair.damaged(table(spark, sf_dir, "conversations")), gone="gone")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents; its stages state their cases."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    out = {f.__name__: f for f in (op1_decontamination, op2_warc, op3_pii, op4_sharding, op5_token_output, op6_toxicity, op7_minhash_dedup, op8_embedding_dedup, op9_mixing, op10_token_counts, op11_byte_bpe, op12_centroid_clusters, op13_conversation_repair)}
    return out | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
