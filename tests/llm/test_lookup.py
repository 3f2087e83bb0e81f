"""Keyed access over a folder of id shards."""

import numpy as np
from pyspark.sql import functions as F

from docquarry.llm import sharding, token_output, tokenizing


def test_lookup_over_all_shards(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.createDataFrame([(n * 3 - 300, f"word{n} and more of it {n % 7}") for n in range(400)] + [(None, "no key"), (300, "another text of key 300"), (600, None)], "doc_id long, text string")
    token_output.write_shards(docs, path, shard_ids=300, partitions=4)
    token_output.write_index(spark, path)
    shards = spark.read.parquet(f"{path}/_index/shards")
    assert shards.count() > 10
    encoder = tokenizing.WordEncoder(tokenizing.tokenizer_path())
    want = {}
    for r in docs.filter("doc_id is not null").withColumn("tie", F.xxhash64("text")).orderBy("doc_id", "tie").collect():
        want.setdefault(r.doc_id, np.frombuffer(encoder.encode(r.text), encoder.dtype).tolist() + [2])
    asked = [*range(-400, 1000), 2**62, -(2**62), None, 300]
    got = token_output.lookup(spark, path, spark.createDataFrame([(k,) for k in asked], "doc_id long")).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), encoder.dtype).tolist() for r in got} == want and len(got) == len(want)
    one = token_output.lookup(spark, path, spark.createDataFrame([(0,)], "doc_id long"))
    assert [r.doc_id for r in one.collect()] == [0]
    assert token_output.lookup(spark, path, spark.createDataFrame([(1,), (None,)], "doc_id long")).count() == 0
    assert {r.doc_id for r in token_output.read_shards(spark, path).collect()} == {*want, None}  # the table beside them is no shard


def test_lookup_in_an_empty_folder(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write_shards(spark.createDataFrame([], "doc_id long, text string"), path)
    token_output.write_index(spark, path)
    assert token_output.lookup(spark, path, spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_shards_read_texts_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = sharding.shard_table(docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # only what was written of them is read
