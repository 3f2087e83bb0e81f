"""Keyed tables: versions, deduplication, merges, upserts, change logs, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import sorted_join


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order (rising, nulls first). Rows of a null key
    are one group; it is an aggregation, so a hot key is combined before it is shuffled."""
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def best_version(sections: DataFrame, key: Column, text: str, created: list[str]) -> DataFrame:
    """For each key the row with the longest text, the earliest of equally long ones, and
    first_seen, the place of the key's first row: the order of the library.

    It is an aggregation, so rows of a hot key are combined before they are shuffled."""
    order = F.struct(*created)
    rows = sections.withColumn("_key", key).withColumn("_long", F.coalesce(F.length(text), F.lit(0)))
    whole = F.struct(*sections.columns)
    # of the longest the first: lengths fall, places rise
    best = rows.groupBy("_key").agg(F.min_by(whole, F.struct(-F.col("_long"), *created)).alias("b"), F.min(order).alias("first_seen"))
    return best.select(F.col("_key").alias("key"), "b.*", "first_seen")


def dedup_against_library(incoming: DataFrame, library: DataFrame, key: Column, library_key: Column, only: Column, order: list[Column]) -> DataFrame:
    """Rows of one kind (only) whose key the library lacks, the first of each key; others pass.

    The library side is its distinct keys alone."""
    rows = incoming.withColumn("_k", key)
    known = library.select(library_key.alias("_k")).distinct()
    fresh = first_per_key(rows.filter(only).join(known, "_k", "left_anti"), ["_k"], order)
    return fresh.unionByName(rows.filter(~F.coalesce(only, F.lit(False)))).drop("_k")


def prefer_merge(first: DataFrame, second: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of both tables, one for each key; those of the first table win."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return first_per_key(both, key, [F.col("_side"), *order]).drop("_side")


def upsert_latest(base: DataFrame, delta: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """All keys of both tables with their row of the highest version; the delta wins ties."""
    both = base.withColumn("_side", F.lit(0)).unionByName(delta.withColumn("_side", F.lit(1)))
    rest = [c for c in base.columns if c not in key]
    got = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version, "_side")).alias("r"))
    return got.select(*key, "r.*")


def apply_changes(base: DataFrame, log: DataFrame, key: str, fields: list[str], at: list[str]) -> DataFrame:
    """The table after a log of changes: key, op (create, update, delete), fields, order at.

    An update changes the fields that it gives and updated_at; one that gives none is
    refused, and so is one of a key that isn't there. A key that was deleted and created anew
    starts from nothing."""
    given = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])
    start = base.select(key, F.lit("create").alias("op"), *fields, *[F.lit(None).cast(log.schema[a].dataType).alias(a) for a in at], F.lit(0).alias("_log"))
    all_ = start.unionByName(log.select(key, "op", *fields, *at).withColumn("_log", F.lit(1)).filter((F.col("op") != "update") | given))
    w = W.partitionBy(key).orderBy("_log", *at)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    # lives of a key: each creation that follows nothing or a deletion starts one
    all_ = all_.withColumn("_before", F.last(F.when(F.col("op") != "update", F.col("op")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    all_ = all_.withColumn("_life", F.sum(F.when((F.col("op") == "create") & F.coalesce(F.col("_before") != "create", F.lit(True)), 1).otherwise(0)).over(upto))
    all_ = all_.filter("_life > 0")
    wl = W.partitionBy(key, "_life").orderBy("_log", *at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last_life = F.max("_life").over(W.partitionBy(key))
    cols = [F.last(f, ignorenulls=True).over(wl).alias(f) for f in fields]
    out = all_.select(key, "_life", last_life.alias("_last"), *cols, F.last(at[0], ignorenulls=True).over(wl).alias("updated_at"), F.last("op").over(wl).alias("_op"))
    return out.filter("_life = _last and _op <> 'delete'").select(key, *fields, "updated_at").distinct()


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given parents; gone has the column key."""
    return parents.join(gone, key, "left_anti"), children.join(gone.select(F.col(key).alias(child_key)), child_key, "left_anti")


def replace_children(children: DataFrame, new: DataFrame, parent: str, key: Column, only: Column, order: list[Column]) -> DataFrame:
    """The children after the parents in new got new ones, deduplicated against all others."""
    others = children.join(new.select(parent).distinct(), parent, "left_anti")
    return others.unionByName(dedup_against_library(new, others.filter(only), key, key, only, order))


def ttl_split(refs: DataFrame, cache: DataFrame, key: str, now: Column, hours: int = 24) -> DataFrame:
    """refs with state fresh or check: fresh if the cached answer is younger and known.

    cache: key, status, checked_at, one row for each key."""
    age = now.cast("timestamp").cast("double") - F.col("checked_at").cast("timestamp").cast("double")
    fresh = (age < hours * 3600) & (F.col("status") != "unknown")
    return sorted_join(refs, cache.select(key, "status", "checked_at"), key, "left").withColumn("state", F.when(F.coalesce(fresh, F.lit(False)), "fresh").otherwise("check"))


def status_summary(results: DataFrame, status: Column) -> DataFrame:
    """One row: total and counts by status; no status counts as unknown."""
    s = F.coalesce(status, F.lit("unknown"))
    return results.agg(F.count("*").alias("total"), *[F.count_if(s == v).alias(v) for v in ("valid", "withdrawn", "replaced", "under_review", "unknown")])


def category_rollup(items: DataFrame, name: str, order: str, rules: list[tuple[str, str]], other: str, top: int = 5) -> DataFrame:
    """category, ord, n, line: names by the first pattern that they match; the first few are
    listed. Categories are numbered in the order in which they first appear.

    Only top names for each category and task are kept on the way, so hot categories stay small."""
    rule = F.coalesce(*[F.when(F.col(name).rlike(p), F.lit(c)) for p, c in rules], F.lit(other))
    rows = items.select(rule.alias("category"), F.struct(F.col(order).alias("o"), F.col(name).alias("name")).alias("x"))
    n = rows.groupBy("category").agg(F.count("*").alias("n"), F.min("x").alias("first"))
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("category").orderBy("x"))).filter(F.col("_n") <= top)
    names = ranked.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]), ", ").alias("names"))
    out = n.join(names, "category").withColumn("ord", F.row_number().over(W.orderBy("first")))
    more = F.when(F.col("n") > top, " и др.").otherwise("")
    return out.select("category", "ord", "n", F.concat(F.col("ord").cast("string"), F.lit(". "), "category", F.lit(" ("), "names", more, F.lit(")")).alias("line"))


def save_sections(parents: DataFrame, children: DataFrame, parent: str, path: str) -> None:
    """Write parents with their section_count and children with order_index, by section_type.

    Children without an order_index get their place among the parent's children."""
    place = F.row_number().over(W.partitionBy(parent).orderBy(F.col("order_index").asc_nulls_last(), "title")) - 1
    kids = children.withColumn("order_index", F.coalesce("order_index", place))
    counts = kids.groupBy(parent).agg(F.count("*").cast("int").alias("section_count"))
    parents.join(counts, parent, "left").withColumn("section_count", F.coalesce("section_count", F.lit(0))).write.mode("overwrite").parquet(f"{path}/parents")
    kids.write.mode("overwrite").partitionBy("section_type").parquet(f"{path}/sections")


def clear_table(spark, path: str) -> None:
    """Leave an empty table with the same columns; its schema is read before files go."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def augment(items: DataFrame, name: str, order: str, add: list[tuple[str, str, float]]) -> DataFrame:
    """items and each (pattern, name, order) of which no item matches the pattern."""
    seen = items.agg(*[F.max(F.col(name).rlike(p)).alias(f"_{i}") for i, (p, _, _) in enumerate(add)])
    out = items.select(name, F.col(order).cast("double").alias(order))
    for i, (_, text, at) in enumerate(add):
        out = out.unionByName(seen.filter(~F.coalesce(F.col(f"_{i}"), F.lit(False))).select(F.lit(text).alias(name), F.lit(float(at)).alias(order)))
    return out


def assemble_sections(docs: DataFrame, sections: DataFrame, technologies: DataFrame, key: str) -> DataFrame:
    """Sections of other kinds in their order, then the technologies; documents without any
    are one section of kind other. order_index counts from 0."""
    rest = sections.filter("section_type <> 'smr_technology'").select(key, "section_type", "title", "plain_text", F.lit(0).alias("_side"), F.col("order_index").alias("_o"))
    tech = technologies.select(key, F.lit("smr_technology").alias("section_type"), "title", "plain_text", F.lit(1).alias("_side"), F.col("ord").alias("_o"))
    both = rest.unionByName(tech)
    alone = docs.join(both.select(key).distinct(), key, "left_anti").select(key, F.lit("other").alias("section_type"), F.lit("Цялото съдържание").alias("title"), F.left("text", F.lit(500_000)).alias("plain_text"), F.lit(0).alias("_side"), F.lit(0).alias("_o"))
    both = both.unionByName(alone)
    return both.withColumn("order_index", F.row_number().over(W.partitionBy(key).orderBy("_side", "_o")) - 1).drop("_side", "_o")
