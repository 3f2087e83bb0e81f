"""Mixing sources to target weights by temperature, with Spark's own functions only.

A source's token share p becomes p ** t, normalised; t = 1 keeps the shares and t = 0 makes
all sources equal. The exponent is bisected, many points a step, until the weights have a
wanted entropy or no source is repeated more often than allowed. A source's weight times the
budget is its token budget. It is spent on whole passes over the source and on the beginning
of one more, each pass in another order: blocks are permuted by a keyed hash, rows inside a
block as well. Only one block a source is cut; rows are never sorted beyond their block, and
blocks are ranked in ranges of their hash, so no task sees all blocks of a source. Texts are
shuffled once, to their blocks, before rows are repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import settle

#: A block has about this many rows.
BLOCK_ROWS = 256
#: Blocks of a source are ranked in 2 ** RANGE_BITS ranges of their hash.
RANGE_BITS = 12
#: The plan of so many sources is sent to all executors (about 100 bytes each); that of more
#: is joined by shuffle, with SALTS rows for each source.
MOST_SENT, SALTS = 100_000, 64
#: The exponent is found to this many decimals.
DECIMALS = 6
_POINTS = 15


def word_tokens(text: Column) -> Column:
    """Runs without ASCII white space: what a text counts in the mix unless tokens are given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """source, documents, tokens of each source."""
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))


def source_shares(totals: DataFrame) -> DataFrame:
    """source, documents, tokens, share of each source that has tokens."""
    some = totals.filter("tokens > 0")
    return some.crossJoin(F.broadcast(some.agg(F.sum("tokens").alias("_all")))).select("source", "documents", "tokens", (F.col("tokens") / F.col("_all")).alias("share"))


def entropy(shares: DataFrame, exponents: list[float]) -> list[float]:
    """The entropy in bits of the weights at each exponent, in one pass over the sources."""
    s = [F.sum(F.pow("share", F.lit(t))) for t in exponents]
    h = [F.sum(F.pow("share", F.lit(t)) * F.log2("share")) * t for t in exponents]
    row = shares.agg(*[(F.log2(a) - b / a).alias(f"h{i}") for i, (a, b) in enumerate(zip(s, h, strict=True))]).first()
    return [0.0 if x is None else x for x in row]


def repetition(shares: DataFrame, exponents: list[float]) -> list[float]:
    """How often the most repeated source is passed if the least repeated is passed once."""
    low, high = shares.agg(F.min("share"), F.max("share")).first()
    if not low:
        return [1.0] * len(exponents)
    return [max((high / low) ** (1 - t), 1.0) for t in exponents]


def exponent(shares: DataFrame, target_entropy: float | None = None, most_passes: float | None = None) -> float:
    """The exponent between 0 and 1 that meets the target: the largest with at least that
    entropy, or the smallest with at most that many passes. A target out of reach gives the
    nearest end."""
    if (target_entropy is None) == (most_passes is None):
        raise ValueError("there must be one target")
    good = (lambda ts: [h >= target_entropy - 1e-12 for h in entropy(shares, ts)]) if most_passes is None else (lambda ts: [r > most_passes + 1e-12 for r in repetition(shares, ts)])
    # good(t) holds up to some point and not beyond it
    lo, hi = 0.0, 1.0
    ends = good([0.0, 1.0])
    if not ends[0]:
        return 0.0
    if ends[1]:
        return 1.0
    while hi - lo > 10**-DECIMALS / 2:
        points = [lo + (hi - lo) * (i + 1) / (_POINTS + 1) for i in range(_POINTS)]
        held = [p for p, ok in zip(points, good(points), strict=True) if ok]
        lo, hi = (held[-1] if held else lo), next((p for p in points if p > (held[-1] if held else lo)), hi)
    return round(lo if most_passes is None else hi, DECIMALS)


def mixture(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", tokens: str | None = None, target_entropy: float | None = None, most_passes: float | None = None, budget: int | None = None, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs, every row as often as the mix takes it, with what decided it.

    Adds mix_pass (from 1), mix_block and mix_place (the row's block in the permutation of its
    source's pass, and its place in the block, both from 0), mix_tokens, mix_weight (of its
    source). Without a budget the mix is as large as it must be for every source to be passed
    at least once, so no document is lost; with one, it is that many tokens, and sources are
    cut or repeated. The row that crosses a source's budget is still taken.

    A null source is a source of its own. Texts without tokens, null ones too, cost nothing:
    each whole pass takes them. Rows without a key are dealt by their text. Equal rows have a
    place each. An empty table gives no rows. A column of docs that has an added name stays;
    the added one then has underscores before its name."""
    cost = word_tokens(F.col(text)) if tokens is None else F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    # the row's block depends on what it is, not on where it was read
    own = F.xxhash64(F.lit(seed), F.col(key), F.col(text).cast("string"))
    held = [f"c{i}" for i in range(len(docs.columns))]  # names that nothing here has
    rows = docs.select(_name(F.col(source)).alias("source"), cost.alias("n_tokens"), own.alias("own"), *[F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held, strict=True)])
    narrow = settle(rows.drop(*held))  # texts are counted once for all that follows but the rows themselves
    totals = settle(source_totals(narrow))  # a row for each source
    plan = settle(source_plan(totals, exponent(source_shares(totals), target_entropy, most_passes), budget, block_rows))
    blocks = _blocks(_planned(narrow, plan), seed)
    placed = _planned(rows, plan).join(blocks, ["source", "block"])
    placed = placed.select("*", F.explode("ranks").alias("rank")).select("*", F.col("rank.pass").alias("pass"))
    order = W.partitionBy("source", "block", "pass").orderBy(F.xxhash64(F.lit(seed), F.col("pass"), F.col("own")), "own")
    inner = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("inner", inner).withColumn("place", F.row_number().over(order) - 1)
    # of the block where the budget ends, the rows before that point are the first ones
    placed = placed.filter(~F.col("rank.cut") | (F.col("before") + F.col("inner") < F.col("rest")))
    added = {"mix_pass": F.col("pass"), "mix_block": F.col("rank.at"), "mix_place": F.col("place").cast("long"), "mix_tokens": F.col("n_tokens"), "mix_weight": F.col("weight")}
    taken = {c.lower() for c in docs.columns}
    for name in list(added):
        free = name
        while free in taken:
            free = f"_{free}"
        taken.add(free)
        added[free] = added.pop(name)
    return placed.select(*[F.col(h).alias(c) for h, c in zip(held, docs.columns, strict=True)], *[c.alias(n) for n, c in added.items()])


def _name(source: Column) -> Column:
    """The source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def source_plan(totals: DataFrame, t: float, budget: int | None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """source, weight, tokens, budget, passes (whole ones), rest (tokens of one more), blocks."""
    weights = source_shares(totals).withColumn("_w", F.pow("share", F.lit(t)))
    total = weights.agg(F.sum("_w").alias("_sum"), F.max(F.col("tokens") / F.col("_w")).alias("_most"))
    # without a budget: the source that is passed least often is passed once
    whole = F.col("_most") * F.col("_sum") if budget is None else F.lit(float(budget))
    out = weights.crossJoin(F.broadcast(total)).select("source", (F.col("_w") / F.col("_sum")).alias("weight"), F.round(F.col("_w") / F.col("_sum") * whole).cast("long").alias("budget"))
    # sources without a token are passed once, whatever the weights are
    out = totals.join(out, "source", "left")
    passes = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1)
    return out.select(
        "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), "tokens", "budget", passes.cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
        F.greatest(F.ceil(F.col("documents") / block_rows), F.lit(1)).alias("blocks"),
    )


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan and their block."""
    plan = plan.select("source", "weight", "passes", "rest", "blocks")
    if plan.count() <= MOST_SENT:
        out = rows.join(F.broadcast(plan), "source")
    else:
        salted = plan.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        out = rows.withColumn("salt", F.pmod("own", F.lit(SALTS))).join(salted, ["source", "salt"]).drop("salt")
    return out.withColumn("block", F.pmod("own", "blocks"))


def _blocks(narrow: DataFrame, seed: int) -> DataFrame:
    """source, block, before, ranks: of each block the passes that take it, with its rank (at)
    in each and whether the budget ends in it (cut), and the tokens before it in that pass."""
    sums = narrow.groupBy("source", "block", "passes", "rest").agg(F.sum("n_tokens").alias("n"))
    passes = F.expr("explode(sequence(1L, passes + if(rest > 0, 1L, 0L)))")
    runs = sums.filter("passes > 0 or rest > 0").select("source", "block", "n", "rest", (F.col("rest") > 0).alias("ends"), "passes", passes.alias("pass"))
    runs = runs.withColumn("order", F.xxhash64(F.lit(seed), F.col("source"), F.col("pass"), F.col("block"))).withColumn("range", F.shiftright("order", 64 - RANGE_BITS))
    ranges = runs.groupBy("source", "pass", "range").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    outer, inner = W.partitionBy("source", "pass").orderBy("range"), W.partitionBy("source", "pass", "range").orderBy("order", "block")
    ranges = ranges.select("source", "pass", "range", before("n", outer).alias("n_before"), before("m", outer).alias("m_before"))
    runs = runs.join(ranges, ["source", "pass", "range"]).withColumn("before", F.col("n_before") + before("n", inner)).withColumn("at", F.col("m_before") + F.row_number().over(inner) - 1)
    last = F.col("pass") > F.col("passes")
    runs = runs.filter(~last | (F.col("before") < F.col("rest")))
    cut = last & (F.col("before") + F.col("n") > F.col("rest"))
    return settle(runs.groupBy("source", "block").agg(F.max(F.when(last, F.col("before"))).alias("before"), F.collect_list(F.struct("pass", "at", cut.alias("cut"))).alias("ranks")))
