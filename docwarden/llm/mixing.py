"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus's words are cut into equal blocks. Blocks go to sources by highest quotients target / (2 * seats + 1), then within each source to its
shards (fixed hash parts of about SHARD words; where they are many, to groups of FAN shards first) by highest quotients size / (2 * seats + 1), so
that each shard has an integer quota. A shard
takes its quota from its documents in a seeded order: whole passes first, then a last one that ends within a document.

Only (document, source, size) and the columns of keep are shuffled, text only if it is one of them. A hot source is many shards, each a bounded group. Quotients are ranked only for the few
seats around each proportional share, so their number follows that of sources and shards and not that of blocks.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a source of its own, last in order; a repeated row is a row of
its own (equal rows tie, and are interchangeable); sources without words have target 0; an empty table gives an empty result. Other columns of
the input are kept out; a null doc_id is drawn by its text. One row per source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docwarden.llm.common import SPACED_WORD, Scratch, small

BLOCK = 16
SHARD = 1 << 19
PASSES = 3
#: Claimants of one apportionment below the sources.
FAN = 1024
WEIGHTS = (1, 2, 3)
SEED = 20240229


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source and size (words between white space) of each document, and the columns of keep."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    # A document's place in the seeded order: by its id, by its text where it has none.
    draw = F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), draw.alias("_draw"), *keep)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target: shares of all words by weight, at most PASSES times a source's size, the excess reshared by weight.

    The reshared targets are min(cap, level * weight) for the one level at which they sum to all words. With sources in order of cap / weight, the
    capped ones are a prefix: those that their share of what the earlier ones leave would still exceed."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    cap = PASSES * F.col("source_size")
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    per = per.withColumn("cap", cap).withColumns({
        "words": F.sum("source_size").over(everything),
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    per = per.withColumn("level", F.col("left") / F.col("weights").cast("double")).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # Once a source isn't capped, none after it is; the level of the first such holds for all of them.
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    per = per.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    return per.select("source", "source_size", "target", "words")


def apportioned(shares: DataFrame, group: list[str], share: Column, seats: Column, ties: list[Column]) -> DataFrame:
    """Adds `seats` by highest quotients share / (2 * a + 1) within each group. shares: one row per claimant; seats: how many its group gives.

    A claimant's proportional part of the seats is off by less than half the number of claimants times its own share, plus one; only quotients of
    seats that near to it are ranked."""
    g = W.partitionBy(*group)
    rows = shares.withColumns({"_v": share.cast("double"), "_n": seats.cast("long"), "_tie": F.struct(*ties)}).withColumns({"_sum": F.sum("_v").over(g), "_k": F.count("*").over(g)})
    part = F.when(F.col("_sum") > 0, F.col("_v") / F.col("_sum")).otherwise(F.lit(0.0))
    span = F.ceil(part * F.col("_k") / 2).cast("long") + 2
    rows = rows.withColumn("_sure", F.when(part > 0, F.greatest(F.lit(0).cast("long"), F.floor(part * F.col("_n")).cast("long") - span)).otherwise(F.lit(0).cast("long"))).withColumn("_span", F.when(part > 0, 2 * span + 2).otherwise(F.lit(0)))
    rows = rows.withColumn("_open", F.col("_n") - F.sum("_sure").over(g))
    tried = rows.withColumn("_a", F.explode_outer(F.expr("IF(_span > 0, sequence(_sure, _sure + _span - 1), array())")))
    order = W.partitionBy(*group).orderBy((F.col("_v") / (2 * F.col("_a") + 1)).desc_nulls_last(), "_tie")
    won = (F.row_number().over(order) <= F.col("_open")) & F.col("_a").isNotNull()
    names = [c for c in shares.columns]
    out = tried.withColumn("_won", won.cast("long")).groupBy(*names, "_sure").agg(F.sum("_won").alias("_more"))
    return out.select(*names, (F.col("_sure") + F.col("_more")).alias("seats"))


def mixed(docs: DataFrame, keep: tuple[str, ...] = (), seed: int = SEED, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, the columns of keep, source, size, source_size, target and taken (words that the mix takes of the document, repeats counted)."""
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.cut(measured(docs, keep), "sizes")
    aimed = scratch.cut(targets(sizes), "targets")
    blocks = F.floor(F.col("words") / block)
    quota = scratch.cut(apportioned(aimed, ["words"], F.col("target"), blocks, [F.col("source")]), "quota")
    parts = quota.select("source", "source_size", "target", F.col("seats").alias("source_seats"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("int").alias("shards"))
    same = F.col("source").eqNullSafe(F.col("s"))
    placed = sizes.join(small(parts.withColumnRenamed("source", "s")), same).drop("s")
    draw = F.xxhash64(F.lit(seed), "_draw")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), draw), F.col("shards")).cast("int"))
    # The shards' quotas, by their sizes: level by level, so that no more than FAN claimants meet however many shards a source has.
    held = scratch.cut(placed.groupBy("source", "shard", "source_seats").agg(F.sum("size").alias("shard_size")), "held")
    levels, most = 1, quota.agg(F.max(F.ceil(F.col("source_size") / shard))).first()[0] or 1
    while FAN**levels < most:
        levels += 1
    given = held.select("source", F.lit(0).cast("long").alias("branch"), F.col("source_seats").alias("seats")).distinct()
    for level in range(levels):
        width = FAN ** (levels - 1 - level)
        claims = held.groupBy("source", F.floor(F.col("shard") / width).alias("branch")).agg(F.sum("shard_size").alias("words"))
        claims = claims.join(given.select(F.col("source").alias("s"), F.col("branch").alias("up"), F.col("seats").alias("up_seats")), F.col("source").eqNullSafe(F.col("s")) & (F.floor(F.col("branch") / FAN) == F.col("up"))).drop("s")
        given = apportioned(claims, ["source", "up", "up_seats"], F.col("words"), F.col("up_seats"), [F.col("branch")])
        given = scratch.cut(given.select("source", "branch", "words", "seats"), f"given{level}")
    ranked = scratch.cut(given.select(F.col("source").alias("s"), F.col("branch").cast("int").alias("h"), F.col("words").alias("shard_size"), (F.col("seats") * block).alias("quota")), "shards")
    placed = placed.join(small(ranked), same & (F.col("shard") == F.col("h"))).drop("s", "h")
    # Documents in seeded order, and the words before each.
    order = W.partitionBy("source", "shard").orderBy(draw, "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    quota_words = F.least(F.col("quota"), PASSES * F.col("shard_size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(quota_words / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    last = quota_words - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), last - F.col("before")))
    out = placed.withColumn("before", before).select("doc_id", *keep, "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    scratch.close("sizes", "quota", "shards")
    return out
