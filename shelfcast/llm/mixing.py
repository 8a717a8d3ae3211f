"""Mixing sources to target weights by highest-averages apportionment of equal token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import running_totals
from shelfcast.session import materialise

# Weights of the sources in order, repeating; most epochs of a source; words in a block; shards.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SHARDS = 24


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, rank, target`` of each source of ``sizes`` (columns source, size).

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. They share the sum of all
    sizes by weight; a target stops at ``epochs`` times its source's size and the excess is shared again
    among the others. In the order of (limit / weight) the stopped sources come first, so the common level
    is that of the first source that stays below its limit.
    """
    per_source = materialise(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")))
    # One row per source from here on.
    ranked = per_source.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    limited = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    level = limited.withColumn("place", F.row_number().over(order)).withColumn(
        "level", left / F.sum("weight").over(from_here))
    below = F.col("limit") > F.col("level") * F.col("weight")
    common = F.min_by(F.when(below, F.col("level")), F.when(below, F.col("place"))).over(everything)
    return level.withColumn("target", F.least("limit", F.coalesce(common * F.col("weight"), F.col("limit")))).select(
        "source", "source_size", "rank", "target")


def block_quotas(targets: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``source, ..., shard, blocks``: whole blocks of each source in each shard.

    The blocks of the first m shards are given out by the highest quotients target / (2 k + 1); since
    that rule never takes a block back when there is one more, the difference of neighbouring m is a
    shard's quota. Only quotients near the rounded shares can decide: beside its rounded share of a
    house, a source gains or loses at most 1.5 times the number of sources, in proportion to its share,
    plus one. Ties go to the earlier source.
    """
    whole = Window.partitionBy()
    houses = (
        targets.withColumn("all_targets", F.sum("target").over(whole))
        .withColumn("sources", F.count(F.lit(1)).over(whole))
        .filter("target > 0")
        .withColumn("house", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("seats", F.floor(F.floor(F.col("all_targets") / block) * F.col("house") / shards))
        .withColumn("share", F.col("target") / F.col("all_targets"))
        .withColumn("rounded", F.floor(F.col("share") * F.col("seats") + 0.5))
        .withColumn("reach", F.ceil(1.5 * F.col("share") * F.col("sources")) + 2)
        .withColumn("sure", F.greatest(F.col("rounded") - F.col("reach"), F.lit(0))))
    open_seats = houses.withColumn("left", F.col("seats") - F.sum("sure").over(Window.partitionBy("house"))).withColumn(
        "k", F.explode(F.sequence(F.col("sure"), F.col("rounded") + F.col("reach"))))
    best = Window.partitionBy("house").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "rank")
    won = F.col("place") <= F.col("left")
    given = open_seats.withColumn("place", F.row_number().over(best)).groupBy("rank", "house").agg(
        (F.max("sure") + F.count_if(won)).alias("upto"))
    before = Window.partitionBy("rank").orderBy("house")
    quotas = given.select(
        "rank", (F.col("house") - 1).alias("shard"),
        (F.col("upto") - F.coalesce(F.lag("upto").over(before), F.lit(0))).cast("bigint").alias("blocks"))
    return targets.join(F.broadcast(quotas), "rank")  # shards rows per source


def mix(
    docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS, shards: int = SHARDS,
) -> DataFrame:
    """``key, size, source, source_size, target, blocks, taken`` for each document.

    Each source lays its documents in a seeded order, cut into blocks of ``block`` words. Its quota takes
    whole passes over the source, then the first blocks of the order, so at most one document per source
    is taken in part, and no source more than ``epochs`` times. ``taken`` counts repeats. The order is
    that of an MD5 of seed and key, then key and size, so reruns agree; rows equal in all are alike. Null
    sources form one source; documents without words take part with 0; an empty table gives no rows. A
    source's documents are ordered by global prefix sums, so a source may hold any share of the rows.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"))
    placed, _ = running_totals(sized.withColumn("draw", draw), ["source", "draw", "key", "size"], {"before": "size"})
    placed = materialise(placed)
    targets = materialise(source_targets(placed, weights, epochs))
    quotas = block_quotas(targets, block, shards).groupBy("rank").agg(F.sum("blocks").alias("blocks"))
    starts = placed.groupBy("source").agg(F.min("before").alias("start"))
    plan = (
        targets.join(quotas, "rank", "left").fillna(0, ["blocks"])
        .join(starts, targets["source"].eqNullSafe(starts["source"])).drop(starts["source"])
        .withColumn("run", F.least(F.col("blocks") * block, F.col("source_size") * epochs).cast("bigint"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("run div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("run") - F.col("passes") * F.col("source_size")))
    plan = materialise(plan.withColumnRenamed("source", "own"))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["own"]))
    at = F.col("before") - F.col("start")
    part = F.greatest(F.lit(0), F.least(F.col("rest") - at, F.col("size")))
    return joined.select(
        F.col("key").alias(key), "size", "source", "source_size", "target", "blocks",
        (F.col("passes") * F.col("size") + part).cast("bigint").alias("taken"))
