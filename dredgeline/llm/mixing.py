"""Mixing sources to target shares, by hash thresholds found from nested histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Bits of the hash, and of it those of one histogram: 4,096 buckets a source, 5 histograms one inside the other.
BITS, STEP = 60, 12


def mixing_plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``(source, weight, max_repeats, available, budget, whole, rest)`` of each target source.

    The weights of sources that have any size are scaled to add up to 1. ``total`` is the size of the mixture; if None,
    the largest at which every such source reaches its share within its repeats. A source that cannot reach its share
    of a given ``total`` gives all that its repeats allow. ``whole`` is how often all its records are used, ``rest`` the size
    still wanted.
    """
    have = sized.groupBy("source").agg(F.sum("size").alias("available"))
    plan = targets.select("source", F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("long").alias("max_repeats")).dropna().where(
        (F.col("weight") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    plan = written(plan.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))), "targets")
    usable = plan.where(F.col("available") > 0)
    scale, most = usable.agg(F.sum("weight"), F.min(F.col("max_repeats") * F.col("available") / F.col("weight"))).first()
    size = float(total) if total is not None else (most or 0.0) * (scale or 1.0)
    budget = F.least(F.floor(F.lit(size) * F.col("weight") / F.lit(scale or 1.0) + 1e-6).cast("long"), F.col("max_repeats") * F.col("available"))
    plan = plan.withColumn("budget", F.when(F.col("available") > 0, budget).otherwise(F.lit(0)))
    whole = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("long")
    return plan.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("available"))


def _thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``(source, threshold)``: the records of a source with a smaller hash come as near to its ``rest`` as whole records can.

    Each histogram looks only into the bucket in which the budget ended in the one before; the last bucket holds one
    hash, and belongs to the mixture if the budget is nearer with it.
    """
    state = plan.where(F.col("rest") > 0).select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(BITS // STEP):
        shift = BITS - STEP * (level + 1)
        inside = sized.join(state, "source").where(F.shiftright("hash", shift + STEP) == F.col("prefix"))
        buckets = inside.groupBy("source", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        over = buckets.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        first = F.min(F.struct("bucket", (F.col("left") - F.col("upto") + F.col("size")).alias("left"), "size")).alias("b")
        state = written(over.groupBy("source").agg(first).select("source", F.col("b.left").alias("left"), F.col("b.bucket").alias("prefix"), F.col("b.size").alias("size")), "boundary")
        last, state = state, state.drop("size")
    return last.select("source", (F.col("prefix") + F.when(2 * F.col("left") > F.col("size"), 1).otherwise(0)).alias("threshold"))


def mix_sources(df: DataFrame, record: str, source: str, size: str, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)`` of a mixture of sources.

    ``targets(source, weight, max_repeats)``: the share of the total size each source shall have, and how often one of its
    records may be used at most. ``chosen(record, source, size, repeats)`` has the records used; sets for growing totals
    are nested. ``shares(source, weight, max_repeats, available, budget, reached, share)`` reports each target source,
    those without records with a share of 0. A source is filled by whole records, in order of a hash, and misses its budget
    by half a record's size at most.

    Records of unlisted or NULL sources, and of NULL or zero size, are not chosen; ``record`` must be unique.
    """
    sized = written(df.select(F.col(record).alias("record"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).dropna().where("size > 0")
                    .withColumn("hash", F.shiftrightunsigned(F.xxhash64("record"), 64 - BITS)), "sized")
    plan = written(mixing_plan(sized, targets, total), "plan")
    limits = plan.where(F.col("budget") > 0).join(_thresholds(sized, plan), "source", "left").select("source", "whole", "rest", "threshold")
    more = F.when((F.col("rest") > 0) & (F.col("hash") < F.col("threshold")), 1).otherwise(0)
    chosen = sized.join(limits, "source").withColumn("repeats", F.col("whole") + more).where(F.col("repeats") > 0).select("record", "source", "size", "repeats")
    reached = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("reached"))
    all_of_it = reached.agg(F.sum("reached").alias("all"))
    shares = plan.join(reached, "source", "left").crossJoin(F.broadcast(all_of_it)).select(
        "source", "weight", "max_repeats", "available", "budget", F.coalesce("reached", F.lit(0)).alias("reached"),
        F.coalesce(F.col("reached") / F.col("all"), F.lit(0.0)).alias("share"))
    return chosen.withColumnRenamed("record", record), shares
