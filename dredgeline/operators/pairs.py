"""Pairs of records by the items they share, without pairing everything that meets in a popular item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Up to so many pairs a row, records meet item by item; beyond, popular items would make most of the pairs.
PAIRS_A_ROW = 32


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """``(column, idx)``: each distinct non-null value with its place in sorted order, from 0.

    Values are range-partitioned; numbers start from the rows of the partitions before, so no task sorts them all.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    ranged = written(values.repartitionByRange(n, "v").withColumn("part", F.spark_partition_id()), "ranged")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")  # one row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(offsets), "part").select(F.col("v").alias(column), (F.col("place") + F.col("before")).alias("idx"))


def few_meet(rows: DataFrame, item: str) -> bool:
    """Whether the pairs that meet item by item stay in proportion to the rows."""
    sizes = rows.groupBy(item).agg(F.count("*").alias("df"))
    n, met = sizes.agg(F.sum("df"), F.sum(F.col("df") * (F.col("df") - 1) / 2)).first()
    return (met or 0) <= PAIRS_A_ROW * (n or 0)


def met_by_item(rows: DataFrame, least: int, *sums: Column) -> DataFrame:
    """``(a, b, shared, *sums)`` for ``a < b`` of distinct ``(r, i)`` or ``(r, i, v)``, where ``shared`` is ``least`` or more.

    Every pair is made once for each item both hold. Records go by numbers in their order meanwhile, which are far
    smaller to shuffle than ids. ``sums`` aggregate ``x`` and ``y``, the values of the two.
    """
    index = written(dense_index(rows, "r"), "numbers")
    held = written(rows.join(index, "r").drop("r").withColumnRenamed("idx", "r"), "held")
    x, y = (held.withColumnsRenamed({"r": k, "v": v}) for k, v in (("a", "x"), ("b", "y")))
    met = x.join(y, "i").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared"), *sums).where(F.col("shared") >= least)
    for k in "ab":
        met = met.join(index.select(F.col("idx").alias(k), F.col("r").alias(f"id_{k}")), k)
    return met.drop("a", "b").withColumnsRenamed({"id_a": "a", "id_b": "b"})


def shared_counts(df: DataFrame, record: str, item: str, least: int = 1) -> DataFrame:
    """``(a, b, shared)`` for ``a < b``: how many items both hold, where that is ``least`` or more. Rows are distinct.

    Where few pairs meet item by item, they are counted so. Else, two records that share ``least`` items share one outside the ``least - 1`` most frequent items of each, so only the
    others make candidates: the most popular items never do. Candidates are then counted over all items, from
    the record with fewer.
    """
    rows = df.select(F.col(record).alias("r"), F.col(item).alias("i")).dropna().distinct()
    if least <= 1 or few_meet(rows, "i"):
        return met_by_item(rows, least).select("a", "b", "shared")
    frequency = rows.groupBy("i").agg(F.count("*").alias("df"))
    sizes = rows.groupBy("r").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = rows.join(sizes, "r").join(frequency.where(F.col("df") > 1), "i")
    rank = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("df"), F.desc("i")))
    # the limit on the rank is applied before the shuffle, so no task gets all items of a large record
    popular = held.select("r", "i", "df").withColumn("k", rank).where(F.col("k") < least).select("r", "i")
    rare = held.join(popular, ["r", "i"], "left_anti").select("r", "i", "n")
    a, b = (rare.select(F.col("r").alias(k), "i", F.col("n").alias(f"n{k}")) for k in "ab")
    candidates = a.join(b, "i").where(F.col("a") < F.col("b")).select("a", "b", (F.col("na") <= F.col("nb")).alias("first")).distinct()
    fewer = F.when(F.col("first"), F.col("a")).otherwise(F.col("b"))
    more = F.when(F.col("first"), F.col("b")).otherwise(F.col("a"))
    probe = candidates.select("a", "b", fewer.alias("r"), more.alias("s")).join(held.select("r", "i"), "r")
    met = probe.join(held.select(F.col("r").alias("s"), "i"), ["s", "i"])
    return met.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def ordered_sets(rows: DataFrame) -> DataFrame:
    """``(record, n, ordered, items)`` of distinct ``(record, item)``: the items in order of how many records hold them."""
    held = rows.join(rows.groupBy("item").agg(F.count("*").alias("df")), "item")
    sets = held.groupBy("record").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("df", "item"))).alias("ordered"))
    return sets.withColumn("items", F.col("ordered.item"))


def size_class(threshold: float) -> Column:
    """Sets that can be similar are in the same class of sizes or in neighbouring ones."""
    if threshold == 1:
        return F.col("n").cast("int")
    return F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold + 1e-9)) + 1e-9).cast("int")


def least_overlap(threshold: float, a: Column, b: Column) -> Column:
    return F.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, na, nb, shared)`` of pairs ``(a, b)``, exactly."""
    left = sets.select(F.col("record").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("record").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", both.alias("shared"))


def similarity() -> Column:
    return F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))


def prefix(sets: DataFrame, threshold: float) -> DataFrame:
    """The rarest ``n - ceil(threshold * n) + 1`` items of each set: of two similar sets, they have one in common."""
    rare = F.slice("ordered", 1, F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1)
    return sets.select("record", "n", size_class(threshold).alias("class"), F.posexplode(rare).alias("pos", "e")).where(F.col("e.df") > 1).select("record", "n", "class", "pos", F.col("e.item").alias("item"))


def within(left: DataFrame, right: DataFrame, sets: DataFrame, threshold: float, once: bool) -> DataFrame:
    """``(a, b, na, nb, shared)``: pairs of a left and a right set of a Jaccard similarity of ``threshold`` or more.

    Sets meet on one of their rarest items, under compatible size classes, and only where the items left can still reach
    the overlap; what meets is measured exactly. ``once``: both sides are the same sets, and each pair is wanted once.
    """
    a = prefix(left, threshold).select("item", F.explode(F.array("class", F.col("class") + 1, *([] if once else [F.col("class") - 1]))).alias("class"), F.col("record").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = prefix(right, threshold).select("item", "class", F.col("record").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    apart = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))) if once else F.col("a") != F.col("b")
    met = a.join(b, ["item", "class"]).where(apart & (F.least("na", "nb") >= F.ceil(threshold * F.greatest("na", "nb") - 1e-9)))
    met = met.where(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least_overlap(threshold, F.col("na"), F.col("nb")))
    return measured(met.select("a", "b").distinct(), sets).where(similarity() >= threshold - 1e-12)
