"""Finding keys that hold a large share of the rows, and spreading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, shares: int = 256, floor: int = 50_000, weight: Column | None = None) -> DataFrame:
    """Keys with more than ``max(floor, rows / shares)`` rows, as ``(key, salts)``.

    At most ``shares`` rows whatever the input, so the result may be broadcast. ``salts`` is how many parts the key's
    rows should go to. ``weight`` sums a measure of the rows instead of counting them, and ``floor`` is then in that
    measure. NULL keys are not reported. One aggregation with map-side combine plus a total.
    """
    size = F.lit(1) if weight is None else F.coalesce(weight, F.lit(0))
    sized = df.select(key, size.cast("long").alias("_size"))
    counts = sized.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("_size").alias("_n"))
    least = max(floor, (sized.agg(F.sum("_size")).first()[0] or 0) // shares)
    return counts.where(F.col("_n") > least).select(key, F.ceil(F.col("_n") / least).cast("int").alias("salts"))


def salted(df: DataFrame, key: str, spread: Column, hot: DataFrame, name: str = "salt") -> DataFrame:
    """``df`` with a column that spreads each hot key's rows by ``spread`` and is 0 for all other rows."""
    return df.join(F.broadcast(hot), key, "left").withColumn(
        name, F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("salts")).cast("int")).otherwise(F.lit(0))
    ).drop("salts")
