"""Logical relations over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import key


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stars(column: Column) -> Column:
    """The rating as a double; NULL where it is unreadable or outside 1 to 5."""
    value = F.trim(column).try_cast("double")
    return F.when(value.between(1, 5), value)


def unique_reviews(reviews: DataFrame) -> DataFrame:
    """One row per trimmed ``review_id``, the first to arrive; rows without an id are dropped.

    Ids are trimmed. ``lag`` marks the first row so that rows are sorted once, after their shuffle.
    """
    ids = {c: key(F.col(c)) for c in ("review_id", "user_id", "business_id") if c in reviews.columns}
    order = [F.col(c) for c in ("ingested_at", "date", "stars", "user_id", "business_id", "text") if c in reviews.columns]
    first = F.lag(F.lit(1)).over(Window.partitionBy("review_id").orderBy(*order))
    return reviews.withColumns(ids).where(F.col("review_id").isNotNull()).withColumn("_first", first).where(F.col("_first").isNull()).drop("_first")
