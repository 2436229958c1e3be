"""Review analytics: counts, top lists, category averages, partition statistics.

Rows with a NULL key never form a group. Empty tables give 0 for counts and no rows otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, cleaned, tokens


def review_count(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count("*").alias("n"))


def review_count_year(reviews: DataFrame, year: int) -> DataFrame:
    """Reviews whose ``date`` (year first, with or without a time of day) is in ``year``."""
    return reviews.where(F.substring("date", 1, 4) == f"{year:04d}").agg(F.count("*").alias("n"))


def distinct_business(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_distinct("business_id").alias("n"))


def top_users(reviews: DataFrame, m: int) -> DataFrame:
    """The ``m`` users with the most reviews, ties to the smaller id."""
    counts = reviews.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "user_id").limit(m)


def busy_business(reviews: DataFrame, n: int) -> DataFrame:
    """Businesses with more than ``n`` reviews."""
    return reviews.where(F.col("business_id").isNotNull()).groupBy("business_id").agg(F.count("*").alias("n")).where(F.col("n") > n)


def word_counts(texts: DataFrame, column: str, punctuation: str = PUNCTUATION) -> DataFrame:
    """``(word, n)`` of tokens between white space, lower case, without punctuation; empty ones are dropped."""
    said = texts.select(F.explode(tokens(F.col(column))).alias("token")).select(cleaned(F.col("token"), punctuation).alias("word"))
    return said.where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def top_words(texts: DataFrame, column: str, n: int, stop_words: DataFrame, punctuation: str = PUNCTUATION) -> DataFrame:
    """The ``n`` most frequent words that are no stop words, ties to the smaller word.

    Stop words go after counting: the join sees one row a word.
    """
    counts = word_counts(texts, column, punctuation).join(stop_words.select("word"), "word", "left_anti")
    return counts.orderBy(F.desc("n"), "word").limit(n)


def top_categories(reviews: DataFrame, businesses: DataFrame, n: int) -> DataFrame:
    """The ``n`` categories of highest mean ``stars``: the sum over all reviews by their number, ties to the smaller name.

    Categories are separated by commas and trimmed; one named twice by a business counts twice; NULL stars count as
    no review. Reviews are added up by business before the join.
    """
    rated = reviews.where(F.col("business_id").isNotNull() & F.col("stars").isNotNull()).groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("*").alias("n"))
    listed = businesses.select("business_id", "categories").distinct().where(F.col("categories") != "")
    held = listed.join(rated, "business_id").select("s", "n", F.explode(F.split("categories", ",")).alias("c")).select("s", "n", F.trim("c").alias("category")).where("category != ''")
    means = held.groupBy("category").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("avg_stars"))
    return means.orderBy(F.desc("avg_stars"), "category").limit(n)


def partition_stats(df: DataFrame, key: str, n_partitions: int | None = None) -> DataFrame:
    """``(partition_id, n_items)`` of every partition, empty ones too, as it is or hash-partitioned by ``key``."""
    placed = df if n_partitions is None else df.repartition(n_partitions, key)
    total = n_partitions or placed.rdd.getNumPartitions()
    held = placed.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count("*").alias("n_items"))
    every = df.sparkSession.range(total).select(F.col("id").cast("int").alias("partition_id"))
    return every.join(held, "partition_id", "left").select("partition_id", F.coalesce("n_items", F.lit(0)).alias("n_items"))
