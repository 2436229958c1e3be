"""File and stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a review as they are written, all text.
REVIEW = T.StructType([T.StructField(c, T.StringType()) for c in ("review_id", "user_id", "business_id", "stars", "text", "date")])


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object a line. A malformed line raises if ``strict``, else its fields are NULL."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def csv_pairs(spark: SparkSession, path: str, swap: bool = False) -> DataFrame:
    """``(basket, item)`` from the first two columns of CSV files with a header; ``swap`` takes the second as the basket.

    A header is what the first line says, so copies of it within the rows, as in files that were put together, go too.
    """
    header = spark.read.text(path).limit(1).collect()
    rows = spark.read.option("header", True).option("enforceSchema", True).schema("a string, b string").csv(path)
    if header and header[0].value.count(",") >= 1:
        a, b = (c.strip().strip('"') for c in header[0].value.split(",")[:2])
        rows = rows.where(~(F.col("a").eqNullSafe(a) & F.col("b").eqNullSafe(b)))
    a, b = ("b", "a") if swap else ("a", "b")
    return rows.select(F.col(a).alias("basket"), F.col(b).alias("item"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``: one a line, trimmed, distinct."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word != ''").distinct()


def tagged(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    """The rows of one kind from a JSON-lines file of several, told apart by their field ``type``."""
    return json_lines(spark, path, f"type string, {schema}").where(F.col("type") == kind).drop("type")


def average_map(spark: SparkSession, path: str) -> DataFrame:
    """``(id, avg_stars)`` from lines that are JSON objects of ids and averages."""
    maps = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    return maps.select(F.explode("m").alias("id", "avg_stars"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of text lines with the time of their arrival."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """The fields of JSON text in ``value``, beside the other columns."""
    return lines.withColumn("_j", F.from_json("value", schema)).select(*(c for c in lines.columns if c != "value"), "_j.*")


def tracked(messages: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """Messages whose text has any of the keywords, whatever the case."""
    if not keywords:
        return messages.limit(0) if not messages.isStreaming else messages.where(F.lit(False))
    said = F.lower(F.col(text))
    hit = said.contains(keywords[0].lower())
    for k in keywords[1:]:
        hit = hit | said.contains(k.lower())
    return messages.where(hit)
