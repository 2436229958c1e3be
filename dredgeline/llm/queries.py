"""Queries of the llm operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key, word_count
from ..session import written
from ..sources.tables import table, unique_reviews
from .cooccurrence import surprising_pairs
from .distinctive_terms import distinctive_terms
from .mixing import mix_sources
from .packing import fill_containers
from .similar_sets import expand_pairs, similar_sets
from .term_index import marked_terms
from .tokens import token_counts
from .top_items import top_items
from .visual_form import same_look, visual_form


def _review_ids(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Trimmed ids of ``review``. Copies of a review hold the same ids, so sets of them need no other care."""
    return table(spark, folder, "review").where(key(F.col("review_id")).isNotNull()).select(*(key(F.col(c)).alias(c) for c in columns))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses that share at least half of their users."""
    pairs, members = similar_sets(_review_ids(spark, folder, "user_id", "business_id"), "business_id", "user_id", 0.5, min_size=3)
    return expand_pairs(pairs, members).select(F.col("a").alias("business_a"), F.col("b").alias("business_b"))


def p1_similar_business(spark: SparkSession, folder: str) -> DataFrame:
    """Similar businesses with the sizes of their sets, one row for each pair of distinct sets."""
    pairs, _ = similar_sets(_review_ids(spark, folder, "user_id", "business_id"), "business_id", "user_id", 0.5, min_size=3)
    return pairs.select(F.col("a").alias("business_a"), F.col("b").alias("business_b"), F.col("na").alias("users_a"), F.col("nb").alias("users_b"), "shared", F.round("similarity", 6).alias("similarity"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return unique_reviews(table(spark, folder, "review").select("review_id", "text", "ingested_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Words too rare or too common to be useful."""
    return marked_terms(_texts(spark, folder), "text").where("mark is not null").select(F.col("term").alias("word"), "mark")


def p2_term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and reviews of every word."""
    return marked_terms(_texts(spark, folder), "text").select(F.col("term").alias("word"), "occurrences", F.col("records").alias("reviews"), "mark")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three reviews of each business with the most words."""
    return p4_wordiest_reviews(spark, folder).select("business_id", "review_id")


def p4_wordiest_reviews(spark: SparkSession, folder: str) -> DataFrame:
    reviews = table(spark, folder, "review").select(
        key(F.col("business_id")).alias("business_id"), key(F.col("review_id")).alias("review_id"), word_count(F.col("text")).alias("words"))
    return top_items(reviews.where(F.col("words") > 0).dropna().distinct(), "business_id", "words", "review_id", 3)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses reviewed by the same users ten times as often as by chance."""
    pairs = surprising_pairs(_review_ids(spark, folder, "user_id", "business_id"), "user_id", "business_id", 5, 10.0)
    return pairs.select(F.col("a").alias("business_a"), F.col("b").alias("business_b"))


def p5_surprise(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, expectation, tail probability and false-discovery value of every pair with a common user."""
    return surprising_pairs(_review_ids(spark, folder, "user_id", "business_id"), "user_id", "business_id", 1)


def _business_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "review").select(key(F.col("business_id")).alias("business_id"), key(F.col("review_id")).alias("review_id"), "text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The most characteristic word of each business with five reviews."""
    best = distinctive_terms(_business_docs(spark, folder), "business_id", "review_id", "text", per_record=1, by="score")
    return best.where(F.col("docs") >= 5).select(F.col("record").alias("business_id"), F.col("term").alias("word"))


def p6_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The ten words of highest converged probability of each business."""
    best = distinctive_terms(_business_docs(spark, folder), "business_id", "review_id", "text", per_record=10)
    return best.select(F.col("record").alias("business_id"), F.col("term").alias("word"), "k", "d", F.round("p_record", 6).alias("p_record"))


QUERIES = {f.__name__: f for f in (p1_found, p1_similar_business, p2_found, p2_term_frequency, p4_found, p4_wordiest_reviews, p5_found, p5_surprise, p6_found, p6_profile)}


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents").where(F.col("doc_id").isNotNull()), ["doc_id", "source"], "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of 2,048 tokens of each text, or of each piece of a text larger than that."""
    sized = _sized(spark, folder).join(table(spark, folder, "documents").where("text is not null").select("doc_id"), "doc_id", "left_semi")
    return fill_containers(sized, "doc_id", "tokens", 2048)


def p8_filling(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers are filled: texts, containers above their capacity, texts cut in vain, and containers above the lower bound."""
    filled = written(p8_containers(spark, folder), "filled")
    over = filled.groupBy("container").agg(F.sum("size").alias("load")).agg(
        F.count_if(F.col("load") > 2048).alias("overfull"), (F.count("*") - F.greatest(F.ceil(F.sum("load") / 2048), F.lit(1))).alias("above_least"))
    texts = filled.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens")).agg(
        F.count("*").alias("texts"), F.count_if(F.col("pieces") > F.greatest(F.ceil(F.col("tokens") / 2048), F.lit(1))).alias("cut"))
    return texts.crossJoin(F.broadcast(over)).select("texts", "cut", "overfull", "above_least")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the largest mixture with the target shares, and how often each is used."""
    return mix_sources(_sized(spark, folder), "doc_id", "source", "tokens", table(spark, folder, "mix_target"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share that each target source reaches."""
    return mix_sources(_sized(spark, folder), "doc_id", "source", "tokens", table(spark, folder, "mix_target"))[1]


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    return visual_form(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents whose texts look the same but are not."""
    pairs, members = same_look(_forms(spark, folder), "doc_id", "text")
    a, b = (members.select(F.col("record").alias(f"d{k}"), F.col("text_key").alias(f"key_{k}")) for k in "ab")
    both = pairs.join(a, "key_a").join(b, "key_b")
    return both.select(F.least("da", "db").alias("doc_a"), F.greatest("da", "db").alias("doc_b"))


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text, by digest, and whether it differs from the text."""
    return _forms(spark, folder).select("doc_id", F.md5("form").alias("form_md5"), (F.col("form") != F.col("text")).alias("changed"))


QUERIES |= {f.__name__: f for f in (p8_containers, p8_filling, p9_mixture, p9_shares, p10_found, p10_forms)}
