"""Content profiles: rare words, TF-IDF, word profiles of businesses and users, cosine scores."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import PUNCTUATION_EXTENDED, cleaned, tokens
from ..session import written
from .review import word_counts
from .similarity import dense_index


def rare_words(texts: DataFrame, column: str, ratio: float = 1e-6) -> DataFrame:
    """``(word, n)`` of words that make up less than ``ratio`` of all words."""
    counts = word_counts(texts, column, PUNCTUATION_EXTENDED)
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") < ratio * F.col("total")).select("word", "n")


def tfidf(docs: DataFrame, doc: str, text: str, stop_words: DataFrame, min_ratio: float = 1e-6) -> DataFrame:
    """``(doc, word, tf, idf, score)``: term counts by the largest of the document, times ``log2(documents / df)``.

    A document is all rows of a ``doc`` key. Words are tokens between white space or tildes without the extended punctuation and no stop words; those that
    are ``min_ratio`` of the document's words or less are dropped. A document without a word gives no rows.
    """
    said = docs.select(F.col(doc).alias("doc"), F.explode(tokens(F.col(text), "~")).alias("token")).select(
        "doc", cleaned(F.col("token"), PUNCTUATION_EXTENDED).alias("word")).where("doc is not null and word != ''")
    counts = said.groupBy("doc", "word").agg(F.count("*").alias("n")).join(stop_words.select("word"), "word", "left_anti")
    of = Window.partitionBy("doc")
    held = counts.withColumns({"most": F.max("n").over(of), "all": F.sum("n").over(of)}).where(F.col("n") > min_ratio * F.col("all"))
    frequency = held.groupBy("word").agg(F.count("*").alias("df"))
    total = held.agg(F.count_distinct("doc").alias("docs"))  # one row
    idf = F.log2(F.col("docs") / F.col("df"))
    tf = F.col("n") / F.col("most")
    return held.join(frequency, "word").crossJoin(F.broadcast(total)).select("doc", "word", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("score"))


def business_profile(scores: DataFrame, top: int = 200) -> DataFrame:
    """``(doc, word)``: the ``top`` words of each document by score, to 6 digits, ties to the smaller word."""
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc(F.round("score", 6)), "word"))
    return scores.withColumn("k", rank).where(F.col("k") <= top).select("doc", "word")


def word_index(profiles: DataFrame) -> DataFrame:
    """``(word, idx)``: a number for each profile word, from 0 in order."""
    return dense_index(profiles, "word")


def indexed(profiles: DataFrame, index: DataFrame) -> DataFrame:
    """``(doc, word)`` with the words' numbers, which are smaller to shuffle than words."""
    return profiles.join(index, "word").select("doc", F.col("idx").cast("int").alias("word"))


def profile_arrays(profiles: DataFrame) -> DataFrame:
    """``(doc, words)``: each profile as one array in order; it has at most as many words as a profile may."""
    return profiles.groupBy("doc").agg(F.array_sort(F.collect_list("word")).alias("words"))


def user_profile(reviews: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(user_id, word)``: the words in the profiles of the businesses a user has reviewed.

    Users whose businesses have fewer than two profile words in all have no profile.
    """
    seen = reviews.select("user_id", "business_id").dropna().distinct()
    met = seen.join(profiles.select(F.col("doc").alias("business_id"), "word"), "business_id").groupBy("user_id", "word").agg(F.count("*").alias("n"))
    enough = F.sum("n").over(Window.partitionBy("user_id"))
    return met.withColumn("all", enough).where(F.col("all") > 1).select("user_id", "word")


#: Pairs of a user and a business that a task takes at once.
USER_ROWS = 200_000


def user_digests(reviews: DataFrame, profiles: DataFrame) -> DataFrame:
    """``(user_id, n, words_md5)`` of the words of :func:`user_profile`: how many, and the digest of all in order, separated by spaces.

    Words never go by user: users are dealt to buckets of about ``USER_ROWS`` rows, a bucket gets each profile it needs once,
    packed, and there the words of one user after the other are united.
    """
    seen = written(reviews.select("user_id", F.col("business_id").alias("doc")).dropna().distinct(), "seen")
    buckets = max(1, -(-seen.count() // USER_ROWS))
    dealt = seen.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(t.encode(), 9))

    words = profiles.groupBy("doc").agg(F.array_join(F.collect_list("word"), "\n").alias("text"))
    held = written(words.select("doc", packed("text").alias("words")), "packed")
    needed = dealt.select("bucket", "doc").distinct().join(held, "doc").select(F.col("bucket").alias("to"), F.col("doc").alias("name"), "words")

    def united(users: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(texts["name"], texts["words"]))
        rows = []
        for user, docs in users.groupby("user_id")["doc"]:
            lists = [zlib.decompress(of[d]).decode().split("\n") for d in docs if d in of]
            if sum(map(len, lists)) > 1:
                mine = sorted(set().union(*lists))
                rows.append((user, len(mine), hashlib.md5(" ".join(mine).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["user_id", "n", "words_md5"])

    return dealt.groupBy("bucket").cogroup(needed.groupBy("to")).applyInPandas(united, "user_id string, n long, words_md5 string")


def cosine_score(pairs: DataFrame, users: DataFrame, businesses: DataFrame, threshold: float = 0.01) -> DataFrame:
    """``(user_id, business_id, sim)``: ``|A n B| / sqrt(|A| |B|)`` of the word profiles, where above ``threshold``.

    Pairs of unknown ids, or without a profile, are left out; repeated pairs count once.
    """
    wanted = pairs.select("user_id", "business_id").dropna().distinct()
    su, sb = users.groupBy("user_id").agg(F.count("*").alias("nu")), businesses.groupBy("doc").agg(F.count("*").alias("nb"))
    asked = businesses.select(F.col("doc").alias("business_id"), "word")
    met = wanted.join(asked, "business_id").join(users, ["user_id", "word"]).groupBy("user_id", "business_id").agg(F.count("*").alias("both"))
    sized = met.join(su, "user_id").join(sb.withColumnRenamed("doc", "business_id"), "business_id")
    return sized.select("user_id", "business_id", (F.col("both") / (F.sqrt("nu") * F.sqrt("nb"))).alias("sim")).where(F.col("sim") > threshold)
