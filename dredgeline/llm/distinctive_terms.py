"""How characteristic a term is of its record: parsimonious language models over term counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import has_word, words
from ..operators.skew import hot_keys, salted
from ..session import written

#: Stands for "any term": its count is the record's number of documents, its record frequency the number of records.
ANY = ""

COLUMNS = ("record", "term", "k", "d", "n", "docs", "p_background", "p_record", "score")
SCHEMA = "record string, term string, k long, d long, n long, docs long, p_background double, p_record double, score double"


def parsimonious(counts: np.ndarray, background: np.ndarray, starts: np.ndarray, weight: float = 0.1, copies: np.ndarray | None = None) -> np.ndarray:
    """P(term | record) of many records at once, where expectation-maximisation ends; record r holds the rows from ``starts[r]`` on.

    Expectation: the part of a term's count that the record explains rather than the background,
    ``k * w p / (w p + (1 - w) b)``. Maximisation: ``p`` in proportion to it. Rounds of these approach their end ever more
    slowly where a term's probability falls to 0, so the end is computed: the likelihood is concave, and its maximum is
    ``p = max(0, k / t - (1 - w) b / w)`` with the ``t`` at which these add up to 1. Expectation at that ``t`` drops the terms
    that the background explains, maximisation raises ``t`` for those left, until no term drops: finitely many rounds for
    each record, without a cap, whatever other records are beside it. ``copies`` lets a row stand for several terms of the
    same count and background.
    """
    if not len(counts) or weight <= 0:
        return np.zeros(len(counts))
    m = np.ones(len(counts)) if copies is None else np.asarray(copies, float)
    lengths = np.diff(np.append(starts, len(counts)))
    k = np.asarray(counts, float)
    base = (1 - weight) / weight * np.asarray(background, float)
    kept = np.ones(len(k), bool)
    while True:
        t = np.repeat(np.add.reduceat(k * m * kept, starts) / (1 + np.add.reduceat(base * m * kept, starts)), lengths)
        fewer = kept & (k > t * base)
        if (fewer == kept).all():
            return np.where(kept, k / t - base, 0.0)
        kept = fewer


def tf_idf(k, d, n):
    """``k * log2(n / d)`` rounded half up to 6 digits."""
    return np.floor(np.asarray(k) * np.log2(np.asarray(n) / np.asarray(d)) * 1e6 + 0.5) / 1e6


def _once(docs: DataFrame, *place: str) -> DataFrame:
    """Distinct documents, sorted out where one shuffle of the text by the first column of ``place`` has put them."""
    first = F.lag(F.lit(1)).over(Window.partitionBy(*place, "doc").orderBy("text"))
    return docs.repartition(place[0]).withColumn("_again", first).where(F.col("_again").isNull())


def _counts(docs: DataFrame, *place: str) -> DataFrame:
    """``(*place, term, k)``: terms of distinct documents, with ``ANY`` once for each document."""
    terms = _once(docs, *place).select(*place, F.explode(F.concat(words(F.col("text")), F.array(F.lit(ANY)))).alias("term"))
    return terms.groupBy(*place, "term").agg(F.count("*").alias("k"))


def _whole(weight: float, tokens: int, per_record: int | None, by: str):
    """Scores a bucket of whole records: ``left`` their term counts, ``right`` the statistics of the bucket's terms."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(COLUMNS, _ARROW)})
        at = pc.index_in(left["term"], right["term"]).to_numpy()
        d, cf = right["d"].to_numpy()[at], right["cf"].to_numpy()[at]
        terms = left["term"].combine_chunks() if isinstance(left["term"], pa.ChunkedArray) else left["term"]
        code = left["record"].combine_chunks().dictionary_encode()
        if isinstance(code, pa.ChunkedArray):
            code = code.combine_chunks()
        record, k = code.indices.to_numpy(), left["k"].to_numpy()
        is_any = pc.equal(left["term"], ANY).to_numpy()
        docs = np.zeros(len(code.dictionary), np.int64)
        docs[record[is_any]] = k[is_any]
        n = int(d[is_any][0])
        rows = np.flatnonzero(~is_any)
        rows = rows[np.argsort(record[rows], kind="stable")]
        r, kk, dd, background = record[rows], k[rows], d[rows], cf[rows] / tokens
        starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
        p = parsimonious(kk, background, starts, weight)
        s = tf_idf(kk, dd, n)
        if per_record is not None and len(r):
            names = pc.rank(terms.take(pa.array(rows)), sort_keys="ascending", tiebreaker="dense").to_numpy()
            order = np.lexsort((names, -(s if by == "score" else p), r))
            start = np.flatnonzero(np.append(True, r[order][1:] != r[order][:-1]))
            place = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
            keep = order[place < per_record]
        else:
            keep = np.arange(len(r))
        at = pa.array(rows[keep])
        return pa.table({
            "record": left["record"].take(at), "term": left["term"].take(at), "k": kk[keep], "d": dd[keep],
            "n": np.full(len(keep), n, np.int64), "docs": docs[r[keep]], "p_background": background[keep], "p_record": p[keep], "score": s[keep]})

    return score


_ARROW = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())


def distinctive_terms(docs: DataFrame, record: str, doc: str, text: str, weight: float = 0.1, per_record: int | None = None,
                      by: str = "p_record", shares: int = 1024, floor: int = 1 << 25) -> DataFrame:
    """Terms of each record with how characteristic they are of it.

    A record is all distinct documents (``doc`` ids; copies of a document count once) with the same ``record`` key; a
    term is a maximal run of letters or digits of the lower-cased text. Columns: ``k`` occurrences in the record, ``d``
    records with the term, ``n`` records with any term, ``docs`` the record's documents with a term, ``p_background``
    the term's share of all occurrences, ``p_record`` the probability under the record's parsimonious
    language model (``weight`` is the record's part of the mixture) at its convergence, ``score = k * log2(n / d)``, 6 digits.

    ``per_record`` keeps the best terms of each record by ``p_record`` or ``score``, ties to the smaller term. NULL keys
    and texts without a term are ignored; an empty table gives no rows.

    Terms are counted where the records' texts have been shuffled to, for the statistics and again for the scores: texts are
    several times smaller than counts by record and term. Term statistics travel to the buckets that hold the term.
    A record of more than ``floor`` characters, and of more than ``1 / shares`` of all, is counted in parts, and its terms
    are scored one by one in parallel.
    """
    if by not in ("p_record", "score"):
        raise ValueError("by must be p_record or score")
    spark = docs.sparkSession
    rows = docs.select(F.col(record).alias("record"), F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.col("record").isNotNull() & F.col("doc").isNotNull())
    hot = written(hot_keys(rows, "record", shares, floor, F.length("text")), "hot-records")
    some_hot = not hot.isEmpty()
    rows = rows.where(has_word(F.col("text")))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("record"), F.lit(buckets)).cast("int").alias("bucket")
    cold = rows.join(F.broadcast(hot.select("record")), "record", "left_anti") if some_hot else rows
    whole = _counts(cold.select(bucket, "record", "doc", "text"), "bucket", "record")

    seen = whole.groupBy("bucket", "term").agg(F.count("*").alias("d"), F.sum("k").alias("cf"))
    if some_hot:
        spread = salted(rows.join(F.broadcast(hot.select("record")), "record", "left_semi"), "record", F.col("doc"), hot.withColumn("salts", F.greatest("salts", F.lit(2))))
        parts = _counts(spread.select(F.xxhash64("record", "salt").alias("part"), "record", "doc", "text"), "part", "record")
        split = written(parts.groupBy("record", "term").agg(F.sum("k").alias("k")), "split-counts")
        seen = seen.unionByName(split.groupBy("term").agg(F.count("*").alias("d"), F.sum("k").alias("cf")).withColumn("bucket", F.lit(None).cast("int")))
    stats = written(seen.groupBy("term").agg(F.sum("d").alias("d"), F.sum("cf").alias("cf"), F.collect_list("bucket").alias("buckets")), "term-statistics")
    tokens = max(1, stats.where(F.col("term") != ANY).agg(F.sum("cf")).first()[0] or 0)
    sent = stats.select(F.explode("buckets").alias("bucket"), "term", "d", "cf")

    scored = whole.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(_whole(weight, tokens, per_record, by), SCHEMA)
    if some_hot:
        scored = scored.unionByName(_split_records(split, stats.select("term", "d", "cf"), weight, tokens, per_record, by))
    return scored.select(*COLUMNS)


def _split_records(split: DataFrame, stats: DataFrame, weight: float, tokens: int, per_record: int | None, by: str) -> DataFrame:
    """Scores records spread over tasks: terms of equal count and background share one row of the fit."""
    held = written(split.join(stats, "term"), "split-terms")
    some = held.where(F.col("term") == ANY).select("record", F.col("k").alias("docs"), F.col("d").alias("n"))
    held = held.where(F.col("term") != ANY)
    kinds = held.groupBy("record", "k", "cf").agg(F.count("*").alias("copies"))

    def converge(t: pd.DataFrame) -> pd.DataFrame:
        p = parsimonious(t["k"].to_numpy(), t["cf"].to_numpy() / tokens, np.array([0]), weight, copies=t["copies"].to_numpy())
        return t[["record", "k", "cf"]].assign(p_record=p)

    fitted = kinds.groupBy("record").applyInPandas(converge, "record string, k long, cf long, p_record double")
    score: Column = F.floor(F.col("k") * F.log2(F.col("n") / F.col("d")) * 1e6 + 0.5) / 1e6
    out = held.join(fitted, ["record", "k", "cf"]).join(F.broadcast(some), "record").select(
        "record", "term", "k", "d", "n", "docs", (F.col("cf") / F.lit(tokens)).alias("p_background"), "p_record", score.alias("score"))
    if per_record is not None:
        rank = F.row_number().over(Window.partitionBy("record").orderBy(F.desc(by), "term"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= per_record).drop("_r")
    return out
