"""Sketches: Bloom membership, probabilistic distinct counts, sampling by priority, trending tags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bytes_mod, coefficients, trailing_zeros, universal

#: Size of the bit table and modulus of its hashes; modulus of the counting hashes.
BLOOM_BITS, BLOOM_MODULUS = 3_736_850, 23_333_333_333
FM_MODULUS = 8191


def _positions(name: Column, k: int, m: int, p: int, seed: int) -> Column:
    x = bytes_mod(name, p)
    return F.array(*(universal(x, a, b, p, m) for a, b in coefficients(seed, k, 1, 9_999_999, 0)))


def bloom_build(names: DataFrame, column: str, k: int = 50, m: int = BLOOM_BITS, p: int = BLOOM_MODULUS, seed: int = 2) -> DataFrame:
    """``(position)``: the bits set by the distinct non-empty names, at most ``m`` rows."""
    held = names.select(F.col(column).alias("name")).where("name != ''").distinct()
    return held.select(F.explode(_positions(F.col("name"), k, m, p, seed)).alias("position")).distinct()


def bitmap(bits: DataFrame, m: int = BLOOM_BITS) -> DataFrame:
    """``(words)``, one row: the positions as bits of an array of 64-bit words. Its size is fixed by ``m``."""
    each = bits.groupBy(F.floor(F.col("position") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(position % 64 as int))")).alias("word"))
    held = each.agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("words"))  # at most m / 64 entries

    @F.pandas_udf("binary")
    def packed(maps: pd.Series) -> pd.Series:
        def one(words):
            table = np.zeros(-(-m // 64), "<i8")
            for at, word in dict(words).items():
                table[at] = word
            return table.tobytes()

        return maps.map(one)

    return held.select(packed("words").alias("words"))


def bloom_probe(names: DataFrame, column: str, bits: DataFrame, k: int = 50, m: int = BLOOM_BITS, p: int = BLOOM_MODULUS, seed: int = 2) -> DataFrame:
    """``(name, hit)`` of each distinct name: whether all its bits are set. Never false for a name that was built in; NULL
    and empty names are no hits.

    The table is ``m`` bits whatever was built in, so it goes to every task as it is, and each name is tested in place.
    """
    asked = names.select(F.col(column).alias("name")).distinct()
    table = bits.sparkSession.sparkContext.broadcast(np.frombuffer(bitmap(bits, m).first().words, np.uint8))

    @F.pandas_udf("boolean")
    def all_set(positions: pd.Series) -> pd.Series:
        held = np.stack(positions.to_numpy()) if len(positions) else np.zeros((0, k), np.int64)
        return pd.Series(((table.value[held >> 3] >> (held & 7)) & 1).all(axis=1))

    able = asked.where("name != ''").select("name", all_set(_positions(F.col("name"), k, m, p, seed)).alias("hit"))
    return able.unionByName(asked.where("name is null or name = ''").select("name", F.lit(False).alias("hit")))


def distinct_estimate(x: Column, hashes: int = 30, groups: int = 15, seed: int = 11) -> tuple[list[Column], Column]:
    """Aggregates and, over their names, the estimate: the median of the groups' means of ``2**(trailing zeros)``.

    ``x`` is the value as a number modulo ``FM_MODULUS``. The most trailing zeros of each hash are kept; batch and stream
    use the same expressions.
    """
    most = [F.max(trailing_zeros(universal(x, a, b, FM_MODULUS))).alias(f"z{i}") for i, (a, b) in enumerate(coefficients(seed, hashes, 0, 2**16 - 1))]
    per = hashes // groups
    means = [sum((F.pow(F.lit(2.0), f"z{g * per + i}") for i in range(per)), F.lit(0.0)) / per for g in range(groups)]
    middle = F.element_at(F.array_sort(F.array(*means)), groups // 2 + 1)
    return most, F.coalesce(F.floor(middle).cast("long"), F.lit(0).cast("long"))


def fm_window(df: DataFrame, ts: str, value: str, window: str = "30 seconds", slide: str = "10 seconds", hashes: int = 30, groups: int = 15,
              seed: int = 11, watermark: str | None = None, values_apart: bool = False) -> DataFrame:
    """``(window_start, exact, estimate)``: distinct values of each sliding window, exactly and by the sketch.

    Works on batches and, with ``watermark``, on streams; ``values_apart`` drops repeated values of a window before they are
    counted, each a row of the state of its own, in streams in append mode. NULL and empty values are ignored.
    """
    rows = df.select(F.col(ts).cast("timestamp").alias("_ts"), F.col(value).cast("string").alias("_v")).where("_ts is not null and _v != ''")
    if watermark is not None:
        rows = rows.withWatermark("_ts", watermark)
    rows = rows.withColumn("_x", bytes_mod(F.col("_v"), FM_MODULUS))  # once a row, not once a hash and window
    most, estimate = distinct_estimate(F.col("_x"), hashes, groups, seed)
    if values_apart:
        once = rows.select(F.window("_ts", window, slide).alias("w"), "_v", "_x").dropDuplicates(["w", "_v"])
        held = once.groupBy("w").agg(F.count("*").alias("exact"), *most)
    else:
        exact = F.size(F.collect_set("_v")).cast("long") if df.isStreaming else F.count_distinct("_v")
        held = rows.groupBy(F.window("_ts", window, slide).alias("w")).agg(exact.alias("exact"), *most)
    return held.select(F.col("w.start").alias("window_start"), "exact", estimate.alias("estimate"))


def exact_distinct_window(df: DataFrame, ts: str, value: str, window: str = "30 seconds", slide: str = "10 seconds") -> DataFrame:
    """``(window_start, exact)``: distinct non-null values of each sliding window."""
    rows = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    return rows.groupBy(F.window(F.col(ts).cast("timestamp"), window, slide).alias("w")).agg(F.count_distinct(value).alias("exact")).select(F.col("w.start").alias("window_start"), "exact")


def reservoir(df: DataFrame, key: str, capacity: int = 100, seed: int = 0) -> DataFrame:
    """``capacity`` rows, every set of them equally likely: those of least priority, a digest of key and seed.

    A sample of samples is a sample of all, so it is taken in parallel. ``key`` must be unique; NULL keys are left out.
    """
    priority = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.where(F.col(key).isNotNull()).withColumn("_p", priority).orderBy("_p", key).limit(capacity).drop("_p")


def well_tagged(tags: str) -> Column:
    """Whether there are tags, all of letters and digits."""
    return F.coalesce((F.size(tags) > 0) & F.forall(tags, lambda t: F.coalesce(t.rlike(r"^[\p{L}\p{N}]+$"), F.lit(False))), F.lit(False))


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """``(tag, n)`` of records all of whose tags, at least one, consist of letters and digits."""
    return df.where(well_tagged(tags)).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def trending_tags(df: DataFrame, tags: str, top: int = 3) -> DataFrame:
    """``(tag, n)`` of the tags whose count is among the ``top`` highest distinct counts.

    The counts wanted are found from the distinct counts, of which there are few, not by ranking the tags in one task.
    """
    counts = tag_counts(df, tags)
    least = counts.select("n").distinct().orderBy(F.desc("n")).limit(top).agg(F.min("n").alias("least"))  # one row
    return counts.crossJoin(F.broadcast(least)).where(F.col("n") >= F.col("least")).select("tag", "n")
