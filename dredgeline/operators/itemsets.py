"""Frequent itemsets: level-wise candidate generation over (itemset, basket) rows, and partition-local candidates."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .pairs import shared_counts


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """``(basket, items)`` with the distinct items in order. NULL baskets and items are ignored."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna()
    return rows.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))


def frequent_itemsets(df: DataFrame, basket: str, item: str, support: int, max_size: int | None = None) -> DataFrame:
    """``(items, size, freq)``: every set of items that at least ``support`` baskets hold, exactly.

    Rows of infrequent items go first. Pairs are counted by :func:`shared_counts`, which makes none in vain from the largest
    baskets. From then on the occurrences of the frequent sets join with themselves on the basket and all but the
    last item, which gives each larger set once; a set is kept by its own count. Ends at the first empty level or
    ``max_size``.
    """
    rows = df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).dropna().distinct()
    level = rows.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    found = level.select(F.array("item").alias("items"), F.lit(1).alias("size"), "freq")
    if max_size == 1:
        return found
    able = written(rows.join(level.select("item"), "item", "left_semi"), "able")
    pairs = shared_counts(able, "item", "basket", support).select(F.array("a").alias("prefix"), F.col("b").alias("last"), F.col("shared").alias("freq"))
    counts, size, held = written(pairs, "level"), 2, None
    while not counts.isEmpty():
        found = found.unionByName(counts.select(F.concat("prefix", F.array("last")).alias("items"), F.lit(size).alias("size"), "freq"))
        if size == max_size:
            break
        if held is None:
            first = counts.select(F.col("prefix")[0].alias("item"), "prefix", "last").join(able, "item").drop("item")
            held = first.join(able.withColumnRenamed("item", "last"), ["last", "basket"]).select("basket", "prefix", "last")
        else:
            held = longer.join(counts.select("prefix", "last"), ["prefix", "last"], "left_semi")
        held = written(held, "occurrences")
        size += 1
        longer = held.select("basket", "prefix", F.col("last").alias("x")).join(held, ["basket", "prefix"]).where(F.col("x") < F.col("last")).select(
            "basket", F.concat("prefix", F.array("x")).alias("prefix"), "last")
        counts = written(longer.groupBy("prefix", "last").agg(F.count("*").alias("freq")).where(F.col("freq") >= support), "level")
    return found


def pair_bitmap(sets: list[list[str]], support: int, buckets: int = 1 << 17) -> np.ndarray:
    """Which buckets of the pairs' hashes hold at least ``support`` pairs; a pair of another bucket cannot be frequent."""
    counts = np.zeros(buckets, np.int64)
    for items in sets:
        codes = _codes(items, buckets)
        for k in range(1, len(codes)):  # one item with all before it: memory stays that of the basket
            np.add.at(counts, (codes[:k] + codes[k]) % buckets, 1)
    return counts >= support


def _codes(items, buckets: int) -> np.ndarray:
    return np.array([crc32(i.encode()) % buckets for i in items], np.int64)


def local_itemsets(sets: list[list[str]], support: int, max_size: int | None = None, buckets: int = 1 << 17) -> list[tuple[str, ...]]:
    """All sets that at least ``support`` of the given sorted baskets hold.

    The first pass counts items and hashes pairs of frequent items into buckets; only pairs of frequent items in frequent
    buckets have their baskets intersected.
    """
    holders: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for k, items in enumerate(sets):
        for i in items:
            holders[(i,)].add(k)
    level = {s: h for s, h in holders.items() if len(h) >= support}
    out = sorted(level)
    bitmap = pair_bitmap([[i for i in items if (i,) in level] for items in sets], support, buckets) if support > 1 and max_size != 1 else None
    code = dict(zip(level, _codes([s[0] for s in level], buckets).tolist()))
    while level and (max_size is None or len(out[-1]) < max_size):
        by_prefix = defaultdict(list)
        for s in sorted(level):
            by_prefix[s[:-1]].append(s)
        following = {}
        for prefix, several in by_prefix.items():
            for x, y in combinations(several, 2):
                if not prefix and bitmap is not None and not bitmap[(code[x] + code[y]) % buckets]:
                    continue
                both = level[x] & level[y]
                if len(both) >= support:
                    following[(*x, y[-1])] = both
        level = following
        out += sorted(level)
    return out


def son_candidates(df: DataFrame, basket: str, item: str, support: int, n_partitions: int | None = None, max_size: int | None = None,
                   basket_rows: int = 1_000_000) -> DataFrame:
    """``(items, size)``: sets frequent in some partition of the baskets at the support scaled to it.

    The candidates depend on the partitioning, but always include every frequent set. Without ``n_partitions`` there are as
    many as keep a partition near ``basket_rows`` rows of baskets, two at least.
    """
    grouped = written(baskets(df, basket, item), "baskets")
    total, held = grouped.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    n_partitions = n_partitions or max(2, -(-held // basket_rows))

    def mine(batches):
        sets = [list(items) for t in batches for items in t["items"]]
        if sets:
            local = local_itemsets(sets, max(1, math.ceil(len(sets) * support / total)), max_size)
            yield pd.DataFrame({"items": [list(s) for s in local]})

    placed = grouped.repartition(n_partitions, "basket").select("items")
    return placed.mapInPandas(mine, "items array<string>").distinct().withColumn("size", F.size("items"))


def counted_candidates(candidates: DataFrame, df: DataFrame, basket: str, item: str, support: int) -> DataFrame:
    """``(items, size, freq)``: the second pass, the candidates held by at least ``support`` baskets.

    A candidate visits the baskets of its rarest item only, and looks its other items up there.
    """
    rows = df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).dropna().distinct()
    candidates = written(candidates, "candidates")  # mined once
    frequency = rows.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    parts = candidates.where("size > 1").select("items", "size", F.explode("items").alias("item")).join(frequency, "item")
    rarest = parts.groupBy("items", "size").agg(F.min(F.struct("freq", "item")).alias("r"), F.count("*").alias("known")).where(F.col("known") == F.col("size"))
    met = rarest.select("items", "size", F.col("r.item").alias("item")).join(rows, "item")
    rest = met.select("items", "size", "basket", F.explode(F.array_except("items", F.array("item"))).alias("item"))
    whole = rest.join(rows, ["basket", "item"]).groupBy("items", "size", "basket").agg(F.count("*").alias("k")).where(F.col("k") == F.col("size") - 1)
    several = whole.groupBy("items", "size").agg(F.count("*").alias("freq")).where(F.col("freq") >= support)
    single = candidates.where("size = 1").select("items", "size", F.col("items")[0].alias("item")).join(frequency, "item").select("items", "size", "freq")
    return single.unionByName(several)
