"""Items that appear together: exact pair counts against a bipartite configuration model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def degree_classes(degree: np.ndarray, exact: int = 256, steps: int = 32) -> np.ndarray:
    """The class of each degree: the degree itself up to ``exact``, above that ``steps`` classes a doubling.

    The number of classes is bounded (under 1,300 for degrees below 2**40), so the model's tables are too.
    """
    d = np.asarray(degree, float)
    return np.where(d <= exact, d, exact + np.floor(np.log2(np.maximum(d, exact) / exact) * steps + 1e-9) + 1).astype(int)


def _class_column(name: str, exact: int = 256, steps: int = 32):
    d = F.col(name).cast("double")
    return F.when(d <= exact, d).otherwise(exact + F.floor(F.log2(d / exact) * steps + 1e-9) + 1).cast("int")


def fit_configuration(baskets: np.ndarray, n_baskets: np.ndarray, items: np.ndarray, n_items: np.ndarray,
                      rounds: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Fitness of each basket-size class and item-frequency class of the bipartite configuration model.

    Basket u holds item i with probability ``x_u y_i / (1 + x_u y_i)``; the fitted expectations of every basket's size
    and every item's frequency equal the observed ones. Fixed-point iteration over the classes.
    """
    k, d = np.asarray(baskets, float), np.asarray(items, float)
    edges = float((k * n_baskets).sum())
    if edges == 0:
        return np.zeros_like(k), np.zeros_like(d)
    x, y = k / np.sqrt(edges), d / np.sqrt(edges)
    for _ in range(rounds):
        grid = 1 / (1 + np.outer(x, y))
        new_x = k / np.maximum((grid * (y * n_items)).sum(1), 1e-300)
        grid = 1 / (1 + np.outer(new_x, y))
        new_y = d / np.maximum((grid * (new_x * n_baskets)[:, None]).sum(0), 1e-300)
        done = max(np.abs(new_x / np.maximum(x, 1e-300) - 1).max(), np.abs(new_y / np.maximum(y, 1e-300) - 1).max()) < tol
        x, y = np.minimum(new_x, 1e12), np.minimum(new_y, 1e12)
        if done:
            break
    return x, y


def poisson_binomial_tail(q: np.ndarray, n: np.ndarray, c: int) -> float:
    """``P(X >= c)`` for X the sum of ``n[g]`` independent trials of probability ``q[g]``.

    The generating function is evaluated on a circle through the saddle point for ``c`` and inverted by a discrete
    Fourier transform, which keeps the relative accuracy of tails far below 1e-16.
    """
    keep = (q > 0) & (n > 0)
    q, n = np.minimum(q[keep], 1 - 1e-12), n[keep].astype(float)
    total, mean = n.sum(), float((q * n).sum())
    if c <= 0:
        return 1.0
    if c > total + 1e-9:
        return 0.0
    rho = 1.0
    if c > mean:
        s = 0.0
        for _ in range(100):  # tilted mean = c
            e = np.exp(s)
            t = q * e / (1 - q + q * e)
            step = (c - (t * n).sum()) / max((t * (1 - t) * n).sum(), 1e-9)
            s += float(np.clip(step, -2, 2))
            if abs(step) < 1e-9 or s > 600:
                break
        rho = float(np.exp(min(s, 600)))
    tilted = q * rho / (1 - q + q * rho)
    m, sd = float((tilted * n).sum()), float(np.sqrt((tilted * (1 - tilted) * n).sum()))
    low, size = max(0, int(m - 10 * sd - 10)), int(20 * sd + 40)
    w = 2 * np.pi * np.arange(size) / size
    logs = (n[:, None] * np.log(1 - tilted[:, None] + tilted[:, None] * np.exp(1j * w))).sum(0) - 1j * w * low
    pmf = np.maximum(np.fft.fft(np.exp(logs)).real / size, 0)  # of low, low + 1, ...
    ks = low + np.arange(size)
    if rho == 1.0:
        return float(min(1.0, pmf[ks >= c].sum()))
    log_g = float((n * np.log1p(q * (rho - 1))).sum())
    upper = ks >= c
    return float(min(1.0, (pmf[upper] * np.exp(np.minimum(log_g - ks[upper] * np.log(rho), 0))).sum()))


def pair_counts(edges: DataFrame, min_count: int = 1, max_degree: float | None = None, block: int = 256) -> DataFrame:
    """``(a, b, c)``: in how many baskets both items occur, for pairs with ``c >= min_count``; item ids are numbers.

    ``edges`` is distinct ``(basket, item, n_item)``. A pair that reaches ``min_count`` occurs outside the
    ``min_count - 1`` largest baskets, so those make no pairs: membership in them is one bit each of an item's mask and
    is added to the pairs the others give. A long basket is cut into blocks and its pairs of blocks are spread
    over tasks. Items below ``min_count``, or above ``max_degree``, cannot qualify and are left out first.
    """
    able = edges.where(F.col("n_item") >= min_count)
    if max_degree is not None:
        able = able.where(F.col("n_item") <= max_degree)
    apart = min(min_count - 1, 30)
    sizes = able.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    largest = sizes.orderBy(F.desc("size"), "basket").limit(apart).select("basket", F.monotonically_increasing_id().cast("int").alias("bit")) if apart else None
    if largest is not None:
        largest = written(largest.coalesce(1), "largest-baskets")
        masks = able.join(F.broadcast(largest), "basket").groupBy("item").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("mask"))
        sizes = sizes.join(F.broadcast(largest), "basket", "left_anti")
    blocks = able.join(sizes, "basket").withColumn("part", F.pmod(F.xxhash64("item"), F.ceil(F.col("size") / block)).cast("int"))
    parts = F.ceil(F.col("size") / block).cast("int")
    # every pair of blocks (p, q), p <= q, of a basket meets once, under its own key
    left = blocks.select("basket", F.col("item").alias("i"), F.col("part").alias("p"), F.explode(F.sequence(F.col("part"), parts - 1)).alias("q"))
    right = blocks.select("basket", F.col("item").alias("j"), F.col("part").alias("q"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("p"))
    met = left.join(right, ["basket", "p", "q"]).where((F.col("p") < F.col("q")) | (F.col("i") < F.col("j")))
    counted = met.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.count("*").alias("c"))
    if largest is not None:
        ma, mb = (masks.select(F.col("item").alias(k), F.col("mask").alias(f"mask_{k}")) for k in "ab")
        counted = counted.where(F.col("c") + apart >= min_count).join(ma, "a", "left").join(mb, "b", "left").select(
            "a", "b", (F.col("c") + F.coalesce(F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b"))), F.lit(0))).alias("c"))
    return counted.where(F.col("c") >= min_count)


def surprising_pairs(df: DataFrame, basket: str, item: str, min_count: int = 5, min_lift: float = 0.0) -> DataFrame:
    """Pairs of items in at least ``min_count`` common baskets, against chance.

    ``(a, b, c, n_a, n_b, n, lift, expected, p_value, q_value)``, a before b: common baskets, baskets of each, baskets in all,
    ``c * n / (n_a * n_b)``, and under the bipartite configuration model (item frequencies and basket sizes kept) the
    expected count, the Poisson-binomial upper tail, and its Benjamini-Hochberg value over all possible pairs of items
    (pairs not returned count as tests that found nothing). ``min_lift`` leaves out pairs below it, and before pairing,
    items too frequent to reach it: the lift of a pair is at most ``n / max(n_a, n_b)``.

    Baskets and items that are NULL are ignored in pairs; a repeated item counts once in its basket; a basket whose
    item is NULL does not exist. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    raw = df.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item")).dropna().distinct()
    names = written(raw.groupBy("item").agg(F.count("*").alias("n_item")).withColumn("id", F.monotonically_increasing_id()), "items")
    edges = written(raw.join(names, "item").select("basket", F.col("id").alias("item"), "n_item"), "edges")
    degrees = edges.groupBy("basket").agg(F.count("*").alias("k")).groupBy(_class_column("k").alias("class")).agg(F.count("*").alias("n"), F.avg("k").alias("degree")).orderBy("class").toPandas()
    freqs = names.groupBy(_class_column("n_item").alias("class")).agg(F.count("*").alias("n"), F.avg("n_item").alias("degree")).orderBy("class").toPandas()
    n, n_items = int(degrees["n"].sum()), int(freqs["n"].sum())
    limit = n / min_lift if min_lift > 0 else None
    counted = pair_counts(edges, min_count, limit)
    na, nb = (names.select(F.col("id").alias(k), F.col("item").alias(f"name_{k}"), F.col("n_item").alias(f"n_{k}")) for k in "ab")
    pairs = counted.join(na, "a").join(nb, "b").withColumn("lift", F.col("c") * F.lit(n).cast("double") / (F.col("n_a") * F.col("n_b")))
    if min_lift > 0:
        pairs = pairs.where(F.col("c") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    lo, hi = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    pairs = written(pairs.withColumns({"lo": lo, "hi": hi}).withColumn("lo", _class_column("lo")).withColumn("hi", _class_column("hi")), "pairs")

    x, y = fit_configuration(degrees["degree"].to_numpy(), degrees["n"].to_numpy(), freqs["degree"].to_numpy(), freqs["n"].to_numpy())
    fitness, trials = dict(zip(freqs["class"].tolist(), y)), degrees["n"].to_numpy()

    def tails(batches):
        for t in batches:
            out = []
            for lo_, hi_, c in zip(t["lo"], t["hi"], t["c"]):
                pa, pb = x * fitness[lo_], x * fitness[hi_]
                q = pa / (1 + pa) * pb / (1 + pb)
                out.append((lo_, hi_, c, float((q * trials).sum()), poisson_binomial_tail(q, trials, int(c))))
            yield pd.DataFrame(out, columns=["lo", "hi", "c", "expected", "p_value"])

    # a number that is not adapted: few rows, but much work for each
    kinds = pairs.select("lo", "hi", "c").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    judged = written(kinds.mapInPandas(tails, "lo int, hi int, c long, expected double, p_value double"), "tails")
    tests = n_items * (n_items - 1) / 2
    ranks = _false_discovery(pairs.join(judged, ["lo", "hi", "c"]), tests)
    smaller = F.col("name_a") < F.col("name_b")
    pick = lambda p, q: F.when(smaller, F.col(p)).otherwise(F.col(q))
    return ranks.select(
        pick("name_a", "name_b").alias("a"), pick("name_b", "name_a").alias("b"), "c", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"),
        F.lit(n).cast("long").alias("n"), "lift", "expected", "p_value", "q_value")


def _false_discovery(pairs: DataFrame, tests: float, bins_per_unit: int = 64) -> DataFrame:
    """Adds ``q_value`` (Benjamini-Hochberg) from a histogram of ``-log10 p`` instead of a global sort.

    A bin is 1/64 of a decade wide and p-values end at 1e-300, so the histogram has at most 19,201 rows; each p-value
    gets the value of its bin's upper edge, which is conservative by at most 3.7 %.
    """
    bin_ = F.floor(-F.log10(F.greatest(F.col("p_value"), F.lit(1e-300))) * bins_per_unit).cast("int")
    held = pairs.withColumn("bin", bin_)
    counts = held.groupBy("bin").agg(F.count("*").alias("n")).toPandas().sort_values("bin", ascending=False)
    rank = counts["n"].cumsum().to_numpy(float)
    edge = 10.0 ** (-counts["bin"].to_numpy(float) / bins_per_unit)
    q = np.minimum(1.0, edge * tests / np.maximum(rank, 1))
    q = np.minimum.accumulate(q[::-1])[::-1] if len(q) else q
    table = pairs.sparkSession.createDataFrame(pd.DataFrame({"bin": counts["bin"].astype("int32"), "q_value": q}), "bin int, q_value double")
    return held.join(F.broadcast(table), "bin").drop("bin")
