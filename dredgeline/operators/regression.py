"""Rating prediction by boosted trees over user and business features."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("x0", "x1", "x2", "x3")


def rating_features(rated: DataFrame, users: DataFrame, businesses: DataFrame, missing: str = "zero") -> DataFrame:
    """``(user_id, business_id, x0..x3, y)``: useful, funny, latitude, longitude of each rating; ``y`` its stars if it has any.

    With ``missing='zero'``, all four are 0 where the user, the business, or one of the values is missing; with ``'error'`` a
    missing one raises when the rows are read. One row for each row of ``rated``: repeated dimension rows count once.
    """
    u = users.where("user_id is not null").groupBy("user_id").agg(F.max("useful").alias("x0"), F.max("funny").alias("x1"))
    b = businesses.where("business_id is not null").groupBy("business_id").agg(F.max("latitude").alias("x2"), F.max("longitude").alias("x3"))
    joined = rated.join(u, "user_id", "left").join(b, "business_id", "left")
    known = F.coalesce(F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("x3").isNotNull() & ~F.isnan("x2") & ~F.isnan("x3"), F.lit(False))
    absent = F.lit(0.0) if missing == "zero" else F.raise_error(F.lit("a rating lacks a feature")).cast("double")
    y = F.col("stars").cast("double") if "stars" in rated.columns else F.lit(None).cast("double")
    return joined.select("user_id", "business_id", *(F.when(known, F.col(x).cast("double")).otherwise(absent).alias(x) for x in FEATURES), y.alias("y"))


class Trees:
    """Boosted regression trees over features cut into bins: a sum of trees of the same depth, from ``base`` on.

    ``cuts`` has for each feature the upper ends of its bins but the last. Node k of a tree has the children ``2 k + 1`` and
    ``2 k + 2``; ``feature[t, k]`` and ``upto[t, k]`` say that bins up to that one go left, ``leaf[t]`` what is added below.
    """

    def __init__(self, base: float, cuts: list[list[float]], feature: np.ndarray, upto: np.ndarray, leaf: np.ndarray):
        self.base, self.cuts, self.feature, self.upto, self.leaf = base, cuts, feature, upto, leaf

    def bins(self) -> list[Column]:
        """The bin of each feature of a row."""
        return [sum((F.when(F.col(x) > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int").alias(f"b{k}") for k, (x, cuts) in enumerate(zip(FEATURES, self.cuts))]

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """The sum for each row of bins."""
        rows, total = np.arange(len(bins)), np.full(len(bins), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, upto, leaf in zip(self.feature, self.upto, self.leaf):
            at = np.zeros(len(bins), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (bins[rows, feature[at]] > upto[at])
            total += leaf[at - len(leaf) + 1]
        return total

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}
        spark.createDataFrame([(json.dumps(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        parts = json.loads(spark.read.text(path).first().value)
        return cls(parts["base"], parts["cuts"], np.array(parts["feature"], int), np.array(parts["upto"], int), np.array(parts["leaf"], float))


def boosted(bins: np.ndarray, n: np.ndarray, total: np.ndarray, base: float, width: int, rounds: int, step: float, depth: int, subsample: float,
            columns: float, l2: float, draw: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trees of boosting squared errors over cells: ``n`` rows of the sum ``total`` in each row of ``bins``.

    Rows of a cell are alike to the trees, so a cell stands for them: a round sees a binomial share of its rows. Levels
    grow by the best split of each node over ``columns`` of the features, if both sides keep one row at least.
    """
    inner, leaves = 2**depth - 1, 2**depth
    predicted, mean = np.full(len(n), base), total / n
    score = lambda g, w: g**2 / np.maximum(w + l2, 1e-12)
    for _ in range(rounds):
        weight = draw.binomial(n, subsample) if subsample < 1 else n
        rest = weight * (mean - predicted)
        used = draw.choice(bins.shape[1], max(1, int(columns * bins.shape[1])), replace=False)
        feature, upto = np.zeros(inner, int), np.full(inner, width)
        at = np.zeros(len(n), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.zeros(nodes)
            for f in used:
                key = local * width + bins[:, f]
                g = np.bincount(key, rest, nodes * width).reshape(nodes, width).cumsum(1)
                w = np.bincount(key, weight, nodes * width).reshape(nodes, width).cumsum(1)
                gr, wr = g[:, -1:] - g, w[:, -1:] - w
                gain = score(g, w) + score(gr, wr) - score(g[:, -1:], w[:, -1:])
                gain = np.where((w >= 1) & (wr >= 1), gain, 0.0)
                cut = gain.argmax(1)
                top = gain[np.arange(nodes), cut]
                better = top > best + 1e-12
                best[better] = top[better]
                feature[first:first + nodes][better], upto[first:first + nodes][better] = f, cut[better]
            at = 2 * at + 1 + (bins[np.arange(len(n)), feature[at]] > upto[at])
        leaf_of = at - inner
        w = np.bincount(leaf_of, weight, leaves)
        leaf = step * np.bincount(leaf_of, rest, leaves) / np.maximum(w + l2, 1e-12)
        predicted += leaf[leaf_of]
        yield feature, upto, leaf


def fit_ratings(features: DataFrame, rounds: int = 1000, step: float = 0.01, depth: int = 6, subsample: float = 0.85, columns: float = 0.9,
                bins: int = 32, l2: float = 1.0, seed: int = 7) -> Trees:
    """Boosted trees on the rows with a ``y``.

    Each feature is cut at its approximate quantiles into ``bins``. One aggregation then makes of all rows at most
    ``bins ** 4`` cells (1,048,576) with their counts and sums of ``y``, which is all that trees for squared errors need; on
    those, whose number does not grow with the data, the rounds run in the driver's memory, and none reads the data again.
    """
    rated = features.where("y is not null and not isnan(y)").select(*FEATURES, "y")
    quantiles = rated.approxQuantile(list(FEATURES), [k / bins for k in range(1, bins)], 1 / (8 * bins))
    empty = np.zeros((0, 2**depth - 1), int)
    trees = Trees(0.0, [sorted(set(q)) for q in quantiles], empty, empty, np.zeros((0, 2**depth)))
    cells = rated.groupBy(*trees.bins()).agg(F.count("*").alias("n"), F.sum("y").alias("total")).orderBy("b0", "b1", "b2", "b3").toPandas()
    if not len(cells):
        return trees
    n, total = cells["n"].to_numpy(), cells["total"].to_numpy(float)
    trees.base = float(total.sum() / n.sum())
    grown = boosted(cells[[f"b{k}" for k in range(4)]].to_numpy(np.int64), n, total, trees.base, bins, rounds, step, depth, subsample, columns, l2, np.random.default_rng(seed))
    parts = list(zip(*grown))
    if parts:
        trees.feature, trees.upto, trees.leaf = (np.stack(p) for p in parts)
    return trees


def predict_ratings(model: Trees, features: DataFrame) -> DataFrame:
    """``(user_id, business_id, stars)``, not clipped. Each distinct cell goes through the trees once."""
    names = [f"b{k}" for k in range(4)]
    placed = features.select("user_id", "business_id", *model.bins())

    def predict(batches):
        for t in batches:
            yield t.assign(stars=model.predict(t[names].to_numpy(np.int64)))

    cells = placed.select(*names).distinct().mapInPandas(predict, ", ".join(f"{b} int" for b in names) + ", stars double")
    return placed.join(cells, names).select("user_id", "business_id", "stars")
