"""Collaborative filtering by Pearson correlation over co-rated items, and rating prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import universal
from ..session import written
from . import neighbours
from .pairs import dense_index, few_meet, met_by_item, shared_counts

#: The rating where neither a neighbour nor an average is known, a fixed value.
DEFAULT_STARS = 3.83


def ratings(reviews: DataFrame) -> DataFrame:
    """``(user_id, business_id, stars)``: the latest readable rating of each pair, by date, then stars."""
    rows = reviews.where("user_id is not null and business_id is not null and stars is not null")
    latest = F.max(F.struct(F.coalesce("date", F.lit("")).alias("date"), "stars")).alias("last")
    return rows.groupBy("user_id", "business_id").agg(latest).select("user_id", "business_id", "last.stars")


def entity_averages(reviews: DataFrame, key: str) -> DataFrame:
    """``(key, avg_stars)`` over all readable ratings."""
    return reviews.where(F.col(key).isNotNull() & F.col("stars").isNotNull()).groupBy(key).agg(F.avg("stars").alias("avg_stars"))


def _pearson() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy")]


def _correlation() -> Column:
    """From sums, which are exact for whole stars; 0 where a side does not vary."""
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    return F.when(spread > 0, (n * F.col("sxy") - sx * sy) / F.sqrt(spread)).otherwise(0.0)


def _correlated(pairs: DataFrame, rated: DataFrame, record: str, other: str, names: tuple[str, str]) -> DataFrame:
    """Positive correlations of the given pairs ``(a, b)`` over what both have rated."""
    rows = rated.select(F.col(record).alias("r"), F.col(other).alias("o"), "stars")
    x = pairs.select("a", "b").join(rows.select(F.col("r").alias("a"), "o", F.col("stars").alias("x")), "a")
    both = x.join(rows.select(F.col("r").alias("b"), "o", F.col("stars").alias("y")), ["b", "o"])
    return _similar(both.groupBy("a", "b").agg(*_pearson()), names)


def _similar(sums: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Positive correlations from the sums of the pairs ``(a, b)``."""
    return sums.select(F.col("a").alias(names[0]), F.col("b").alias(names[1]), _correlation().alias("sim")).where(F.col("sim") > 0)


def item_cf_model(rated: DataFrame, min_corated: int = 3) -> DataFrame:
    """``(b1, b2, sim)``, ``b1 < b2``: businesses that ``min_corated`` users have rated both, of positive correlation.

    The sums of a pair are made where it meets, user by user, unless some users rate so much that these pairs are too many.
    """
    if few_meet(rated, "user_id"):
        rows = rated.select(F.col("business_id").alias("r"), F.col("user_id").alias("i"), F.col("stars").alias("v"))
        return _similar(met_by_item(rows, min_corated, *_pearson()), ("b1", "b2"))
    return _correlated(shared_counts(rated, "business_id", "user_id", min_corated), rated, "business_id", "user_id", ("b1", "b2"))


def _able(rated: DataFrame, min_corated: int) -> DataFrame:
    """Ratings of businesses with ``min_corated`` raters by users with so many ratings of those."""
    raters = rated.groupBy("business_id").count().where(F.col("count") >= min_corated).select("business_id")
    able = rated.join(raters, "business_id", "left_semi")
    active = able.groupBy("user_id").count().where(F.col("count") >= min_corated).select("user_id")
    return written(able.join(active, "user_id", "left_semi"), "able")  # read many times below


def _similar_users(keys: DataFrame, min_corated: int, min_jaccard: float, lsh: bool) -> neighbours.Rule:
    m = 2 * max(1, keys.count())
    return neighbours.Rule(min_corated, min_jaccard, neighbours.minhash_rule(30, 23_333_333_333, m, 2, 999_999) if lsh else None)


def _large_pairs(sets: DataFrame, rule: neighbours.Rule) -> DataFrame | None:
    """``(a, b, sim)``, ``a < b``, where one has more items than :func:`neighbours.small_pairs` looks at; None if none has."""
    large = F.col("n") > neighbours.LARGE
    if sets.where(large).isEmpty():
        return None
    flat = sets.where(F.col("n") >= rule.least).select("r", "n", F.explode(F.arrays_zip("keys", "vals")).alias("e")).select("r", "n", F.col("e.keys").alias("key"), F.col("e.vals").alias("v")).where("key >= 0")
    x, y = (flat.withColumnsRenamed({"r": k, "n": f"n{k}", "v": v}) for k, v in (("a", "x"), ("b", "y")))
    once = (F.col("nb") <= neighbours.LARGE) | (F.col("a") < F.col("b"))
    met = x.where(F.col("na") > neighbours.LARGE).join(y, "key").where((F.col("a") != F.col("b")) & once).groupBy("a", "b", "na", "nb").agg(*_pearson())
    met = met.where((F.col("n") >= rule.least) & (F.col("n") >= rule.min_jaccard * (F.col("na") + F.col("nb") - F.col("n"))))
    if rule.hashes:
        hashes, p, m = rule.hashes
        number = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
        sigs = flat.groupBy("r").agg(*(F.min(universal(number, a, b, p, m)).alias(f"h{k}") for k, (a, b) in enumerate(hashes))).select("r", F.array(*(f"h{k}" for k in range(len(hashes)))).alias("sig"))
        sa, sb = (sigs.select(F.col("r").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
        met = met.join(sa, "a").join(sb, "b").where(F.exists(F.zip_with("sig_a", "sig_b", lambda p, q: p == q), lambda e: e))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _correlation().alias("sim")).where(F.col("sim") > 0)


def _compared(sets: DataFrame, rule: neighbours.Rule, names: tuple[str, str]) -> DataFrame:
    small, large = neighbours.small_pairs(sets, rule), _large_pairs(sets, rule)
    return (small if large is None else small.unionByName(large)).toDF(*names, "sim")


def user_cf_model(rated: DataFrame, min_corated: int = 3, min_jaccard: float = 0.01, lsh: bool = True) -> DataFrame:
    """``(u1, u2, sim)``, ``u1 < u2``: users with ``min_corated`` common businesses, similar enough, of positive correlation.

    Users of fewer ratings, and businesses of fewer raters, than ``min_corated`` are left out. With ``lsh``, only users
    whose MinHash signatures agree somewhere count as similar. Users are compared in the tasks where they meet, so those
    who share but a popular business are never paired, and no pair is moved.
    """
    able = _able(rated, min_corated)
    keys = written(neighbours.item_keys(able, "business_id"), "keys")
    rows = able.join(keys, "business_id").select(F.col("user_id").alias("r"), "key", F.col("stars").alias("v"))
    return _compared(written(neighbours.packed(rows), "users"), _similar_users(keys, min_corated, min_jaccard, lsh), ("u1", "u2"))


def _wanted(pairs: DataFrame, rated: DataFrame) -> DataFrame:
    """Distinct pairs whose user and business are both known."""
    asked = pairs.select("user_id", "business_id").dropna().distinct()
    return asked.join(rated.select("user_id").distinct(), "user_id", "left_semi").join(rated.select("business_id").distinct(), "business_id", "left_semi")


def item_cf_predict(pairs: DataFrame, rated: DataFrame, model: DataFrame, averages: DataFrame, k: int = 3, default: float = DEFAULT_STARS) -> DataFrame:
    """``(user_id, business_id, stars)``: the mean of the user's ratings of the ``k`` most similar businesses, weighted by
    similarity; without any, the business's average, or ``default``. Pairs of unknown ids are left out."""
    asked = _wanted(pairs, rated)
    sims = model.select(F.col("b1").alias("business_id"), F.col("b2").alias("near"), "sim").unionByName(model.select(F.col("b2").alias("business_id"), F.col("b1").alias("near"), "sim"))
    seen = asked.join(rated.select("user_id", F.col("business_id").alias("near"), F.col("stars").alias("r")), "user_id").join(sims, ["business_id", "near"])
    rank = F.row_number().over(Window.partitionBy("user_id", "business_id").orderBy(F.desc(F.round("sim", 9)), "near"))
    best = seen.withColumn("k", rank).where(F.col("k") <= k).groupBy("user_id", "business_id").agg((F.sum(F.col("r") * F.col("sim")) / F.sum("sim")).alias("p"))
    known = averages.select("business_id", "avg_stars")
    return asked.join(best, ["user_id", "business_id"], "left").join(known, "business_id", "left").select("user_id", "business_id", F.coalesce("p", "avg_stars", F.lit(default)).alias("stars"))


def _moved(asked: DataFrame, rated: DataFrame, model: DataFrame, averages: DataFrame, default: float) -> DataFrame:
    """``(user_id, business_id, num, den)`` of the asked pairs: of the similar users' ratings of the business, the sums of
    ``sim`` times how far they lie from their averages, and of ``sim``."""
    sims = model.select(F.col("u1").alias("user_id"), F.col("u2").alias("near"), "sim").unionByName(model.select(F.col("u2").alias("user_id"), F.col("u1").alias("near"), "sim"))
    near = asked.join(sims, "user_id")
    theirs = rated.select(F.col("user_id").alias("near"), "business_id", F.col("stars").alias("r")).join(averages.select(F.col("user_id").alias("near"), F.col("avg_stars").alias("avg_near")), "near", "left")
    return near.join(theirs, ["near", "business_id"]).groupBy("user_id", "business_id").agg(
        F.sum((F.col("r") - F.coalesce("avg_near", F.lit(default))) * F.col("sim")).alias("num"), F.sum("sim").alias("den"))


def _moved_where_met(asked: DataFrame, rated: DataFrame, averages: DataFrame, default: float, min_corated: int = 3, min_jaccard: float = 0.01) -> DataFrame:
    """:func:`_moved` by the pairs of :func:`user_cf_model`, summed up in the tasks that find them."""
    able = _able(rated, min_corated)
    common = written(neighbours.item_keys(able, "business_id"), "keys")
    rule = _similar_users(common, min_corated, min_jaccard, True)
    # asked businesses on which users are not compared
    others = dense_index(asked.join(common, "business_id", "left_anti"), "business_id")
    keys = written(common.unionByName(others.select("business_id", (-1 - F.col("idx")).alias("key"))), "all-keys")
    rows = rated.join(able.select("user_id").distinct(), "user_id", "left_semi").join(keys, "business_id")
    asks = asked.join(keys, "business_id").groupBy(F.col("user_id").alias("r")).agg(F.collect_list("key").alias("asks"))
    sets = neighbours.packed(rows.select(F.col("user_id").alias("r"), "key", F.col("stars").alias("v"))).join(asks, "r", "left").join(averages.withColumnRenamed("user_id", "r"), "r", "left")
    sets = written(sets.select("r", "n", "keys", "vals", F.coalesce("asks", F.array().cast("array<bigint>")).alias("asks"), F.coalesce("avg_stars", F.lit(default)).alias("mean")), "users")
    moved = neighbours.moved_by_small_pairs(sets, rule).join(keys, "key").select(F.col("r").alias("user_id"), "business_id", "num", "den")
    if (large := _large_pairs(sets, rule)) is not None:
        moved = moved.unionByName(_moved(asked, rated, large.toDF("u1", "u2", "sim"), averages, default))
    return moved


def user_cf_predict(pairs: DataFrame, rated: DataFrame, model: DataFrame | None, averages: DataFrame, default: float = DEFAULT_STARS) -> DataFrame:
    """``(user_id, business_id, stars)``: the user's average plus the weighted mean of how far similar users' ratings of the
    business lie from their averages; without any, the user's average, or ``default``. Pairs of unknown ids are left out.

    Without ``model``, similar users are those of :func:`user_cf_model`, of which no pair is moved.
    """
    asked = written(_wanted(pairs, rated), "asked")
    moved = _moved_where_met(asked, rated, averages, default) if model is None else _moved(asked, rated, model, averages, default)
    delta = moved.groupBy("user_id", "business_id").agg((F.sum("num") / F.sum("den")).alias("delta"))
    base = asked.join(averages.select("user_id", "avg_stars"), "user_id", "left").join(delta, ["user_id", "business_id"], "left")
    return base.select("user_id", "business_id", (F.coalesce("avg_stars", F.lit(default)) + F.coalesce("delta", F.lit(0.0))).alias("stars"))
