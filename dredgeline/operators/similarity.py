"""Set similarity: dense ids, MinHash signatures, banding, exact Jaccard joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import coefficients, universal
from ..session import written
from .pairs import dense_index, few_meet, met_by_item, ordered_sets, similarity, within  # noqa: F401


def minhash(sets: DataFrame, record: str, item: str, n_hashes: int = 30, m: int | None = None, p: int = 233_333_333_333,
            seed: int = 2, coefficient_bound: int = 99_999) -> DataFrame:
    """``(record, sig)``: for each hash function the least hash of the record's item numbers. ``item`` is a number.

    ``m`` is twice the number of distinct items if not given. One aggregation with map-side combine.
    """
    if m is None:
        m = 2 * max(1, sets.agg(F.count_distinct(item)).first()[0])
    functions = coefficients(seed, n_hashes, 1, coefficient_bound, 0)
    least = [F.min(universal(F.col(item).cast("long"), a, b, p, m)).alias(f"h{k}") for k, (a, b) in enumerate(functions)]
    rows = sets.where(F.col(record).isNotNull() & F.col(item).isNotNull())
    return rows.groupBy(record).agg(*least).select(record, F.array(*(f"h{k}" for k in range(n_hashes))).alias("sig"))


def lsh_candidates(signatures: DataFrame, record: str, bands: int = 30) -> DataFrame:
    """``(id1, id2)``, ``id1 < id2``: records whose signatures agree in all rows of some band.

    Records of equal signatures meet once, as one; every pair of records is then made from the pairs of signatures.
    """
    named = written(signatures.select(F.col(record).alias("id"), "sig"), "signatures")
    classes = named.groupBy("sig").agg(F.min("id").alias("rep"))
    members = named.join(classes, "sig").select("id", "rep")
    rows = F.ceil(F.size("sig") / bands).cast("int")
    banded = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.slice("sig", k * rows + 1, rows))).alias("band", "value")).where(F.size("value") > 0)
    x, y = (banded.select(F.col("rep").alias(k), "band", "value") for k in ("x", "y"))
    met = x.join(y, ["band", "value"]).where(F.col("x") <= F.col("y")).select("x", "y").distinct()
    a, b = (members.select(F.col("id").alias(f"id_{k}"), F.col("rep").alias(k)) for k in ("x", "y"))
    both = met.join(a, "x").join(b, "y").where((F.col("x") != F.col("y")) | (F.col("id_x") < F.col("id_y")))
    return both.select(F.least("id_x", "id_y").alias("id1"), F.greatest("id_x", "id_y").alias("id2"))


def lsh_join(df: DataFrame, record: str, item: str, signatures: DataFrame, threshold: float, bands: int = 30) -> DataFrame:
    """``(id1, id2, sim)`` of the pairs of :func:`lsh_candidates` with a Jaccard similarity of ``threshold`` or more.

    Most candidates of short bands share next to nothing, and to look at one costs all items of a record. So where few
    pairs meet item by item, they are measured first, and of the similar ones those whose signatures agree in a band stay.
    """
    rows = df.select(F.col(record).alias("r"), F.col(item).alias("i")).dropna().distinct()
    if threshold <= 0 or not few_meet(rows, "i"):
        return jaccard_join(df, record, item, threshold, lsh_candidates(signatures, record, bands))
    named = written(signatures.select(F.col(record).alias("id"), "sig"), "signatures")
    a, b = (named.select(F.col("id").alias(f"id{k}"), F.col("sig").alias(f"sig{k}")) for k in (1, 2))
    rows_ = F.ceil(F.size("sig1") / bands).cast("int")
    part = lambda sig, k: F.slice(sig, k * rows_ + 1, rows_)
    agree = F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: (F.size(part("sig1", k)) > 0) & (part("sig1", k) == part("sig2", k)))
    return jaccard_join(df, record, item, threshold).join(a, "id1").join(b, "id2").where(agree).select("id1", "id2", "sim")


#: The threshold from which sets are joined by their rarest items, and the number of items that one row may hold.
PREFIX, LARGE = 0.2, 20_000


def _large_pairs(sized: DataFrame, threshold: float) -> DataFrame:
    """``(id1, id2)`` of compatible sizes that share an item, at least one of them with more than ``LARGE`` items."""
    big = sized.where(F.col("n") > threshold * LARGE)
    x, y = (big.select("i", F.col("r").alias(f"id{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    fits = (F.col("id1") < F.col("id2")) & (F.greatest("n1", "n2") > LARGE) & (F.least("n1", "n2") >= threshold * F.greatest("n1", "n2"))
    return x.join(y, "i").where(fits).select("id1", "id2").distinct()


def jaccard_join(df: DataFrame, record: str, item: str, threshold: float = 0.055, candidates: DataFrame | None = None) -> DataFrame:
    """``(id1, id2, sim)``, ``id1 < id2``, of records whose item sets have a Jaccard similarity of ``threshold`` or more.

    Exact over all pairs that share an item, or over ``candidates(id1, id2)`` only. From ``PREFIX`` on, sets meet on
    their rarest items, so popular ones make no pairs; below, nearly all items would be rare enough, and what shares one
    item is often a result, so pairs are counted item by item. So are, at any threshold, sets above ``LARGE`` items,
    which are not held in one row.
    """
    rows = df.select(F.col(record).alias("r"), F.col(item).alias("i")).dropna().distinct()
    sizes = rows.groupBy("r").agg(F.count("*").alias("n"))
    if candidates is None and threshold >= PREFIX:
        sized = rows.join(sizes, "r")
        sets = written(ordered_sets(sized.where(F.col("n") <= LARGE).select(F.col("r").alias("record"), F.col("i").alias("item"))), "sets")
        small = within(sets, sets, sets, threshold, once=True)
        found = small.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), similarity().alias("sim"))
        large = jaccard_join(sized.where(F.col("n") > threshold * LARGE), "r", "i", threshold, _large_pairs(sized, threshold))
        return found.unionByName(large)
    if candidates is None:
        # sizes go along as values, so what is not similar is left out before it is named
        met = met_by_item(rows.join(sizes, "r").withColumnRenamed("n", "v"), 1, F.max("x").alias("n1"), F.max("y").alias("n2"))
        sized = met.select(F.col("a").alias("id1"), F.col("b").alias("id2"), "n1", "n2", "shared")
    else:
        x = candidates.select("id1", "id2").join(rows.select(F.col("r").alias("id1"), "i"), "id1")
        shared = x.join(rows.select(F.col("r").alias("id2"), "i"), ["id2", "i"]).groupBy("id1", "id2").agg(F.count("*").alias("shared"))
        sized = shared.join(sizes.select(F.col("r").alias("id1"), F.col("n").alias("n1")), "id1").join(sizes.select(F.col("r").alias("id2"), F.col("n").alias("n2")), "id2")
    sim = F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))
    return sized.select("id1", "id2", sim.alias("sim")).where(F.col("sim") >= threshold)
