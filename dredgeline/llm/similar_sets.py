"""All pairs of records whose value sets overlap strongly, by metric pivot partitioning under Jaccard distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import measured, similarity, size_class, within
from ..session import written

def record_sets(df: DataFrame, record: str, item: str, min_size: int = 1) -> DataFrame:
    """Distinct non-null ``(record, item)`` with the item's frequency ``df`` and the record's set size ``n``."""
    pairs = df.select(F.col(record).alias("record"), F.col(item).alias("item")).dropna().distinct()
    sizes = pairs.groupBy("record").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= min_size)
    held = pairs.join(sizes, "record")
    return held.join(held.groupBy("item").agg(F.count("*").alias("df")), "item")


def net(sets: DataFrame, radius: float) -> DataFrame:
    """``(record, cell, d)`` of the records with another one within ``radius``: the pivot they are at home with, and its distance.

    Of records within ``radius`` of each other, one whose number (a hash of the key) is least among all that are near to it is
    a pivot, and the others are at home with the nearest pivot that they are near to.
    """
    near = within(sets, sets, sets, 1 - radius, once=True).select("a", "b", (1 - similarity()).alias("d"))
    near = written(near.select("a", "b", "d").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")), "near")
    number = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("k"))
    least = near.groupBy("a").agg(F.min(number("b")).alias("other")).where(number("a") < F.col("other"))
    pivots = written(least.select(F.col("a").alias("cell")), "pivots")
    nearest = near.join(pivots, near["b"] == pivots["cell"]).groupBy("a").agg(F.min(F.struct("d", "cell")).alias("best"))
    homes = nearest.select(F.col("a").alias("record"), "best.cell", "best.d")
    return homes.unionByName(pivots.select(F.col("cell").alias("record"), "cell", F.lit(0.0).alias("d")))


def pivot_cells(sets: DataFrame, radius: float) -> DataFrame:
    """``(record, cell, d)`` of every record: its home, the cell of its nearest pivot, and the distance to that.

    Pivots are a :func:`net`, to which each record without a pivot near to it belongs as a pivot itself. So every record is
    within ``radius`` of its pivot.
    """
    return sets.select("record").join(net(sets, radius), "record", "left").select("record", F.coalesce("cell", "record").alias("cell"), F.coalesce("d", F.lit(0.0)).alias("d"))


def cell_guests(sets: DataFrame, homes: DataFrame, threshold: float, radius: float) -> DataFrame:
    """``(cell, record, R, d, na, nb, shared)``: the records replicated to a cell they are not at home in.

    If x is at home in the cell of pivot p with the largest distance R of a home to it, and y is within ``1 - threshold`` of
    x, then ``d(y, p) <= d(x, p) + d(x, y) <= R + 1 - threshold``; all y within that bound are guests of the cell. A pair has
    met if either of the two is a guest in the other's cell, so only one of two cells takes the guest: of a cell of several
    records and one of a single record the former, of two of several that of the smaller pivot, of two of one that of the
    smaller set. ``na``, ``nb`` and ``shared`` are those of the pivot and the guest, whose distance is thereby exact.

    ``homes`` is the :func:`net`; cells of a single record have R = 0 and no rows in it. Distances come from an index of the
    rarest items of pivots and records, at the bound of the cell's kind.
    """
    reach = 1 - threshold
    lone = sets.join(homes.select("record"), "record", "left_anti")
    of_lone = within(lone, lone, sets, threshold, once=True).withColumn("R", F.lit(0.0))
    cells = homes.groupBy("cell").agg(F.max("d").alias("R"))
    pivots = sets.join(cells.select(F.col("cell").alias("record")), "record", "left_semi")
    found = within(pivots, sets, sets, max(threshold - radius, 1e-6), once=False)
    found = found.join(cells.withColumnRenamed("cell", "a"), "a").join(homes.select(F.col("record").alias("b"), F.col("cell").alias("home")), "b", "left")
    guests = of_lone.unionByName(found.where(F.col("home").isNull() | (F.col("home") > F.col("a"))).drop("home"))
    guests = guests.withColumn("d", 1 - similarity()).where(F.col("d") <= F.col("R") + reach + 1e-9)
    return guests.select(F.col("a").alias("cell"), F.col("b").alias("record"), "R", "d", "na", "nb", "shared")


def cell_pairs(sets: DataFrame, threshold: float, radius: float) -> DataFrame:
    """``(cell, a, b, na, nb, shared)``: the similar pairs, each once, with the cell in which the two met.

    Within a cell, homes meet homes and guests unless the triangle inequality keeps them apart, ``|d(x, p) - d(y, p)| > 1 -
    threshold``. The pivot's own pairs with guests are known by their distance, all others are measured. Homes are so near to
    their pivot, twice the radius being at most ``1 - threshold``, that all of them are similar: a crowded cell makes no pairs
    in vain.
    """
    reach = 1 - threshold
    homes = written(net(sets, radius), "homes")
    guests = written(cell_guests(sets, homes, threshold, radius), "guests")
    of_pivot = guests.where(F.col("d") <= reach + 1e-9).select("cell", F.col("cell").alias("a"), F.col("record").alias("b"), "na", "nb", "shared")
    inside = homes.select("cell", "record", "d", F.lit(True).alias("home")).unionByName(guests.where("R > 0").select("cell", "record", "d", F.lit(False).alias("home")))
    x = homes.where(F.col("record") != F.col("cell")).select("cell", F.col("record").alias("x"), F.col("d").alias("dx"))
    y = inside.select("cell", F.col("record").alias("y"), F.col("d").alias("dy"), "home")
    # of two homes the later one, or the one that is not the pivot, looks for the other
    once = ~F.col("home") | (F.col("y") == F.col("cell")) | (F.col("y") < F.col("x"))
    met = x.join(y, "cell").where(once & (F.col("x") != F.col("y")) & (F.abs(F.col("dx") - F.col("dy")) <= reach + 1e-9))
    met = written(met.select("cell", F.col("x").alias("a"), F.col("y").alias("b")), "met")
    found = met.join(measured(met.select("a", "b"), sets), ["a", "b"]).select("cell", "a", "b", "na", "nb", "shared")
    return of_pivot.unionByName(found)


def _join_large(big: DataFrame, threshold: float, above: int) -> DataFrame:
    """Exact pairs of which one set has more than ``above`` items, item by item, without holding a set in one row.

    ``big`` has the ``(record, item, n, df)`` of all sets above ``threshold * above``. Two similar sets share one of the rarest
    items of each, as in :func:`~dredgeline.operators.pairs.prefix`; here those are all items up to a quantile of the set's item
    frequencies that is surely far enough. Candidates are then counted over all items, with map-side combine.
    """
    enough = min(1.0, 1 - threshold + max(0.01, 3 / (threshold * above)))
    cut = big.groupBy("record").agg(F.percentile_approx("df", enough, 10_000).alias("cut"))
    rare = big.join(cut, "record").where((F.col("df") <= F.col("cut")) & (F.col("df") > 1)).withColumn("class", size_class(threshold))
    x = rare.where(F.col("n") > above).select("item", "class", F.col("record").alias("a"), F.col("n").alias("na"))
    y = rare.select("item", F.explode(F.array("class", F.col("class") + 1)).alias("class"), F.col("record").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") >= F.col("nb")) & (F.col("nb") >= F.ceil(threshold * F.col("na") - 1e-9)) & ((F.col("na") > F.col("nb")) | (F.col("a") < F.col("b")))
    candidates = x.join(y, ["item", "class"]).where(fits).select("a", "b", "na", "nb").distinct()
    held = candidates.join(big.select(F.col("record").alias("b"), "item"), "b")
    return held.join(big.select(F.col("record").alias("a"), "item"), ["a", "item"]).groupBy("a", "b", "na", "nb").agg(F.count("*").cast("int").alias("shared"))


def similar_sets(df: DataFrame, record: str, item: str, threshold: float = 0.5, min_size: int = 1, radius: float | None = None,
                 large: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Pairs of records whose item sets have a Jaccard similarity of ``threshold`` or more.

    Returns ``(pairs, members)``. ``members(record, rep)`` gives each record with at least ``min_size`` items the
    smallest record with exactly the same set; ``pairs(a, b, na, nb, shared, similarity)`` has each pair of such
    representatives once, the smaller record first. :func:`expand_pairs` gives the pairs of all records.

    NULL records and items are ignored, a repeated item counts once, other columns are not read, an empty table gives
    no rows. ``radius`` is that of the cells (see :func:`net`), at most half of ``1 - threshold``. Sets of more than
    ``large`` items go through :func:`_join_large`. The result depends on neither.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    radius = 0.4 * min(1 - threshold, threshold) if radius is None else radius
    if not 0 <= radius <= (1 - threshold) / 2 + 1e-12:
        raise ValueError("radius must be in [0, (1 - threshold) / 2]")
    held = written(record_sets(df, record, item, min_size), "record-sets")
    small = (
        held.where(F.col("n") <= large).groupBy("record", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("ordered"))
        .withColumn("copy", F.md5(F.to_json("ordered.item")))
    )
    classes = small.groupBy("copy").agg(F.min("record").alias("rep"))
    members = small.select("record", "copy").join(classes, "copy").select("record", "rep")
    big = held.where(F.col("n") > large * threshold)
    members = written(members.unionByName(held.where(F.col("n") > large).select("record", F.col("record").alias("rep")).distinct()), "members")
    reps = members.where(F.col("record") == F.col("rep")).select("record")
    sets = written(small.join(reps, "record", "left_semi").select("record", "n", "ordered", F.col("ordered.item").alias("items")), "sets")
    pairs = cell_pairs(sets, threshold, radius).drop("cell")
    from_large = _join_large(big.join(reps, "record", "left_semi"), threshold, large)
    found = pairs.unionByName(from_large.select(pairs.columns)).withColumn("similarity", similarity())
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return found.where(F.col("similarity") >= threshold - 1e-12).select(
        pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"), "shared", "similarity"), members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b)`` of all records: between the members of two paired classes, and within each class of equal sets."""
    x, y = (members.select(F.col("record").alias(f"m{k}"), F.col("rep").alias(k)) for k in "ab")
    across = pairs.select("a", "b").join(x, "a").join(y, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
    repeated = members.groupBy("rep").count().where(F.col("count") > 1).select("rep")
    again = members.join(repeated, "rep")
    within = again.select("rep", F.col("record").alias("a")).join(again.select("rep", F.col("record").alias("b")), "rep").where(F.col("a") < F.col("b")).select("a", "b")
    return across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within)
