"""Points in regions by crossing parity, and points near other points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres.
EARTH_RADIUS = 6_371_008.8


def usable(lat: Column, lon: Column) -> Column:
    """Both present, numbers, in range, and not the placeholder 0, 0."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance (haversine), in the unit of ``radius``; degrees in."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def _level(extent: Column) -> Column:
    """The finest grid level, cells of ``360 / 2**level`` degrees, whose cells are no smaller than the extent."""
    return F.greatest(F.lit(0), F.least(F.lit(30), F.floor(F.log2(F.lit(360.0) / F.greatest(extent, F.lit(1e-7)))))).cast("int")


def _cell(degrees: Column, level: Column) -> Column:
    return F.floor((degrees + 540) / 360 * F.pow(F.lit(2.0), level)).cast("long")


def _ranges(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(lo, hi))


#: Strips of one region differ in height by powers of ``2**STRIDE``, so a point is put into few of them.
STRIDE = 2


def met_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that each point meets: those whose latitude strip it lies in, about as wide around as their region is.

    An edge lies in strips of about its own height, but no lower than the mean strip, the region's height by its number
    of edges. So it lies in two of them or so, and the edges in a strip are as many as cross it: a point meets the edges
    near its latitude, not all edges of the region. Within a strip, edges lie in cells along the region's width, as the ray of a
    point runs east through them. A point looks into one strip of every height in use, so it meets an edge once at most.
    """
    edges = edges.dropna(subset=["region", "lat1", "lon1", "lat2", "lon2"])
    box = edges.groupBy("region").agg(
        F.min(F.least("lat1", "lat2")).alias("south"), F.max(F.greatest("lat1", "lat2")).alias("north"),
        F.min(F.least("lon1", "lon2")).alias("west"), F.max(F.greatest("lon1", "lon2")).alias("east"), F.count("*").alias("edges"))
    # the ray is followed as far as the box reaches; beyond 180 degrees the outline is also put where the points are
    shift = F.explode(F.filter(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)), lambda s: (F.col("west") + s <= 180) & (F.col("east") + s >= -180)))
    boxed = edges.join(box, "region").withColumn("shift", shift)
    for c in ("lon1", "lon2", "west", "east"):
        boxed = boxed.withColumn(c, F.col(c) + F.col("shift"))
    height = F.col("north") - F.col("south")
    finer = _level(F.greatest(F.abs(F.col("lat2") - F.col("lat1")), height / F.col("edges"))) - _level(height)
    boxed = boxed.withColumn("ny", _level(height) + (F.floor(finer / STRIDE) * STRIDE).cast("int")).withColumn("nx", _level(F.col("east") - F.col("west")))
    # heights and widths in use, with the latitudes at which they are: at most 31 * 31 rows
    levels = boxed.groupBy("ny", "nx").agg(F.min("south").alias("lo"), F.max("north").alias("hi"), F.min(F.when((F.col("south") <= 0) & (F.col("north") >= 0), 0.0).otherwise(F.least(F.abs("south"), F.abs("north")))).alias("least")).collect()
    if not levels:
        return points.limit(0).join(boxed.limit(0), F.lit(True))
    used = F.array(*(F.struct(F.lit(r.ny).alias("ny"), F.lit(r.nx).alias("nx"), F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi"), F.lit(r.least).alias("least")) for r in levels))
    within = lambda u: (F.col("lat") >= u["lo"]) & (F.col("lat") <= u["hi"]) & (F.abs("lat") >= u["least"])
    binned = points.dropna(subset=["point", "lat", "lon"]).withColumn("u", F.explode(F.filter(used, within))).select("*", "u.ny", "u.nx").drop("u")
    binned = binned.withColumns({"strip": _cell(F.col("lat"), F.col("ny")), "cell": _cell(F.col("lon"), F.col("nx"))})
    reach = F.greatest("lon1", "lon2")  # east of the edge nothing is crossed
    laid = boxed.withColumn("strip", _ranges(_cell(F.least("lat1", "lat2"), F.col("ny")), _cell(F.greatest("lat1", "lat2"), F.col("ny")))).withColumn(
        "cell", _ranges(_cell(F.col("west"), F.col("nx")), _cell(reach, F.col("nx"))))
    inside_box = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return binned.join(laid, ["ny", "nx", "strip", "cell"]).where(inside_box)


def point_in_region(points: DataFrame, edges: DataFrame, boundary: bool = True, pair_filter: Column | None = None) -> DataFrame:
    """``(point, region)`` for each point inside a region, by counting crossings of an eastward ray with the outline.

    ``points(point, lat, lon, ...)``; ``edges(region, lat1, lon1, lat2, lon2, ...)``, the outline's edges in any order; several
    rings of a region (holes, islands) count by parity. An outline that crosses the 180th meridian has longitudes
    beyond 180 on one side, or beneath -180. Points on an edge or corner belong to the region if ``boundary``. Rows
    with NULLs take no part. ``pair_filter`` may refer to all columns and leaves out pairs early.

    Points meet edges in latitude strips, see :func:`met_edges`. An edge spans the latitudes from its lower end inclusive to
    its upper end exclusive, so a corner is crossed once.
    """
    y, x = F.col("lat"), F.col("lon")
    spans = (F.least("lat1", "lat2") <= y) & (y < F.greatest("lat1", "lat2"))
    # the same order of the ends for both regions of a common edge
    up = F.col("lat1") <= F.col("lat2")
    yl, xl, yh, xh = (F.when(up, F.col(p)).otherwise(F.col(q)) for p, q in (("lat1", "lat2"), ("lon1", "lon2"), ("lat2", "lat1"), ("lon2", "lon1")))
    at = xl + (y - yl) * (xh - xl) / F.when(yh != yl, yh - yl).otherwise(1.0)
    flat = (F.col("lat1") == F.col("lat2")) & (y == F.col("lat1")) & x.between(F.least("lon1", "lon2"), F.greatest("lon1", "lon2"))
    on = flat | ((F.col("lat1") != F.col("lat2")) & y.between(F.least("lat1", "lat2"), F.greatest("lat1", "lat2")) & (x == at))
    met = met_edges(points, edges)
    if pair_filter is not None:
        met = met.where(pair_filter)
    counted = met.where(on | (spans & (x < at))).groupBy("point", "region", "shift").agg(
        F.sum(F.when(spans & (x < at), 1).otherwise(0)).alias("crossings"), F.max(on.cast("int")).alias("on"))
    inside = F.when(F.col("on") == 1, F.lit(boundary)).otherwise(F.col("crossings") % 2 == 1)
    return counted.where(inside).select("point", "region").distinct()


def caps(points: DataFrame, metres: float, radius: float = EARTH_RADIUS) -> DataFrame:
    """``(region, lat1, lon1, lat2, lon2)``: for each ``(point, lat, lon)`` the outline, in degrees, around all that is within ``metres``.

    The outline is the bounding quadrilateral of the spherical cap, a little widened; only its western and eastern
    edges can be crossed, so only they are made. Around a pole it is the whole zone.
    """
    angle = math.degrees(metres / radius) * (1 + 1e-9) + 1e-9
    lat, lon = F.col("lat"), F.col("lon")
    south, north = F.greatest(lat - angle, F.lit(-90.0)) - 1e-9, F.least(lat + angle, F.lit(90.0)) + 1e-9
    ratio = F.lit(math.sin(math.radians(min(angle, 90)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    polar = (F.abs(lat) + angle >= 90) | (ratio >= 1)
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9)) + 1e-9
    sides = F.explode(F.array(lon - half, lon + half)).alias("lon1")
    return points.select(F.col("point").alias("region"), south.alias("lat1"), north.alias("lat2"), sides).withColumn("lon2", F.col("lon1"))


def near_points(df: DataFrame, key: str, lat: str, lon: str, metres: float) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: which usable locations lie within ``metres`` of each other.

    ``members(key, place)`` gives each distinct key and location its place, of which there is one for all keys at
    exactly the same coordinates; ``pairs(place_a, place_b, metres)`` has each pair of different places once. So many
    points at one location are not paired one by one; :func:`expand_near` does that where all pairs are wanted.

    Candidates come from :func:`point_in_region` over the outlines of :func:`caps`; the distance decides. Rows without a
    key or usable coordinates take no part; an empty table gives no rows.
    """
    located = df.where(F.col(key).isNotNull() & usable(F.col(lat), F.col(lon))).select(
        F.col(key).alias("key"), (F.col(lat) + 0.0).alias("lat"), (F.col(lon) + 0.0).alias("lon")).distinct()
    places = located.groupBy("lat", "lon").agg(F.min("key").alias("first")).select(F.struct("lat", "lon").alias("point"), "lat", "lon")
    order = (F.col("point.lat") < F.col("region.lat")) | ((F.col("point.lat") == F.col("region.lat")) & (F.col("point.lon") < F.col("region.lon")))
    found = point_in_region(places, caps(places, metres), pair_filter=order)
    far = distance(F.col("point.lat"), F.col("point.lon"), F.col("region.lat"), F.col("region.lon"))
    pairs = found.withColumn("metres", far).where(F.col("metres") <= metres).select(F.col("point").alias("place_a"), F.col("region").alias("place_b"), "metres")
    return pairs, located.select("key", F.struct("lat", "lon").alias("place"))


def expand_near(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b)``, the smaller key first: all pairs of different keys that share a place or whose places are paired."""
    x, y = (members.select(F.col("key").alias(k), F.col("place").alias(f"place_{k}")) for k in "ab")
    across = pairs.join(x, "place_a").join(y, "place_b").select("a", "b")
    crowded = members.groupBy("place").count().where(F.col("count") > 1).select("place")
    there = members.join(crowded, "place", "left_semi")
    within = there.select("place", F.col("key").alias("a")).join(there.select("place", F.col("key").alias("b")), "place").select("a", "b")
    both = across.unionByName(within).where(F.col("a") != F.col("b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
