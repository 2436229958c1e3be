"""Queries of places and packed categories over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key
from ..operators.geo import expand_near, near_points, point_in_region, usable
from ..operators.unpack import unpacked
from ..sources.tables import table

#: Edges of an outline.
OUTLINE = 10_000


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "business").select(key(F.col("business_id")).alias("business_id"), "latitude", "longitude")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of businesses at most 75 m apart."""
    pairs, members = near_points(_places(spark, folder), "business_id", "latitude", "longitude", 75.0)
    return expand_near(pairs, members).select(F.col("a").alias("business_a"), F.col("b").alias("business_b"))


def p3_in_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """The region of each business: diamonds that cover the earth, 30 degrees from corner to corner."""
    n = 12
    corners = [(lat, lon) for lat in range(-90, 91, n) for lon in range(-180, 181, n)]
    edges = []
    for k in range(2):
        for lat, lon in corners:
            la, lo = lat + k * n / 2, lon + k * n / 2
            d = [(la + n / 2, lo), (la, lo + n / 2), (la - n / 2, lo), (la, lo - n / 2)]
            edges += [(f"{la:.0f}:{lo:.0f}", *d[i], *d[(i + 1) % 4]) for i in range(4)]
    tiles = spark.createDataFrame(edges, "region string, lat1 double, lon1 double, lat2 double, lon2 double")
    points = _places(spark, folder).where(F.col("business_id").isNotNull() & usable(F.col("latitude"), F.col("longitude"))).distinct()
    found = point_in_region(points.select(F.col("business_id").alias("point"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), tiles)
    return found.select(F.col("point").alias("business_id"), "region")


def p3_in_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """The regions of each business: twelve ragged outlines of ten thousand edges each."""
    corner = lambda j: (F.radians(j * 360.0 / OUTLINE), F.radians(j * 360.0 / OUTLINE) * 37, F.radians(j * 360.0 / OUTLINE) * 401)

    def at(j):
        turn, lobes, teeth = corner(j)
        out = 15 + 5 * F.sin(lobes) + 3 * F.sin(teeth)
        return F.col("la") + out * F.sin(turn), F.col("lo") + out * F.cos(turn)

    edges = spark.range(12 * OUTLINE).select((F.col("id") % 12).alias("r"), F.floor(F.col("id") / 12).alias("j"))
    edges = edges.withColumns({"la": (F.col("r") % 3) * 40.0 - 40, "lo": F.floor(F.col("r") / 3) * 90.0 - 120})
    (lat1, lon1), (lat2, lon2) = at(F.col("j")), at((F.col("j") + 1) % OUTLINE)
    outlines = edges.select(F.col("r").alias("region"), lat1.alias("lat1"), lon1.alias("lon1"), lat2.alias("lat2"), lon2.alias("lon2"))
    points = _places(spark, folder).where(F.col("business_id").isNotNull() & usable(F.col("latitude"), F.col("longitude"))).distinct()
    found = point_in_region(points.select(F.col("business_id").alias("point"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), outlines)
    return found.select(F.col("point").alias("business_id"), "region")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every category of every business with its position."""
    rows = table(spark, folder, "business").select(key(F.col("business_id")).alias("business_id"), "categories").where(F.col("business_id").isNotNull())
    return unpacked(rows, "business_id", "categories").select("business_id", "pos", F.col("value").alias("category"))


QUERIES = {f.__name__: f for f in (p3_found, p3_in_tiles, p3_in_outlines, p7_found)}

_AT = """place as (select distinct nullif(trim(business_id), '') as id, latitude as lat, longitude as lon from business
    where nullif(trim(business_id), '') is not null and not isnan(latitude) and not isnan(longitude)
    and abs(latitude) <= 90 and abs(longitude) <= 180 and not (latitude = 0 and longitude = 0))"""

SQL = {
    "p3_found": f"""with {_AT} select distinct x.id as business_a, y.id as business_b from place x join place y on x.id < y.id and abs(x.lat - y.lat) < 0.001
        where 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) <= 75""",
    # a point lies in a diamond where |dlat| + |dlon| <= 6
    "p3_in_tiles": f"""with {_AT}, c as (select a * 12 - 90 + k * 6 as la, b * 12 - 180 + k * 6 as lo from range(16) r(a), range(31) s(b), range(2) t(k))
        select distinct id as business_id, printf('%d:%d', la, lo) as region from place join c on abs(lat - la) + least(abs(lon - lo), abs(lon + 360 - lo), abs(lon - 360 - lo)) <= 6""",
    "p3_in_outlines": f"""with {_AT}, turn as (select r, j, radians(j * 360.0 / {OUTLINE}) as a, r % 3 * 40.0 - 40 as la, r // 3 * 90.0 - 120 as lo from range(12) s(r), range({OUTLINE}) t(j)),
        corner as (select r, j, la + (15 + 5 * sin(37 * a) + 3 * sin(401 * a)) * sin(a) as y, lo + (15 + 5 * sin(37 * a) + 3 * sin(401 * a)) * cos(a) as x from turn),
        edge as (select p.r, p.y as y1, p.x as x1, q.y as y2, q.x as x2 from corner p join corner q on q.r = p.r and q.j = (p.j + 1) % {OUTLINE})
        select distinct id as business_id, r as region from (select id, lat, lon, r from place join edge on least(y1, y2) <= lat and lat < greatest(y1, y2)
            where lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) group by id, lat, lon, r having count(*) % 2 = 1)""",
}
