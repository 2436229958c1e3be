import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dredgeline.operators.geo import EARTH_RADIUS, expand_near, met_edges, near_points, point_in_region
from .conftest import rows


def metres(a, b):
    (la, lo), (lb, mo) = a, b
    p, q = math.radians(la), math.radians(lb)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(mo - lo) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(min(1, math.sqrt(h)))


def near(spark, points, limit, **more):
    df = spark.createDataFrame(points, "id string, lat double, lon double")
    pairs, members = near_points(df, "id", "lat", "lon", limit)
    return rows(expand_near(pairs, members))


def brute(points, limit):
    ok = {(i, la, lo) for i, la, lo in points if i is not None and la is not None and lo is not None and not math.isnan(la) and not math.isnan(lo)
          and abs(la) <= 90 and abs(lo) <= 180 and (la, lo) != (0, 0)}
    return sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in ok for b in ok if a[0] != b[0] and metres(a[1:], b[1:]) <= limit}, key=repr)


def test_near_everywhere(spark):
    draw = random.Random(4)
    points = []
    for k, (lat, lon) in enumerate([(0.0002, 0.0), (47.3, 8.5), (-33.9, 151.2), (64.1, -21.9), (12.0, 179.9999), (12.0, -179.9999), (89.9995, 30.0), (-90.0, 0.0), (78.2, 15.6), (0.0, 180.0)]):
        for j in range(25):
            spread = 0.0012
            points.append((f"{k}-{j}", max(-90.0, min(90.0, lat + draw.uniform(-spread, spread))), lon + draw.uniform(-spread, spread) / max(0.02, math.cos(math.radians(lat)))))
    points = [(i, la, lo - 360 if lo > 180 else lo + 360 if lo < -180 else lo) for i, la, lo in points]
    assert near(spark, points, 75.0) == brute(points, 75.0)
    assert len(brute(points, 75.0)) > 200


def test_near_odd_rows(spark):
    nan = float("nan")
    points = [("a", 10.0, 20.0), ("b", 10.0, 20.0), ("b", 10.0, 20.0), ("c", 10.0, 20.0004), (None, 10.0, 20.0), ("d", None, 20.0), ("e", nan, 20.0), ("f", 0.0, 0.0),
              ("g", 0.0, 0.0), ("h", 999.0, 999.0), ("i", -0.0, 180.0), ("j", 0.0, -180.0), ("k", 90.0, 5.0), ("l", 90.0, -120.0), ("a", 50.0, 50.0), ("m", 50.0, 50.0)]
    assert near(spark, points, 75.0) == brute(points, 75.0) == [("a", "b"), ("a", "c"), ("a", "m"), ("b", "c"), ("i", "j"), ("k", "l")]


def test_near_empty(spark):
    assert near(spark, [], 75.0) == []
    assert near(spark, [("a", None, None)], 75.0) == []


def inside(spark, points, edges, **more):
    p = spark.createDataFrame([(str(k), *xy) for k, xy in enumerate(points)], "point string, lat double, lon double")
    return {int(r.point) for r in point_in_region(p, spark.createDataFrame(edges, "region string, lat1 double, lon1 double, lat2 double, lon2 double"), **more).collect()}


def ring(corners):
    return [("r", *corners[k], *corners[(k + 1) % len(corners)]) for k in range(len(corners))]


def test_boundary_is_explicit(spark):
    square = ring([(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)])
    points = [(5.0, 5.0), (0.0, 0.0), (10.0, 10.0), (10.0, 5.0), (0.0, 5.0), (5.0, 0.0), (5.0, 10.0), (5.0, 10.0001), (-0.0001, 5.0), (10.0, 11.0), (0.0, -1.0), (10.0, -1.0)]
    assert inside(spark, points, square) == {0, 1, 2, 3, 4, 5, 6}
    assert inside(spark, points, square, boundary=False) == {0}


def test_hole_and_date_line(spark):
    outer, hole = ring([(0.0, 170.0), (0.0, 190.0), (20.0, 190.0), (20.0, 170.0)]), ring([(5.0, 175.0), (5.0, 185.0), (15.0, 185.0), (15.0, 175.0)])
    points = [(10.0, 172.0), (10.0, 180.0), (10.0, -180.0), (10.0, -172.0), (10.0, -169.0), (10.0, 169.0), (2.0, 180.0), (2.0, -180.0)]
    assert inside(spark, points, outer + hole) == {0, 3, 6, 7}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(-8, 8), st.integers(-8, 8)), min_size=3, max_size=7, unique=True))
def test_any_outline(spark, corners):
    """Against crossing numbers counted directly, for outlines that may cross themselves."""
    edges = ring([(float(a), float(b)) for a, b in corners])
    points = [(y + 0.5, x + 0.25) for y in range(-9, 9) for x in range(-9, 9)]

    def odd(y, x):
        n, on = 0, False
        for _, a, b, c, d in edges:
            if a > c:
                a, b, c, d = c, d, a, b
            if a <= y < c:
                at = b + (y - a) * (d - b) / (c - a)
                n, on = n + (x < at), on or x == at
        return on or n % 2 == 1

    assert inside(spark, points, edges) == {k for k, (y, x) in enumerate(points) if odd(y, x)}


@pytest.mark.parametrize("limit", [1.0, 75.0, 50_000.0, 9_000_000.0])
def test_radii(spark, limit):
    draw = random.Random(9)
    points = [(str(k), draw.uniform(-90, 90), draw.uniform(-180, 180)) for k in range(60)] + [("x", 45.0, 7.0), ("y", 45.0, 7.0005), ("z", 45.0, 7.000005)]
    assert near(spark, points, limit) == brute(points, limit)


def test_plan_has_no_product(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0001)], "id string, lat double, lon double")
    plan = near_points(df, "id", "lat", "lon", 75.0)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_points_meet_the_edges_of_their_strip(spark):
    """Joined rows do not grow with the edges of a region as long as those at a point's latitude do not."""
    draw = random.Random(6)
    points = [(str(k), 30 + draw.uniform(-7, 7), 40 + draw.uniform(-7, 7)) for k in range(500)]
    p = spark.createDataFrame(points, "point string, lat double, lon double")
    for n, smooth in ((200, True), (2000, True), (20_000, True), (20_000, False)):
        turn = [2 * math.pi * k / n for k in range(n)]
        out = [10 if smooth else 10 + 0.5 * math.sin(k * 1.7) for k in range(n)]
        edges = ring([(30 + r * math.sin(a), 40 + r * math.cos(a)) for r, a in zip(out, turn)])
        df = spark.createDataFrame(edges, "region string, lat1 double, lon1 double, lat2 double, lon2 double")
        met = met_edges(p, df)
        crossing = sum(min(a, c) <= y <= max(a, c) for _, a, _, c, _ in edges for _, y, _ in points[:20]) / 20
        assert met.count() <= 500 * (8 * crossing + 16)
        if n <= 2000:
            assert {r.point for r in point_in_region(p, df).collect()} == {i for i, y, x in points if math.hypot(y - 30, x - 40) < 10}
