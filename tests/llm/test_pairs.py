"""Similar sets and co-occurrence against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dredgeline.llm import cooccurrence, similar_sets
from ..conftest import rows


def jaccard_pairs(held, threshold, min_size=1):
    sets: dict = {}
    for r, i in held:
        if r is not None and i is not None:
            sets.setdefault(r, set()).add(i)
    sets = {r: s for r, s in sets.items() if len(s) >= min_size}
    return sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12)


def found(spark, held, threshold, min_size=1, **more):
    df = spark.createDataFrame([(r, i, "x", 1) for r, i in held], "r string, i string, record string, n int")
    pairs, members = similar_sets.similar_sets(df, "r", "i", threshold, min_size, **more)
    for p in pairs.collect():
        assert p.a < p.b and p.similarity >= threshold - 1e-12
    return rows(similar_sets.expand_pairs(pairs, members))


def clustered(seed, n=60, universe=200):
    draw = random.Random(seed)
    held = []
    for k in range(n):
        base = draw.sample(range(universe), draw.randrange(1, 12))
        for copy in range(draw.randrange(1, 4)):
            kept = [x for x in base if draw.random() > 0.2 * copy] + draw.sample(range(universe), copy)
            held += [(f"{k:02d}.{copy}", f"u{x}") for x in kept + ([0] if draw.random() < 0.4 else [])]
    return held


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets(spark, threshold):
    held = clustered(int(threshold * 10)) + [("n", None), (None, "u1"), (None, None)]
    held += held[:50] + [(f"copy{k}", i) for k in range(3) for r, i in held if r == "07.0"]
    want = jaccard_pairs(held, threshold)
    assert found(spark, held, threshold) == want and len(want) > 3
    for part in (0.0, 0.2, 0.5):
        assert found(spark, held, threshold, radius=part * (1 - threshold)) == want


def test_large_sets_take_the_other_way(spark):
    held = clustered(3)
    big = [(f"big{k}", f"w{x}") for k in range(4) for x in range(k * 8, k * 8 + 60)] + [("mid", f"w{x}") for x in range(40)]
    want = jaccard_pairs(held + big, 0.5)
    for large in (3, 10, 45, 10_000):
        assert found(spark, held + big, 0.5, large=large) == want


def test_min_size_and_copies(spark):
    held = [(f"c{k}", u) for k in range(5) for u in "abc"] + [("one", "a"), ("two", "a"), ("four", "a"), ("four", "b"), ("four", "c"), ("four", "d")]
    assert found(spark, held, 0.5, 3) == jaccard_pairs(held, 0.5, 3)
    df = spark.createDataFrame(held, "r string, i string")
    pairs, members = similar_sets.similar_sets(df, "r", "i", 0.5, 3)
    assert rows(pairs.select("a", "b")) == [("c0", "four")] and {m.rep for m in members.collect() if m.record[0] == "c"} == {"c0"}


def test_no_rows(spark):
    assert found(spark, [], 0.5) == [] and found(spark, [(None, "a"), ("b", None)], 0.5) == []
    with pytest.raises(ValueError):
        found(spark, [("a", "b")], 0.0)
    with pytest.raises(ValueError):
        found(spark, [("a", "b")], 0.5, radius=0.3)


def _sets(spark, held):
    base = similar_sets.record_sets(spark.createDataFrame(held, "r string, i string"), "r", "i")
    return base.groupBy("record", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("ordered")).withColumn("items", F.col("ordered.item"))


def test_pivot_cells(spark):
    """Every record is at home with one pivot, the nearest of those near to it; a record with none near is its own."""
    held = [(f"{g}{k}", f"{g}{j}") for g in "ab" for k in range(6) for j in range(20 + k)] + [("solo", "a1"), ("solo", "b2")]
    homes = similar_sets.pivot_cells(_sets(spark, held), 0.24).collect()
    assert sorted(r.record for r in homes) == sorted([f"{g}{k}" for g in "ab" for k in range(6)] + ["solo"])
    assert {r.cell[0] + r.record[0] for r in homes} == {"aa", "bb", "ss"} and all(r.d <= 0.24 for r in homes)
    assert sum(r.d == 0 for r in homes) == len({r.cell for r in homes}) < 12


@pytest.mark.parametrize("threshold,radius", [(0.5, 0.2), (0.5, 0.0), (0.6, 0.2)])
def test_every_pair_meets_in_a_cell(spark, threshold, radius):
    """Each similar pair comes once, from a cell that is home to one of the two and holds the other as home or guest."""
    held = sorted(set(clustered(11, n=40)))
    sets = _sets(spark, held)
    found_ = similar_sets.cell_pairs(sets, threshold, radius).collect()
    home = {r.record: (r.cell, r.d) for r in similar_sets.pivot_cells(sets, radius).collect()}
    guests = {(r.cell, r.record): r for r in similar_sets.cell_guests(sets, similar_sets.net(sets, radius), threshold, radius).collect()}
    real = [(min(r.a, r.b), max(r.a, r.b)) for r in found_ if r.shared >= threshold * (r.na + r.nb - r.shared) - 1e-12]
    assert sorted(real) == jaccard_pairs(held, threshold) and len(real) > 3
    for r in found_:
        inside = {k for k in (r.a, r.b) if home[k][0] == r.cell}
        assert inside and all(k in inside or (r.cell, k) in guests for k in (r.a, r.b))
    for (cell, record), g in guests.items():
        assert home[record][0] != cell and g.d <= g.R + 1 - threshold + 1e-9


# --- co-occurrence ---

def counted(held, least):
    baskets: dict = {}
    for k, i in held:
        if k is not None and i is not None:
            baskets.setdefault(k, set()).add(i)
    out: dict = {}
    for s in baskets.values():
        for p in itertools.combinations(sorted(s), 2):
            out[p] = out.get(p, 0) + 1
    return {p: c for p, c in out.items() if c >= least}, baskets


@pytest.mark.parametrize("least", [1, 2, 5])
def test_pair_counts(spark, least):
    draw = random.Random(least)
    held = [(f"k{draw.randrange(40)}", f"i{int(draw.paretovariate(0.7)) % 30}") for _ in range(600)]
    held += [("hot1", f"i{k}") for k in range(30)] + [("hot2", f"i{k}") for k in range(30)] + [(None, "i1"), ("k1", None)] + held[:40]
    want, _ = counted(held, least)
    df = spark.createDataFrame([(k, i, 1) for k, i in held], "k string, i string, n int")
    got = {(r.a, r.b): r.c for r in cooccurrence.surprising_pairs(df, "k", "i", least).collect()}
    assert got == want
    numbered = spark.createDataFrame([(k, int(i[1:]), 99) for k, s in counted(held, 1)[1].items() for i in s], "basket string, item long, n_item long")
    for block in (2, 7):
        assert {(f"i{r.a}", f"i{r.b}") for r in cooccurrence.pair_counts(numbered, least, block=block).collect()} == {tuple(sorted(p, key=lambda x: int(x[1:]))) for p in want}


def test_lift_is_pushed_down(spark):
    draw = random.Random(8)
    held = [(f"k{b}", "all") for b in range(200)] + [(f"k{b}", f"p{b % 10}") for b in range(200)] + [(f"k{b}", f"q{b % 10}") for b in range(200) if draw.random() < 0.8]
    want, baskets = counted(held, 5)
    n = len(baskets)
    size = {i: sum(i in s for s in baskets.values()) for i in {i for s in baskets.values() for i in s}}
    df = spark.createDataFrame(held, "k string, i string")
    got = {(r.a, r.b): r for r in cooccurrence.surprising_pairs(df, "k", "i", 5, 5.0).collect()}
    assert set(got) == {p for p, c in want.items() if c * n >= 5 * size[p[0]] * size[p[1]]} and got
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n) == (size[a], size[b], n) and r.lift == pytest.approx(r.c * n / (r.n_a * r.n_b)) and 0 <= r.p_value <= r.q_value <= 1


def test_no_pairs(spark):
    df = spark.createDataFrame([], "k string, i string")
    assert cooccurrence.surprising_pairs(df, "k", "i").count() == 0
    assert cooccurrence.surprising_pairs(spark.createDataFrame([("a", "b")], "k string, i string"), "k", "i", 1).count() == 0


def test_configuration_keeps_the_degrees():
    draw = np.random.default_rng(1)
    table = draw.random((80, 30)) < np.outer(draw.random(80), draw.random(30))
    k, d = table.sum(1), table.sum(0)
    k, d = k[k > 0], d[d > 0]
    x, y = cooccurrence.fit_configuration(k, np.ones(len(k)), d, np.ones(len(d)), rounds=5000)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p.sum(1), k, rtol=1e-3) and np.allclose(p.sum(0), d, rtol=1e-3)
    ks, nk = np.unique(k, return_counts=True)
    ds, nd = np.unique(d, return_counts=True)
    xs, ys = cooccurrence.fit_configuration(ks, nk, ds, nd, rounds=5000)
    assert np.allclose(np.outer(xs, ys)[np.searchsorted(ks, k)][:, np.searchsorted(ds, d)], np.outer(x, y), rtol=1e-3)


def exact_tail(q, n, c):
    pmf = np.array([1.0])
    for a, m in zip(q, n):
        for _ in range(int(m)):
            pmf = np.convolve(pmf, [1 - a, a])
    return pmf[c:].sum()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-7, 0.97), st.integers(1, 40)), min_size=1, max_size=5), st.integers(0, 60))
def test_poisson_binomial_tail(parts, c):
    q, n = np.array([p for p, _ in parts]), np.array([m for _, m in parts])
    want = exact_tail(q, n, c)
    assert cooccurrence.poisson_binomial_tail(q, n, c) == pytest.approx(want, rel=1e-5, abs=1e-13 if c <= (q * n).sum() else 1e-280)


def test_far_tail_is_relative():
    assert cooccurrence.poisson_binomial_tail(np.array([1e-4]), np.array([100.0]), 12) == pytest.approx(sum(math.comb(100, k) * 1e-4**k * (1 - 1e-4) ** (100 - k) for k in range(12, 40)), rel=1e-6)


def test_degree_classes_are_bounded():
    d = np.unique(np.concatenate([np.arange(1, 5000), 2 ** np.arange(12, 40)]))
    c = cooccurrence.degree_classes(d)
    assert (np.diff(c) >= 0).all() and c.max() < 1300 and (c[:256] == d[:256]).all()


def test_false_discovery(spark):
    p = [1e-9, 1e-4, 2e-4, 0.03, 0.2, 1.0]
    got = [r.q_value for r in cooccurrence._false_discovery(spark.createDataFrame([(x,) for x in p], "p_value double"), 10).orderBy("p_value").collect()]
    want, best = [0.0] * 6, 1.0
    for k in range(5, -1, -1):
        best = min(best, p[k] * 10 / (k + 1))
        want[k] = best
    assert all(w <= g <= 1.04 * w + 1e-12 for g, w in zip(got, want))
