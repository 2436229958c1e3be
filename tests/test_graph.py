import time
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dredgeline.operators import graph
from dredgeline.sources import reports
from .conftest import rows, shuffled

TOY = [("A", "CA"), ("B", "CA"), ("A", "MB"), ("C", "MB"), ("B", "PQ"), ("C", "PQ"), ("A", "MV"), ("D", "MV"), ("D", "UV"), ("C", "UV"), ("D", "OU"), ("E", "OU"), ("E", "BC"), ("C", "BC")]
BARBELL = [(x, y) for x, y in ("ab", "bc", "ac", "cd", "de", "ef", "df")]


def edges(spark, pairs):
    return graph.edge_graph(spark.createDataFrame(pairs, "a string, b string"), "a", "b")


def divided(e, denominator="2m"):
    found = graph.girvan_newman(graph.vertices(e), e, denominator).collect()
    groups: dict = {}
    for r in found:
        groups.setdefault(r.community, set()).add(r.id)
    return sorted(map(sorted, groups.values())), round(found[0].q, 6)


def test_shared_graph(spark):
    df = spark.createDataFrame([*TOY, ("A", None), (None, "CA"), TOY[0]], "user string, state string")
    e = graph.cooccur_graph(df, "user", "state", 1)
    assert rows(e.select("src", "dst")) == [tuple(p) for p in ("AB", "AC", "AD", "BC", "CD", "CE", "DE")]
    got = {(r.src, r.dst): r.betweenness for r in graph.edge_betweenness(graph.vertices(e), e).collect()}
    want = {"BC": Fraction(5, 2), "CE": Fraction(5, 2), "AD": 2, "AB": Fraction(3, 2), "AC": Fraction(3, 2), "CD": Fraction(3, 2), "DE": Fraction(3, 2)}
    assert got == {tuple(k): float(v) for k, v in want.items()}
    assert divided(e) == ([["A", "B", "C", "D", "E"]], round(10 / 49, 6))
    assert divided(e, "m") == ([["A", "C", "D"], ["B"], ["E"]], round(6 / 49, 6))


def test_explicit_edges(spark):
    e = edges(spark, TOY)
    assert divided(e) == ([["A", "C", "D", "MB", "MV", "UV"], ["B", "CA", "PQ"], ["BC", "E", "OU"]], round(24 / 49, 6))
    assert divided(e, "m")[1] == round(13 / 49, 6)
    got = {(r.src, r.dst): round(r.betweenness, 6) for r in graph.edge_betweenness(graph.vertices(e), e).collect()}
    assert got[("BC", "C")] == got[("C", "PQ")] == 15.5 and got[("B", "CA")] == round(47 / 6, 6)


def test_barbell(spark):
    e = edges(spark, BARBELL)
    got = {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(graph.vertices(e), e).collect()}
    assert got == {"cd": 9, "ac": 4, "bc": 4, "de": 4, "df": 4, "ab": 1, "ef": 1}
    assert {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(graph.vertices(e), e, 40).collect()} == got  # roots in three blocks
    assert divided(e) == ([["a", "b", "c"], ["d", "e", "f"]], round(24 / 49, 6))
    assert divided(e, "m")[1] == round(6 / 49, 6)
    labels = dict(map(tuple, graph.label_propagation(graph.vertices(e), e).collect()))
    assert labels == {"a": "a", "b": "a", "c": "a", "d": "c", "e": "c", "f": "c"}
    whole = graph.connected_components(graph.vertices(e), e).withColumnRenamed("component", "community")
    assert rows(graph.modularity(e, whole)) == [(0.0,)]


def test_edge_graph_cleans(spark):
    e = graph.edge_graph(spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "a"), (None, "a"), ("c", None)], "a string, b string"), "a", "b")
    assert rows(e) == [("a", "b", 2)]
    assert rows(graph.edge_count(e)) == [(1,)]


def test_no_edges(spark):
    e = edges(spark, [])
    v = spark.createDataFrame([("x",)], "id string")
    assert rows(graph.connected_components(v, e)) == [("x", "x")]
    assert rows(graph.label_propagation(v, e)) == [("x", "x")]
    assert rows(graph.girvan_newman(v, e)) == [("x", "x", 0.0)]
    assert graph.edge_betweenness(graph.vertices(e), e).count() == 0
    assert rows(graph.modularity(e, v.selectExpr("id", "id as community"))) == [(0.0,)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=18))
def test_components_and_betweenness(spark, pairs):
    e = graph.edge_graph(spark.createDataFrame(pairs, "a int, b int"), "a", "b")
    kept = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    v = spark.createDataFrame([(k,) for k in range(13)], "id int")
    least = {k: k for k in range(13)}
    for _ in range(13):
        for a, b in kept:
            least[a] = least[b] = min(least[a], least[b])
    assert dict(map(tuple, graph.connected_components(v, e).collect())) == least
    adjacent: dict = {k: set() for k in range(13)}
    for a, b in kept:
        adjacent[a].add(b)
        adjacent[b].add(a)
    want = {k: round(b, 9) for k, b in graph._betweenness(adjacent).items()}
    assert {(r.src, r.dst): round(r.betweenness, 9) for r in graph.edge_betweenness(v, e).collect()} == want


def test_long_path_components(spark):
    e = edges(spark, [(f"{k:03d}", f"{k + 1:03d}") for k in range(200)])
    assert rows(graph.connected_components(graph.vertices(e), e).select("component").distinct()) == [("000",)]


@pytest.mark.parametrize("rounds", [0, 1])
def test_label_rounds(spark, rounds):
    e = edges(spark, [("a", "b"), ("b", "c")])
    got = dict(map(tuple, graph.label_propagation(graph.vertices(e), e, rounds).collect()))
    assert got == ({"a": "a", "b": "b", "c": "c"} if rounds == 0 else {"a": "b", "b": "a", "c": "b"})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 5)), min_size=1, max_size=40))
def test_scores_with_leaves_and_twins(pairs):
    adjacent: dict = {k: set() for k in range(15)}
    for a, b in pairs:
        if a != b:
            adjacent[a].add(b)
            adjacent[b].add(a)
    want = {k: round(b, 9) for k, b in graph._betweenness(adjacent).items()}
    assert {k: round(b, 9) for k, b in graph._scores(adjacent).items()} == want
    parts: dict = {}
    for block in range(3):
        for k, b in graph._scores(adjacent, block, 3).items():
            parts[k] = parts.get(k, 0) + b
    assert {k: round(b, 9) for k, b in parts.items()} == want


def test_division_around_hubs():
    """Thousands of vertices around a few hubs, as shared customers make them: far fewer kinds of vertices than vertices."""
    links = [(h, f"v{k:04d}") for k in range(3000) for h in ([f"h{k % 5}"] if k % 10 else [f"h{k % 5}", f"h{(k // 10 + 1) % 5}"])]
    links = sorted({(min(p), max(p)) for p in links} | {("h0", "h1"), ("h1", "h2"), ("h2", "h3"), ("h3", "h4")})
    began = time.process_time()
    steps, gone = graph._division(links)
    assert time.process_time() - began < 20
    assert len(gone) == len(links) and steps[-1] == (0.0, 0, 0)
    assert max(gone) == len(steps) - 2 and steps[0][1] == 2 * len(links)


def test_betweenness_around_hubs(spark, monkeypatch):
    """No rows by root and vertex for a graph that a task may hold, and the same from the rows where it may not."""
    e = edges(spark, [(f"h{k % 3}", f"v{k:03d}") for k in range(200)] + [("h0", "h1"), ("h1", "h2")])
    monkeypatch.setattr(graph, "TASK_WORK", 20_000)  # in several blocks
    adjacent: dict = {}
    for r in e.collect():
        adjacent.setdefault(r.src, set()).add(r.dst)
        adjacent.setdefault(r.dst, set()).add(r.src)
    want = {k: round(b, 6) for k, b in graph._betweenness(adjacent).items()}
    found: dict = {}
    moved = shuffled(spark, lambda: found.update({(r.src, r.dst): round(r.betweenness, 6) for r in graph.edge_betweenness(graph.vertices(e), e).collect()}))
    assert found == want and moved < 20_000
    monkeypatch.setattr(graph, "TASK_EDGES", 0)
    few = edges(spark, BARBELL)
    assert {r.src + r.dst: r.betweenness for r in graph.edge_betweenness(graph.vertices(few), few, 40).collect()} == {"cd": 9, "ac": 4, "bc": 4, "de": 4, "df": 4, "ab": 1, "ef": 1}


def test_large_scores_as_lines(spark):
    scores = spark.createDataFrame([("a", "b", 12345678.5), ("a", "c", 20000000.0), ("b", "c", 2.5), ("b", "d", 123456789.123456)], "src string, dst string, betweenness double")
    assert [r.line for r in reports.betweenness_lines(scores).collect()] == ["('b', 'd'), 123456789.123456", "('a', 'c'), 20000000.0", "('a', 'b'), 12345678.5", "('b', 'c'), 2.5"]
