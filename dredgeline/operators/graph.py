"""Graphs as DataFrames: co-occurrence graphs, label propagation, components, betweenness, modularity, division.

An edge list has one row ``(src, dst)`` with ``src < dst`` for each undirected edge.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .pairs import shared_counts
from .similarity import jaccard_join


def cooccur_graph(df: DataFrame, vertex: str, item: str, threshold: int) -> DataFrame:
    """``(src, dst, weight)``: vertices that share ``threshold`` items or more."""
    return shared_counts(df, vertex, item, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("shared").alias("weight"))


def jaccard_graph(df: DataFrame, vertex: str, item: str, threshold: float = 0.5) -> DataFrame:
    """``(src, dst, weight)``: vertices whose item sets have a Jaccard similarity of ``threshold`` or more."""
    return jaccard_join(df, vertex, item, threshold).select(F.col("id1").alias("src"), F.col("id2").alias("dst"), F.col("sim").alias("weight"))


def edge_graph(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(src, dst, weight)`` of a table whose rows are edges: without direction, loops or NULLs; ``weight`` counts rows."""
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().where("a != b")
    return rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct().agg(F.count("*").alias("m"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def label_propagation(v: DataFrame, e: DataFrame, max_iter: int = 5) -> DataFrame:
    """``(id, label)`` after ``max_iter`` synchronous rounds: the most frequent label among the neighbours, ties to the
    smallest; a vertex without neighbours keeps its own."""
    links = written(both_ways(e), "links")
    labels = v.select("id", F.col("id").alias("label"))
    for _ in range(max_iter):
        votes = links.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(F.col("dst").alias("id"), F.col("b.label").alias("new"))
        labels = written(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
    return labels


def connected_components(v: DataFrame, e: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest vertex that a vertex is connected with.

    Alternates two steps on the edge list, large stars (larger neighbours to the smallest neighbour) and small
    stars (smaller neighbours to the smallest), until it no longer changes: a few rounds even for long paths.
    """
    links = written(e.select("src", "dst").where("src != dst").distinct(), "links")
    mark = None
    while True:
        around = links.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(links.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        mins = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(mins, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # each vertex with all smaller neighbours: they and itself go to the smallest of them
        smaller = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        own = smaller.groupBy("u").agg(F.min("v").alias("m"))
        small = smaller.join(own, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        links = written(small.select(F.col("v").alias("src"), F.col("u").alias("dst")), "links")
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    return v.join(links.select(F.col("dst").alias("id"), F.col("src").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def shortest_paths(v: DataFrame, e: DataFrame) -> DataFrame:
    """``(root, node, level, paths)``: distance and number of shortest paths from every vertex ``v`` to every vertex it reaches.

    One frontier join a level, for all roots at once. A neighbour of a vertex at some level is at that level or one beside
    it, so a frontier is compared with the last two only.
    """
    return _levels(v, written(both_ways(e), "links"))


def _levels(v: DataFrame, links: DataFrame) -> DataFrame:
    front = written(v.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("paths")), "front")
    seen, before, level = front, front.limit(0), 0
    while not front.isEmpty():
        level += 1
        reached = front.select("root", F.col("node").alias("src"), "paths").join(links, "src").groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        known = front.select("root", "node").unionByName(before.select("root", "node"))
        before = front
        front = written(reached.join(known, ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("level"), "paths"), "front")
        seen = seen.unionByName(front)
    return seen


#: Edges that a task may hold, and roots times edges that one should work on.
TASK_EDGES, TASK_WORK = 500_000, 20_000_000


def edge_betweenness(v: DataFrame, e: DataFrame, block_rows: int = 2_000_000_000) -> DataFrame:
    """``(src, dst, betweenness)``: over all pairs of vertices, the share of their shortest paths that use the edge.

    Up to ``TASK_EDGES`` edges, each task gets them all and takes a part of the roots (see :func:`_scores`), so that no row is
    made for a root and a vertex. In larger graphs, credits flow back from the deepest level, for many roots at once: a vertex has 1 and what its children give, and
    gives it to its parents by their numbers of paths. Roots are taken in as many blocks as keep the rows of a block (roots
    times edges at most) below ``block_rows``, so what is held at a time does not grow with the square of the graph.
    """
    edges = written(e.select("src", "dst").distinct(), "edges")
    n = edges.count()
    if n <= TASK_EDGES:
        most = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return _in_tasks(edges, min(most, max(1, -(-v.count() * n // TASK_WORK))))
    links = written(both_ways(edges), "links")
    roots = written(v.select("id"), "roots")
    blocks = max(1, -(-roots.count() * links.count() // block_rows))
    shares = None
    for k in range(blocks):
        of = _credits(roots.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k), links)
        if of is not None:
            shares = of if shares is None else shares.unionByName(of)
    if shares is None:
        return e.select("src", "dst", F.lit(0.0).alias("betweenness")).limit(0)
    return shares.groupBy("src", "dst").agg((F.sum("credit") / 2).alias("betweenness"))


def _in_tasks(edges: DataFrame, blocks: int) -> DataFrame:
    """``(src, dst, betweenness)`` by one task for each block of roots."""
    def scored(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict = defaultdict(set)
        for u, w in zip(t["src"], t["dst"]):
            adjacent[u].add(w)
            adjacent[w].add(u)
        return pd.DataFrame([(*ends, b) for ends, b in _scores(adjacent, key[0], blocks).items()], columns=["src", "dst", "betweenness"])

    kind = dict(edges.dtypes)["src"]
    each = edges.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shares = each.groupBy("block").applyInPandas(scored, f"src {kind}, dst {kind}, betweenness double")
    return shares.groupBy("src", "dst").agg(F.sum("betweenness").alias("betweenness"))


def _credits(roots: DataFrame, links: DataFrame) -> DataFrame | None:
    """``(src, dst, credit)`` summed over some roots; None if they reach nothing."""
    reach = written(_levels(roots, links), "paths")
    deepest = reach.agg(F.max("level")).first()[0] or 0
    child = reach.select("root", F.col("node").alias("child"), "level", F.col("paths").alias("child_paths"))
    parent = reach.select("root", F.col("node").alias("parent"), (F.col("level") + 1).alias("level"), "paths")
    dag = written(child.join(links.select(F.col("src").alias("child"), F.col("dst").alias("parent")), "child").join(parent, ["root", "parent", "level"]), "dag")
    shares, below = None, None
    for level in range(deepest, 0, -1):
        here = dag.where(F.col("level") == level)
        if below is not None:
            given = below.groupBy("root", F.col("parent").alias("child")).agg(F.sum("credit").alias("given"))
            here = here.join(given, ["root", "child"], "left").withColumn("weight", 1 + F.coalesce("given", F.lit(0.0)))
        else:
            here = here.withColumn("weight", F.lit(1.0))
        below = written(here.select("root", "child", "parent", (F.col("weight") * F.col("paths") / F.col("child_paths")).alias("credit")), "credit")
        shares = below if shares is None else shares.unionByName(below)
    if shares is None:
        return None
    return written(shares.groupBy(F.least("child", "parent").alias("src"), F.greatest("child", "parent").alias("dst")).agg(F.sum("credit").alias("credit")), "shares")


def modularity(e: DataFrame, communities: DataFrame, m: int | None = None, denominator: str = "2m") -> DataFrame:
    """``(q)`` of ``communities(id, community)`` on the current edges ``e``; ``m`` edges originally (default: now).

    ``Q = sum over communities of (2 inner edges - degree**2 / denominator) / 2m``; 0 without edges.
    """
    m = m if m is not None else e.select("src", "dst").distinct().count()
    if not m:
        return e.sparkSession.createDataFrame([(0.0,)], "q double")
    scale = {"2m": 2.0 * m, "m": float(m)}[denominator]
    ends = both_ways(e.select("src", "dst").distinct())
    of = ends.join(communities.select(F.col("id").alias("src"), F.col("community").alias("cs")), "src").join(communities.select(F.col("id").alias("dst"), F.col("community").alias("cd")), "dst")
    each = of.groupBy("cs").agg(F.count("*").alias("degree"), F.sum(F.when(F.col("cs") == F.col("cd"), 1).otherwise(0)).alias("inner"))
    return each.agg(F.coalesce(F.sum(F.col("inner") - F.col("degree") * F.col("degree") / scale) / (2.0 * m), F.lit(0.0)).alias("q"))


# --- division by betweenness, component by component ---

def _betweenness(adjacent: dict) -> dict:
    """Edge betweenness of a small graph given as ``{vertex: set of neighbours}``, root by root: what :func:`_scores` must give."""
    out: dict = defaultdict(float)
    for root in adjacent:
        level, paths, order = {root: 0}, {root: 1}, []
        queue = deque([root])
        while queue:
            u = queue.popleft()
            order.append(u)
            for w in adjacent[u]:
                if w not in level:
                    level[w], paths[w] = level[u] + 1, 0
                    queue.append(w)
                if level[w] == level[u] + 1:
                    paths[w] += paths[u]
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for u in adjacent[w]:
                if level[u] == level[w] - 1:
                    share = credit[w] * paths[u] / paths[w]
                    credit[u] += share
                    out[(u, w) if u < w else (w, u)] += share / 2
    return out


def _folded(adjacent: dict) -> tuple[dict, dict, dict]:
    """``(core, weight, scores)``: leaves are folded into their neighbour until none is left.

    ``core`` is the graph that remains, ``weight`` how many vertices each of its vertices stands for; ``scores`` are those of the
    edges folded, which lie on the paths from all vertices behind them to all others of their component.
    """
    degree = {v: len(near) for v, near in adjacent.items()}
    weight, scores, folded = dict.fromkeys(adjacent, 1), {}, set()
    least = _parts(adjacent)
    size = Counter(least.values())
    queue = [v for v, d in degree.items() if d == 1]
    for v in queue:
        if degree[v] == 1:
            u = next(w for w in adjacent[v] if w not in folded)
            folded.add(v)
            scores[(u, v) if u < v else (v, u)] = float(weight[v] * (size[least[v]] - weight[v]))
            weight[u] += weight[v]
            degree[v], degree[u] = 0, degree[u] - 1
            if degree[u] == 1:
                queue.append(u)
    core = {v: near - folded if folded else near for v, near in adjacent.items() if degree[v]}
    return core, weight, scores


def _scores(adjacent: dict, block: int = 0, blocks: int = 1) -> dict:
    """Edge betweenness of a graph given as ``{vertex: set of neighbours}``, or the part of one of ``blocks`` of roots.

    Leaves are folded. Of the rest, vertices of the same neighbours and weight are twins: they may change places, so one
    of them is a root for all, paths through them are counted together, and the edges between two classes of twins have
    equal scores, to the last digit.
    """
    core, weight, out = _folded(adjacent)
    if block:
        out = {}
    classes: dict = {}
    for v, near in core.items():
        classes.setdefault((weight[v], frozenset(near)), []).append(v)
    members = list(classes.values())
    of = {v: k for k, vs in enumerate(members) for v in vs}
    near = [sorted({of[w] for w in core[vs[0]]}) for vs in members]
    many, each = [len(vs) for vs in members], [weight[vs[0]] for vs in members]
    sums: dict = defaultdict(float)
    twin = len(members)  # the twins of the root, where it has any
    for root in range(block, len(members), blocks):
        links, times, holds = near, [*many, many[root] - 1], [*each, each[root]]
        times[root] = 1
        if times[twin]:
            links = [*near, near[root]]
            for k in near[root]:
                links[k] = [*near[k], twin]
        level, paths, order = [-1] * (twin + 1), [0] * (twin + 1), [root]
        level[root], paths[root] = 0, 1
        for u in order:
            for w in links[u]:
                if level[w] < 0:
                    level[w] = level[u] + 1
                    order.append(w)
                if level[w] == level[u] + 1:
                    paths[w] += times[u] * paths[u]
        credit = list(map(float, holds))
        roots = many[root] * each[root] / 2
        for w in reversed(order):
            for u in links[w]:
                if level[u] == level[w] - 1:
                    share = credit[w] * paths[u] / paths[w]
                    credit[u] += times[w] * share
                    a, b = root if u == twin else u, root if w == twin else w
                    sums[(a, b) if a < b else (b, a)] += roots * share * times[u] * times[w]
    for (a, b), total in sums.items():
        score = total / (many[a] * many[b])
        for u in members[a]:
            for w in members[b]:
                out[(u, w) if u < w else (w, u)] = score
    return out


def _parts(adjacent: dict) -> dict:
    """The smallest vertex of each vertex's component."""
    least: dict = {}
    for v in sorted(adjacent):
        if v not in least:
            queue = deque([v])
            least[v] = v
            while queue:
                for w in adjacent[queue.popleft()]:
                    if w not in least:
                        least[w] = v
                        queue.append(w)
    return least


def _division(edges: list[tuple]) -> tuple[list[tuple[float, int, int]], list[int]]:
    """Steps of dividing one component: ``(strength, inner ends, sum of squared degrees)`` of each state, and for each edge the
    step in which it is taken out.

    ``strength`` is the largest betweenness in the state, to 9 digits, by which the next edges are taken out; the last
    state, without edges, has strength 0. Only the parts that lose an edge are measured again.
    """
    adjacent: dict = defaultdict(set)
    for u, w in edges:
        adjacent[u].add(w)
        adjacent[w].add(u)

    def measured(members: set) -> list[tuple]:
        """The parts of some vertices: ``(smallest vertex, vertices, degree, edge scores)``."""
        inner = {v: adjacent[v] for v in members}
        by_part = defaultdict(set)
        for v, c in _parts(inner).items():
            by_part[c].add(v)
        return [(c, vs, sum(len(adjacent[v]) for v in vs), {e: round(b, 9) for e, b in _scores({v: adjacent[v] for v in vs}).items()}) for c, vs in by_part.items()]

    state = {p[0]: p for p in measured(set(adjacent))}
    steps, gone = [], {}
    while True:
        strength = max((b for p in state.values() for b in p[3].values()), default=0.0)
        steps.append((strength, sum(p[2] for p in state.values()), sum(p[2] ** 2 for p in state.values())))
        if not strength:
            return steps, [gone[e] for e in edges]
        for part in [p for p in state.values() if p[3] and max(p[3].values()) == strength]:
            for (u, w), b in part[3].items():
                if b == strength:
                    gone[(u, w)] = len(steps) - 1
                    adjacent[u].discard(w)
                    adjacent[w].discard(u)
            del state[part[0]]
            state |= {p[0]: p for p in measured(part[1])}


def _best_moment(runs: dict, m: int, denominator: float) -> tuple[float, dict]:
    """The modularity and each component's step at the best moment of dividing all components side by side.

    The graph's state is known by the strength up to which edges have gone: in each moment the components of the highest
    strength move on by a step.
    """
    at = dict.fromkeys(runs, 0)
    inner, squares = (sum(r[0][k] for r in runs.values()) for k in (1, 2))
    heap = [(-r[0][0], c) for c, r in runs.items()]
    heapify(heap)
    moved: list = []  # the components that moved, moment by moment
    best, until = None, 0
    while heap and heap[0][0] < 0:
        q = round((inner - squares / denominator) / (2.0 * m), 9)
        if best is None or q > best:
            best, until = q, len(moved)
        top, now = heap[0][0], []
        while heap and heap[0][0] == top:
            now.append(heappop(heap)[1])
        for c in now:
            old, new = runs[c][at[c]], runs[c][at[c] + 1]
            at[c] += 1
            inner, squares = inner + new[1] - old[1], squares + new[2] - old[2]
            heappush(heap, (-new[0], c))
        moved += now
    moment = dict.fromkeys(runs, 0)
    for c in moved[:until]:
        moment[c] += 1
    return best, moment


def girvan_newman(v: DataFrame, e: DataFrame, denominator: str = "2m") -> DataFrame:
    """``(id, community, q)``: the division of highest modularity on the way from the whole graph to no edges.

    In each step all edges of the graph's highest betweenness (to 9 digits) go; of equal modularities (to 9 digits) the
    earliest counts; the state without edges is not scored. ``community`` is the smallest vertex. Vertices without an edge
    are communities of their own.

    Betweenness never crosses components, so components are divided in parallel, one to a task, which gives three numbers for
    each step and the step in which each edge goes. The driver merges the numbers of the steps, not more than there are
    edges, to find the best moment; communities are what the edges left then connect. One component must fit a task.
    """
    edges = written(e.select("src", "dst").distinct(), "edges")
    m = edges.count()
    if not m:
        return v.select("id", F.col("id").alias("community"), F.lit(0.0).alias("q"))
    component = connected_components(vertices(edges), edges)
    placed = edges.join(component.select(F.col("id").alias("src"), "component"), "src")
    kind = dict(edges.dtypes)["src"]

    def divide(t: pd.DataFrame) -> pd.DataFrame:
        steps, gone = _division(list(zip(t["src"], t["dst"])))
        c = t["component"].iloc[0]
        rows = [(c, k, *s, None, None) for k, s in enumerate(steps)] + [(c, k, None, None, None, a, b) for k, a, b in zip(gone, t["src"], t["dst"])]
        return pd.DataFrame(rows, columns=["component", "step", "strength", "inner", "squares", "src", "dst"]).astype({"inner": "Int64", "squares": "Int64"})

    states = written(placed.groupBy("component").applyInPandas(
        divide, f"component {kind}, step int, strength double, inner long, squares long, src {kind}, dst {kind}"), "division")
    runs: dict = {}
    for r in states.where("strength is not null").select("component", "step", "strength", "inner", "squares").orderBy("component", "step").toLocalIterator():
        runs.setdefault(r.component, []).append((r.strength, r.inner, r.squares))
    best, moment = _best_moment(runs, m, {"2m": 2.0 * m, "m": float(m)}[denominator])
    chosen = e.sparkSession.createDataFrame(pd.DataFrame({"component": list(moment), "step": list(moment.values())}), f"component {kind}, until int")
    left = states.where("src is not null").join(chosen, "component").where(F.col("step") >= F.col("until"))

    def connect(t: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict = defaultdict(set)
        for u, w in zip(t["src"], t["dst"]):
            adjacent[u].add(w)
            adjacent[w].add(u)
        parts = _parts(adjacent)
        return pd.DataFrame({"id": list(parts), "community": list(parts.values())})

    found = left.select("component", "src", "dst").groupBy("component").applyInPandas(connect, f"id {kind}, community {kind}")
    return v.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"), F.lit(best).alias("q"))
