"""Filling containers of fixed capacity, by bin completion over the histogram of item sizes."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Rows of one size that one task may rank.
RANKED = 200_000


class _Stock:
    """How many items of each size are left, with the largest size at most v for every v."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        self.below = np.maximum.accumulate(np.where(self.counts > 0, np.arange(len(counts)), 0))

    def take(self, filling: dict[int, int], times: int) -> None:
        for size, c in filling.items():
            self.counts[size] -= c * times
            if not self.counts[size]:
                lower = self.below[size - 1]
                end = size
                while end < len(self.below) and self.below[end] == size:
                    end += 1
                self.below[size:end] = lower

    def largest(self) -> int:
        return int(self.below[-1])


def _undominated(filling: dict[int, int], room: int, stock: _Stock) -> bool:
    """Whether no item left out could stand in for some items put in and still fit: for smaller ones in all, wasting less,
    or for several of the same size in all. Giving them its place elsewhere, no solution would be lost."""
    slack = room - sum(s * c for s, c in filling.items())
    if slack == 0:
        return True
    one, several = 0, 0  # bit s: some one item, or several items, of the filling are s in all
    for size, c in filling.items():
        for _ in range(c):
            several |= (several | one) << size
            one |= 1 << size
    bits = np.frombuffer((one | several | 1).to_bytes(room // 8 + 1, "little"), np.uint8)
    sums = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    other = stock.below[np.minimum(sums + slack, len(stock.below) - 1)]
    for s, x in zip(sums.tolist(), other.tolist()):
        while x > s and stock.counts[x] <= filling.get(x, 0):
            x = int(stock.below[x - 1])
        if x > s or (several >> s & 1 and stock.counts[s] > filling.get(s, 0)):
            return False
    return True


def fillings(stock: _Stock, room: int, width: int | None, tried: int | None = 3, steps: list[int] | None = None) -> list[dict[int, int]]:
    """Up to ``width`` undominated fillings of ``room`` (None: all), least waste first, then fewest items.

    Depth first, large items first, the ``tried`` largest sizes that fit (None: every size) at each item; ends early once
    ``width`` fillings leave nothing unused, or when ``steps``, a counter shared with the caller, has run out.
    """
    found: list[tuple[int, int, dict[int, int]]] = []
    steps = steps if steps is not None else [400]
    perfect = 0
    taken: dict[int, int] = {}

    def go(room: int, most: int, items: int) -> None:
        nonlocal perfect
        steps[0] -= 1
        size = int(stock.below[min(room, most)])
        while size and stock.counts[size] <= taken.get(size, 0):
            size = int(stock.below[size - 1])
        if not size:
            found.append((room, items, dict(taken)))
            perfect += room == 0
            return
        options = 0
        while size and (tried is None or options < tried) and (steps[0] > 0 or not found) and (width is None or perfect < width):
            free = int(stock.counts[size]) - taken.get(size, 0)
            if free > 0:
                # far from full, many items of one size go in at once; near the end, one by one
                c = 1 if width is None else max(1, min(free, (room // size) - 3))
                taken[size] = taken.get(size, 0) + c
                go(room - size * c, size, items + c)
                taken[size] -= c
                if not taken[size]:
                    del taken[size]
                options += 1
            size = int(stock.below[size - 1])

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * room + 1000))  # one call an item
    go(room, room, 0)
    found.sort(key=lambda f: (f[0], f[1]))
    out: list[dict[int, int]] = []
    for _, _, filling in found:
        if filling not in out and _undominated(filling, room, stock):
            out.append(filling)
        if len(out) == width:
            break
    return out or [found[0][2] if found else {}]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over the histogram: ``(filling, times)`` runs. The first incumbent."""
    stock, runs = _Stock(counts), []
    while largest := stock.largest():
        room, filling = capacity, {}
        while size := int(stock.below[min(room, len(stock.below) - 1)]):
            while size and stock.counts[size] <= filling.get(size, 0):
                size = int(stock.below[size - 1])
            if not size:
                break
            filling[size] = filling.get(size, 0) + min(int(stock.counts[size]) - filling.get(size, 0), room // size)
            room = capacity - sum(s * c for s, c in filling.items())
        times = min(int(stock.counts[s]) // c for s, c in filling.items())
        runs.append((filling, times))
        stock.take(filling, times)
    return runs


class Search:
    """The fullest containers found so far, for branch and bound over the histogram of sizes.

    The largest item left is completed by undominated fillings in turn. A branch ends when its waste exceeds what would save a
    container against the best so far, all ends at the lower bound ``ceil(total / capacity)``.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts, self.capacity = counts, capacity
        self.total = int((counts * np.arange(len(counts))).sum())
        self.best = best_fit(counts, capacity)
        self.fewest, self.bound = sum(t for _, t in self.best), -(-self.total // capacity)
        #: Whether no filling of all items can have fewer containers.
        self.proven = self.fewest == self.bound

    def run(self, steps: int, width: int | None, tried: int | None, budget: int) -> None:
        """Searches with ``width`` fillings a node and ``tried`` sizes at each item of a filling, found in ``budget`` steps each,
        and each used as often as the stock allows; ends when ``steps`` nodes are done.

        With a ``width`` of None, all undominated fillings are tried, each once: if that ends by itself, the best is proven to
        have the fewest containers. ``steps`` then counts the steps in filling too.
        """
        whole = width is None
        left = [steps]
        # a node: stock, options left, waste, containers
        stack: list[list] = [[_Stock(self.counts), None, 0, 0]]
        path: list[tuple[dict[int, int], int]] = []
        while stack and self.fewest > self.bound and left[0] > 0:
            stock, options, waste, used = stack[-1]
            if options is None:
                if not stock.largest():
                    if used < self.fewest:
                        self.best, self.fewest = list(path), used
                    options = []
                else:
                    left[0] -= 1
                    options = self._options(stock, width, tried, left if whole else [budget])
                stack[-1][1] = options
            if not options:
                stack.pop()
                if path:
                    path.pop()
                continue
            filling, times = options.pop(0)
            times = 1 if whole else times
            lost = waste + times * (self.capacity - sum(s * c for s, c in filling.items()))
            if lost > (self.fewest - 1) * self.capacity - self.total:
                continue
            after = _Stock(stock.counts)
            after.take(filling, times)
            path.append((filling, times))
            stack.append([after, None, lost, used + times])
        self.proven = self.fewest == self.bound or (whole and not stack and left[0] > 0)

    def _options(self, stock: _Stock, width: int | None, tried: int | None, steps: list[int]) -> list[tuple[dict[int, int], int]]:
        largest = stock.largest()
        without = _Stock(stock.counts)
        without.take({largest: 1}, 1)
        out = []
        for f in fillings(without, self.capacity - largest, width, tried, steps):
            whole = dict(f)
            whole[largest] = whole.get(largest, 0) + 1
            out.append((whole, min(int(stock.counts[s]) // c for s, c in whole.items())))
        return out


def bin_completion(counts: np.ndarray, capacity: int, width: int = 3, tried: int = 3, budget: int = 400, nodes: int = 20_000, steps: int = 200_000) -> Search:
    """Fillings and how often each is used, so that every item of the histogram is in one container.

    First a search of ``nodes`` nodes that looks at ``width`` fillings of each, see :meth:`Search.run`, which as a rule ends
    at the lower bound. If it does not, an exact one over all undominated fillings, for ``steps`` steps: small histograms are
    solved to the end, of others the best so far is kept, and ``proven`` says which it is.
    """
    search = Search(counts, capacity)
    if not search.proven:
        search.run(nodes, width, tried, budget)
    if not search.proven:
        search.run(steps, None, None, 0)
    return search


def _slots(runs: list[tuple[dict[int, int], int]], first: int) -> tuple[np.ndarray, ...]:
    """Where the items of each size go: from rank ``start`` of a size on, ``per`` items to a container from ``to`` on."""
    rows, at = [], {}
    for filling, times in runs:
        for size, c in filling.items():
            rows.append((size, at.get(size, 0), c, first))
            at[size] = at.get(size, 0) + c * times
        first += times
    rows.sort()
    size, start, per, to = (np.array([r[k] for r in rows], np.int64) for k in range(4))
    return (size << 40) + start, start, per, to


def fill_containers(df: DataFrame, item: str, size: str, capacity: int, report: bool = False, **limits: int) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``(item, piece, size, container)``: every item in a container of ``capacity``, with little room unused.

    An item larger than ``capacity`` alone is cut into pieces 0, 1, ... of ``capacity`` and a rest; all others are
    one piece 0. Items of size 0 go to container 0. Rows with a NULL item or size are left out; ``item`` must be unique.

    Only the histogram of sizes, at most ``capacity`` numbers, comes to the driver, which completes the containers; the
    items are then ranked within their size by hash classes of bounded size and looked up. So the result is as full
    as one search over all items, and no task or driver holds the items of a size.

    ``limits`` are those of :func:`bin_completion`. With ``report``, also one row ``(containers, least, proven)``: how many containers
    there are, the lower bound, and whether fewer are known to be impossible.
    """
    pieces = df.select(F.col(item).alias("item"), F.col(size).cast("long").alias("whole")).dropna().select(
        "item", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / capacity).cast("int") - 1, F.lit(0)))).alias("piece"))
    pieces = written(pieces.select("item", "piece", F.least(F.col("whole") - F.col("piece").cast("long") * capacity, F.lit(capacity).cast("long")).alias("size")), "pieces")
    counted = pieces.groupBy("size").count().toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[counted["size"]] = counted["count"]
    largest = int(counts.max())
    counts[0] = 0
    full = int(counts[capacity])
    counts[capacity] = 0
    search = bin_completion(counts, capacity, **limits)
    runs = ([({capacity: 1}, full)] if full else []) + search.best
    keys, start, per, to = _slots(runs, 0)

    parts = -(-largest // RANKED)
    classed = pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(parts)).cast("int"))
    offsets = classed.groupBy("size", "part").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = classed.withColumn("rank", F.row_number().over(Window.partitionBy("size", "part").orderBy("item", "piece")) - 1)
    ranked = ranked.join(offsets, ["size", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("long")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        s, r = size.to_numpy(), rank.to_numpy()
        if not len(keys):
            return pd.Series(np.zeros(len(s), np.int64))
        at = np.maximum(np.searchsorted(keys, (s << 40) + r, side="right") - 1, 0)
        return pd.Series(np.where(s == 0, 0, to[at] + (r - start[at]) // per[at]))

    filled = ranked.select(F.col("item").alias(item), "piece", "size", container("size", "rank").alias("container"))
    if not report:
        return filled
    found = (full + search.fewest, full + search.bound, search.proven)
    return filled, df.sparkSession.createDataFrame([found], "containers long, least long, proven boolean")
