"""Correlated records by the items both have rated, compared in the tasks where they meet.

A record's ratings go packed to each of its items but the most frequent, so a pair that meets there is measured on the
spot and its items are never spread out again. Of two records with ``least`` common items, the least frequent common
item is not among the ``least - 1`` most frequent of either: the pair is made there and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import coefficients
from ..session import written
from .pairs import dense_index

#: Ratings up to which a record is held in one row; pairs of larger ones are counted item by item.
LARGE = 512
#: Records that meet at one item in one task; where there are more, they meet block by block.
BLOCK = 2048
#: Groups above this size are compared all with all by products of matrices, smaller ones pair by pair.
DENSE = 256
#: Rows, and pairs in thousands, for each partition.
ROWS = 50_000
#: Pairs that a step of a task holds.
STEP = 1 << 19


@dataclass
class Rule:
    """Which pairs are similar. ``hashes`` are the ``(a, b)``, ``p`` and ``m`` of signatures that must agree somewhere."""

    least: int
    min_jaccard: float = 0.0
    hashes: tuple[list[tuple[int, int]], int, int] | None = None


def minhash_rule(n_hashes: int, p: int, m: int, seed: int, coefficient_bound: int) -> tuple[list[tuple[int, int]], int, int]:
    return coefficients(seed, n_hashes, 1, coefficient_bound, 0), p, m


def item_keys(rows: DataFrame, item: str) -> DataFrame:
    """``(item, key)``: how many rows an item has, and below that its number in :func:`dense_index`, as one number."""
    sizes = rows.groupBy(item).agg(F.count("*").alias("df"))
    return sizes.join(dense_index(rows, item), item).select(item, (F.shiftleft("df", 32) + F.col("idx")).alias("key"))


def packed(rows: DataFrame) -> DataFrame:
    """``(r, n, keys, vals)`` of ``(r, key, v)``, in order of keys; ``n`` of them are 0 or more.

    Ratings under keys below 0 are held, but records are not compared there.
    """
    held = F.sort_array(F.collect_list(F.struct("key", "v")))
    return rows.groupBy("r").agg(F.count_if(F.col("key") >= 0).alias("n"), held.alias("held")).select("r", "n", F.col("held.key").alias("keys"), F.col("held.v").alias("vals"))


def dealt(sets: DataFrame, least: int, *more: str) -> DataFrame:
    """``(r, keys, vals, item, lo, hi, own, *more)``: each record under its items, of which popular ones are split in blocks."""
    few = sets.where((F.col("n") >= least) & (F.col("n") <= LARGE))
    # keys below 0 come first; those of one record only make no pair
    met = few.withColumn("item", F.explode(F.expr(f"slice(filter(keys, k -> k >= 0), 1, cast(n as int) - {least - 1})"))).where(F.shiftright("item", 32) > 1)
    sizes = met.groupBy("item").agg(F.count("*").alias("size"))
    popular = written(sizes.where(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "popular")
    extra, pairs = popular.agg(F.sum(F.col("size") * F.col("blocks")), F.sum(F.col("size") * F.col("size"))).first()
    n = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), ((extra or 0) + met.count()) // ROWS + 1, (pairs or 0) // (1000 * ROWS))
    blocks = F.coalesce("blocks", F.lit(1))
    placed = met.join(popular.select("item", "blocks"), "item", "left").withColumn("own", F.pmod(F.xxhash64("r"), blocks).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    columns = spread.select("r", "keys", "vals", "item", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", *more)
    return columns.repartition(n, "item", "lo", "hi")


class _Rows:
    """The rows of a task as flat arrays; items are numbered in the order of their keys."""

    def __init__(self, table: pa.Table, rule: Rule) -> None:
        column = lambda name: table[name].combine_chunks()
        self.names, keys = column("r"), column("keys")
        self.rule, self.size = rule, np.diff(keys.offsets.to_numpy())
        self.all_keys, self.item = np.unique(keys.flatten().to_numpy(), return_inverse=True)
        self.value = column("vals").flatten().to_numpy()
        self.row = np.repeat(np.arange(len(self.names)), self.size)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.flat = self.row * len(self.all_keys) + self.item  # ascending
        self.hidden = np.searchsorted(self.all_keys, 0)  # items below it aren't measured
        able = self.item >= self.hidden
        self.n = np.bincount(self.row[able], minlength=len(self.names))
        self.at = np.searchsorted(self.all_keys, column("item").to_numpy())
        self.lo, self.hi, self.own = (column(k).to_numpy() for k in ("lo", "hi", "own"))
        self.signature = None
        if rule.hashes:
            (ab, p, m), index = rule.hashes, self.all_keys[self.hidden :] & 0xFFFFFFFF
            first = np.concatenate(([0], np.cumsum(self.n)))[:-1]  # every row has an item
            items = self.item[able] - self.hidden
            self.signature = np.stack([np.minimum.reduceat(((a * index + b) % p % m)[items], first) for a, b in ab], axis=1)

    def look(self, rows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ratings of items by rows are, and whether there are any."""
        want = rows * len(self.all_keys) + items
        at = np.minimum(np.searchsorted(self.flat, want), len(self.flat) - 1)
        return at, self.flat[at] == want

    def groups(self) -> Iterator[np.ndarray]:
        """Rows that meet, in order of ``own``."""
        order = np.lexsort((self.own, self.hi, self.lo, self.at))
        apart = np.zeros(len(order) - 1, bool)
        for x in (self.at, self.lo, self.hi):
            apart |= np.diff(x[order]) != 0
        return iter(np.split(order, np.flatnonzero(apart) + 1))

    def similar(self, a: np.ndarray, b: np.ndarray, n, sx, sy, sxy, sxx, syy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows with their positive correlations, where the rule holds."""
        spread, both = (n * sxx - sx * sx) * (n * syy - sy * sy), n * sxy - sx * sy
        keep = np.flatnonzero((n >= self.rule.least) & (spread > 0) & (both > 0) & (n >= self.rule.min_jaccard * (self.n[a] + self.n[b] - n)))
        a, b, sim = a[keep], b[keep], both[keep] / np.sqrt(spread[keep])
        if self.signature is not None:
            agree = np.zeros(len(a), bool)
            for s in range(0, len(a), STEP // 8):
                part = slice(s, s + STEP // 8)
                agree[part] = (self.signature[a[part]] == self.signature[b[part]]).any(axis=1)
            a, b, sim = a[agree], b[agree], sim[agree]
        return a, b, sim

    def one_by_one(self, groups: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs within small groups."""
        order, sizes = np.concatenate(groups), np.array([len(g) for g in groups])
        later = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(order)) - 1
        weight = np.cumsum(later * (self.size[order] + 1))
        for part in np.split(np.arange(len(order)), np.searchsorted(weight, np.arange(2 * STEP, weight[-1], 2 * STEP)) + 1):
            if not (count := later[part]).sum():
                continue
            left = np.repeat(part, count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            a, b = order[left], order[right]
            length = self.size[a]
            pair = np.repeat(np.arange(len(a)), length)
            entry = np.repeat(self.start[a], length) + np.arange(len(pair)) - np.repeat(np.cumsum(length) - length, length)
            item = self.item[entry]
            other, hit = self.look(b[pair], item)
            hit &= item >= self.hidden
            pair, x, y, item = pair[hit], self.value[entry[hit]], self.value[other[hit]], item[hit]
            total = lambda w=None, pair=pair, k=len(a): np.bincount(pair, w, minlength=k)
            # a pair belongs to the first of its common items
            here = np.flatnonzero((total(item < self.at[a][pair]) == 0) & (total() >= self.rule.least))
            sums = (total(w)[here] for w in (None, x, y, x * y, x * x, y * y))
            yield self.similar(a[here], b[here], *sums)

    def all_with_all(self, group: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs within a block, or of the rows before ``first`` with those after."""
        within, here = self.lo[group[0]] == self.hi[group[0]], self.at[group[0]]
        right = group if within else group[first:]
        re, rp = self._entries(right)
        items, counts = np.unique(self.item[re], return_counts=True)
        columns = items[counts >= max(8, len(right) // 32)]  # held by many: by matrices; the others one by one

        def matrices(entries, places, k):
            c = np.searchsorted(columns, self.item[entries])
            dense = np.append(columns, -1)[c] == self.item[entries]
            held, rated = np.zeros((k, len(columns))), np.zeros((k, len(columns)))
            held[places[dense], c[dense]] = 1
            rated[places[dense], c[dense]] = self.value[entries[dense]]
            return held, rated, entries[~dense], places[~dense]

        hb, xb, re, rp = matrices(re, rp, len(right))
        by_item = np.argsort(self.item[re], kind="stable")
        re, rp = re[by_item], rp[by_item]
        ritems, lower = self.item[re], columns < here
        step = max(1, STEP // len(right))
        for s in range(0, first, step):
            left = group[s : min(s + step, first)]
            ha, xa, le, lp = matrices(*self._entries(left), len(left))
            from_, to = (np.searchsorted(ritems, self.item[le], side=k) for k in ("left", "right"))
            count = to - from_
            mine = np.repeat(np.arange(len(le)), count)
            yours = np.repeat(from_, count) + np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count)
            cell, x, y, item = lp[mine] * len(right) + rp[yours], self.value[le[mine]], self.value[re[yours]], self.item[le[mine]]
            total = lambda w=None, cell=cell, k=len(left) * len(right): np.bincount(cell, w, minlength=k)
            n = (ha @ hb.T).ravel() + total()
            before = (ha[:, lower] @ hb[:, lower].T).ravel() + total(item < here)
            keep = (n >= self.rule.least) & (before == 0)
            if within:
                keep &= (np.arange(s, s + len(left))[:, None] < np.arange(len(right))[None, :]).ravel()
            keep = np.flatnonzero(keep)
            sums = (((p @ q.T).ravel() + total(w))[keep] for p, q, w in ((xa, hb, x), (ha, xb, y), (xa, xb, x * y), (xa * xa, hb, x * x), (ha, xb * xb, y * y)))
            yield self.similar(left[keep // len(right)], right[keep % len(right)], n[keep], *sums)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The measured ratings of rows, and the place of each one's row."""
        length = self.n[rows]
        place = np.repeat(np.arange(len(rows)), length)
        return np.repeat(self.start[rows + 1] - length, length) + np.arange(len(place)) - np.repeat(np.cumsum(length) - length, length), place

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        small = []
        for g in self.groups():
            first = int((self.own[g] == self.lo[g[0]]).sum())
            if self.lo[g[0]] == self.hi[g[0]] and len(g) <= DENSE:
                small.append(g)
            elif first and (first < len(g) or self.lo[g[0]] == self.hi[g[0]]):
                yield from self.all_with_all(g, first)
        if small:
            yield from self.one_by_one(small)


def _in_tasks(placed: DataFrame, rule: Rule, schema: str, make: Callable[[pa.Table, _Rows], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from make(table, _Rows(table, rule))

    return placed.mapInArrow(run, schema)


def small_pairs(sets: DataFrame, rule: Rule) -> DataFrame:
    """``(a, b, sim)``, ``a < b``, of the records of up to ``LARGE`` items in :func:`packed`, by the rule."""

    def make(table: pa.Table, rows: _Rows) -> Iterator[pa.RecordBatch]:
        rank = np.empty(len(rows.names), int)
        rank[pc.sort_indices(rows.names).to_numpy()] = np.arange(len(rank))
        for a, b, sim in rows.found():
            swap = rank[a] > rank[b]
            u, v = np.where(swap, b, a), np.where(swap, a, b)
            for s in range(0, len(u), STEP // 8):
                part = slice(s, s + STEP // 8)
                yield pa.RecordBatch.from_arrays([rows.names.take(pa.array(u[part])), rows.names.take(pa.array(v[part])), pa.array(sim[part])], names=["a", "b", "sim"])

    return _in_tasks(dealt(sets, rule.least), rule, "a string, b string, sim double", make)


def moved_by_small_pairs(sets: DataFrame, rule: Rule) -> DataFrame:
    """``(r, key, num, den)``: of the pairs of :func:`small_pairs` in which ``r`` asks for ``key`` (``asks``) and the other has
    rated it, the sums of ``sim`` times how far that rating lies from the other's ``mean``, and of ``sim``."""

    def make(table: pa.Table, rows: _Rows) -> Iterator[pa.RecordBatch]:
        asks, mean = table["asks"].combine_chunks(), table["mean"].to_numpy()
        many = np.diff(asks.offsets.to_numpy())
        begin, keys, of = np.cumsum(many) - many, asks.flatten().to_numpy(), np.repeat(np.arange(len(many)), many)
        place = np.minimum(np.searchsorted(rows.all_keys, keys), len(rows.all_keys) - 1)
        place[rows.all_keys[place] != keys] = -1
        num, den = np.zeros(len(keys)), np.zeros(len(keys))
        for a, b, sim in rows.found():
            for u, v in ((a, b), (b, a)):
                count = many[u]
                pair = np.repeat(np.arange(len(u)), count)
                ask = np.repeat(begin[u], count) + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
                known = place[ask] >= 0
                pair, ask = pair[known], ask[known]
                at, hit = rows.look(v[pair], place[ask])
                pair, ask, at = pair[hit], ask[hit], at[hit]
                w = sim[pair]
                num += np.bincount(ask, (rows.value[at] - mean[v[pair]]) * w, minlength=len(keys))
                den += np.bincount(ask, w, minlength=len(keys))
        got = np.flatnonzero(den > 0)
        yield pa.RecordBatch.from_arrays([rows.names.take(pa.array(of[got])), pa.array(keys[got]), pa.array(num[got]), pa.array(den[got])], names=["r", "key", "num", "den"])

    return _in_tasks(dealt(sets, rule.least, "asks", "mean"), rule, "r string, key long, num double, den double", make)
