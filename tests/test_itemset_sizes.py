"""Frequent itemsets of every size over the test tables, against sets of holders in plain Python."""

from itertools import combinations

import pytest

from dredgeline.operators import itemsets
from dredgeline.plans import mining
from .conftest import rows

EDGES = """select distinct nullif(trim(user_id), '') as u, nullif(trim(business_id), '') as b from review
    where nullif(trim(review_id), '') is not null and nullif(trim(user_id), '') is not null and nullif(trim(business_id), '') is not null"""


def brute(edges, support):
    holders: dict = {}
    for k, i in edges:
        holders.setdefault((i,), set()).add(k)
    level, out = {s: h for s, h in holders.items() if len(h) >= support}, []
    while level:
        out += [(",".join(s), len(s), len(h)) for s, h in level.items()]
        pairs = ((x, y) for x, y in combinations(sorted(level), 2) if x[:-1] == y[:-1])
        level = {(*x, y[-1]): level[x] & level[y] for x, y in pairs if len(level[x] & level[y]) >= support}
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["frequent_itemsets", "frequent_itemsets_two_pass"])
def test_businesses_of_users(spark, duck, data, name):
    edges = duck.execute(EDGES).fetchall()
    want = brute(edges, max(3, int(len({u for u, _ in edges}) * mining.ITEMSET_SHARE)))
    assert rows(mining.QUERIES[name](spark, data)) == want and max(n for _, n, _ in want) > 3


def test_users_of_businesses(spark, duck, data):
    edges = duck.execute(EDGES).fetchall()
    want = brute([(b, u) for u, b in edges], max(mining.SHARED_BUSINESSES, int(len({b for _, b in edges}) * mining.USER_SET_SHARE)))
    assert rows(mining.QUERIES["frequent_user_sets"](spark, data)) == want and max(n for _, n, _ in want) > 3


def test_pairs_of_rare_buckets_are_pruned():
    sets = [["a", "b"], ["a", "b"], ["a", "c"], ["c", "d"]]
    bitmap = itemsets.pair_bitmap(sets, 2, 1 << 17)
    assert bitmap.sum() == 1  # only a, b
    for buckets in (1, 2, 1 << 17):
        assert itemsets.local_itemsets(sets, 2, buckets=buckets) == [("a",), ("b",), ("c",), ("a", "b")]


def test_second_pass_of_any_candidates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, None), (None, "a"), (2, "b")], "k int, i string")
    asked = spark.createDataFrame([(["a"], 1), (["z"], 1), (["a", "b"], 2), (["a", "z"], 2), (["a", "b", "c"], 3)], "items array<string>, size int")
    assert rows(itemsets.counted_candidates(asked, df, "k", "i", 2)) == [(["a", "b"], 2, 2), (["a"], 1, 3)]
    for parts in (1, 5, None):
        found = itemsets.counted_candidates(itemsets.son_candidates(df, "k", "i", 2, parts, basket_rows=2), df, "k", "i", 2)
        assert rows(found) == [(["a", "b"], 2, 2), (["a"], 1, 3), (["b"], 1, 2)]
