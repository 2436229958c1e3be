"""Every co-occurring pair of the test tables has a count, a test and a false-discovery value over all pairs."""

from itertools import combinations

from dredgeline.llm.queries import QUERIES


def test_surprise_of_every_pair(spark, duck, data):
    baskets: dict = {}
    for u, b in duck.execute("""select distinct trim(user_id), trim(business_id) from review
            where trim(review_id) <> '' and trim(user_id) <> '' and trim(business_id) <> ''""").fetchall():
        baskets.setdefault(u, []).append(b)
    want: dict = {}
    for held in baskets.values():
        for p in combinations(sorted(held), 2):
            want[p] = want.get(p, 0) + 1
    items = len({b for held in baskets.values() for b in held})
    got = QUERIES["p5_surprise"](spark, data).collect()
    assert {(r.a, r.b): r.c for r in got} == want and min(want.values()) == 1
    q, tests = 1.0, items * (items - 1) / 2
    ranked = sorted(got, key=lambda r: -r.p_value)
    for k, r in enumerate(ranked):
        q = min(q, r.p_value * tests / (len(ranked) - k))
        assert q * (1 - 1e-9) <= r.q_value <= 1.04 * q + 1e-12
