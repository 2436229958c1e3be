"""Reviews, itemsets, similarity, profiles, recommendation, sketches, regression on small tables."""

import collections
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dredgeline.functions.hashing import bytes_mod, coefficients, trailing_zeros, universal
from dredgeline.operators import itemsets, neighbours, pairs, profiles, recommend, regression, review, similarity, sketches, skew
from dredgeline.sources.tables import stars, unique_reviews
from .conftest import rows, shuffled

REVIEW = "review_id string, user_id string, business_id string, stars string, text string, date string, ingested_at timestamp"


def test_unique_reviews(spark):
    from datetime import datetime as d

    df = spark.createDataFrame([(" r1", "u ", "b", "4", "t", "2020-01-01", d(2020, 1, 2)), ("r1", "u", "b", "4", "t", "2020-01-01", d(2020, 1, 1)), (None, "u", "b", "1", "t", None, None), ("R1", None, " ", "x", None, None, None)], REVIEW)
    got = {r.review_id: (r.user_id, r.business_id, r.ingested_at) for r in unique_reviews(df).collect()}
    assert got == {"r1": ("u", "b", d(2020, 1, 1)), "R1": (None, None, None)}


def test_stars(spark):
    df = spark.createDataFrame([("4",), (" 4.0 ",), ("n/a",), ("",), (None,), ("7",), ("nan",)], "s string")
    assert [r[0] for r in df.select(stars(F.col("s"))).collect()] == [4.0, 4.0, None, None, None, None, None]


def test_review_lists(spark):
    df = spark.createDataFrame([("a", "x", "The cat, the (cat)! sat.", 5.0, "2020-05-01"), ("a", "y", None, 3.0, "2021-01-01 10:00:00"), ("b", "x", "", None, None), (None, None, "cat", 1.0, "2020-01-01")],
                               "user_id string, business_id string, text string, stars double, date string")
    stop = spark.createDataFrame([("the",)], "word string")
    assert rows(review.review_count(df)) == [(4,)]
    assert rows(review.review_count_year(df, 2020)) == [(2,)]
    assert rows(review.distinct_business(df)) == [(2,)]
    assert [tuple(r) for r in review.top_users(df, 5).collect()] == [("a", 2), ("b", 1)]
    assert rows(review.busy_business(df, 1)) == [("x", 2)]
    assert [tuple(r) for r in review.top_words(df, "text", 5, stop).collect()] == [("cat", 3), ("sat", 1)]
    business = spark.createDataFrame([("x", "P, Q ,P"), ("x", "P, Q ,P"), ("y", "Q"), ("z", None), ("w", "")], "business_id string, categories string")
    assert [tuple(r) for r in review.top_categories(df, business, 5).collect()] == [("P", 5.0), ("Q", 4.0)]
    assert sum(r.n_items for r in review.partition_stats(df, "user_id", 3).collect()) == 4
    assert review.partition_stats(df, "user_id", 3).count() == 3
    none = df.limit(0)
    assert rows(review.review_count(none)) == [(0,)] and review.top_users(none, 3).count() == 0


BASKETS = [("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b"), ("3", "a"), ("3", "b"), ("3", "c"), ("4", "c"), ("4", "c"), (None, "a"), ("5", None)]


def brute_sets(pairs_, support):
    held: dict = {}
    for k, i in pairs_:
        if k is not None and i is not None:
            held.setdefault(k, set()).add(i)
    items = sorted({i for s in held.values() for i in s})
    out = []
    for size in range(1, len(items) + 1):
        for c in itertools.combinations(items, size):
            n = sum(set(c) <= s for s in held.values())
            if n >= support:
                out.append((list(c), size, n))
    return sorted(out, key=repr)


def test_itemsets(spark):
    df = spark.createDataFrame(BASKETS, "k string, i string")
    assert rows(itemsets.frequent_itemsets(df, "k", "i", 2)) == brute_sets(BASKETS, 2)
    candidates = itemsets.son_candidates(df, "k", "i", 2)
    assert rows(itemsets.counted_candidates(candidates, df, "k", "i", 2)) == brute_sets(BASKETS, 2)
    assert itemsets.frequent_itemsets(df.limit(0), "k", "i", 1).count() == 0
    assert rows(itemsets.baskets(df, "k", "i"))[3] == ("4", ["c"])


def test_itemsets_toy(spark):
    from .test_graph import TOY

    df = spark.createDataFrame(TOY, "user string, state string")
    assert sorted(r["items"] for r in itemsets.frequent_itemsets(df, "user", "state", 2).collect()) == [[s] for s in ("BC", "CA", "MB", "MV", "OU", "PQ", "UV")]
    ones = itemsets.frequent_itemsets(df, "state", "user", 1)
    assert sorted("".join(r["items"]) for r in ones.where("size = 2").collect()) == ["AB", "AC", "AD", "BC", "CD", "CE", "DE"] and ones.where("size = 3").count() == 0
    assert sorted(r["items"][0] for r in itemsets.frequent_itemsets(df, "state", "user", 3).collect()) == ["A", "C", "D"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6).map(str), st.sampled_from("abcdef")), max_size=30), st.integers(1, 4))
def test_any_baskets(spark, pairs_, support):
    df = spark.createDataFrame(pairs_, "k string, i string")
    assert rows(itemsets.frequent_itemsets(df, "k", "i", support)) == brute_sets(pairs_, support)


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_shared_counts(spark, least):
    draw = random.Random(least)
    held = [(f"r{draw.randrange(20)}", f"i{int(draw.paretovariate(0.6)) % 15}") for _ in range(220)] + [("r1", None), (None, "i1")]
    sets: dict = {}
    for r, i in held:
        if r and i:
            sets.setdefault(r, set()).add(i)
    want = sorted(((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least), key=repr)
    df = spark.createDataFrame(held, "r string, i string")
    assert rows(pairs.shared_counts(df, "r", "i", least)) == want


def test_shared_counts_of_many_meetings(spark, monkeypatch):
    held = [(f"r{k}", f"i{(k * j) % 7}") for k in range(12) for j in range(1, 6)]
    df = spark.createDataFrame(held, "r string, i string")
    few = rows(pairs.shared_counts(df, "r", "i", 2))
    monkeypatch.setattr(pairs, "PAIRS_A_ROW", 0)
    assert few and rows(pairs.shared_counts(df, "r", "i", 2)) == few


@pytest.mark.parametrize("model", [recommend.item_cf_model])
def test_model_of_a_popular_business(spark, model):
    """A business that half of the users rate meets many others: its pairs are not spread over all its ratings again."""
    draw = random.Random(1)
    held = [(f"u{u}", "hub", float(draw.randint(1, 5))) for u in range(0, 1200, 2)] + [(f"u{u}", f"b{(u * 7 + j * 31) % 150}", float(draw.randint(1, 5))) for u in range(1200) for j in range(4)]
    rated = spark.createDataFrame(held, "user_id string, business_id string, stars double")
    found = {}
    moved = shuffled(spark, lambda: found.update({(r[0], r[1]): r[2] for r in model(rated).collect()}))
    stars_: dict = {}
    for u, b, s in held:
        stars_.setdefault(b, {})[u] = s
    want = {}
    for a, b in itertools.combinations(sorted(stars_), 2):
        both = sorted(stars_[a].keys() & stars_[b].keys())
        x, y = [stars_[a][u] for u in both], [stars_[b][u] for u in both]
        if len(both) >= 3 and np.std(x) and np.std(y) and (c := np.corrcoef(x, y)[0, 1]) > 1e-12:
            want[(a, b)] = c
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    assert moved < 3 * len(held)


def test_prediction_beside_a_popular_business(spark):
    draw = random.Random(2)
    held = [(f"u{u}", "hub", float(draw.randint(1, 5))) for u in range(0, 1200, 2)] + [(f"u{u}", f"b{(u * 7 + j * 31) % 150}", float(draw.randint(1, 5))) for u in range(1200) for j in range(4)]
    rated = spark.createDataFrame(held, "user_id string, business_id string, stars double")
    asked, averages = [("u2", "b1"), ("u3", "hub"), ("u4", "nowhere")], recommend.entity_averages(rated, "business_id")
    found = {}
    moved = shuffled(spark, lambda: found.update({(r[0], r[1]): r[2] for r in recommend.item_cf_predict(
        spark.createDataFrame(asked, "user_id string, business_id string"), rated, recommend.item_cf_model(rated), averages).collect()}))
    sims = {frozenset(r[:2]): r[2] for r in recommend.item_cf_model(rated).collect()}
    means = dict(map(tuple, averages.collect()))
    assert found.keys() == set(asked[:2])
    for u, b in asked[:2]:
        near = sorted(((-round(sims[frozenset((b, n))], 9), n, sims[frozenset((b, n))], s) for v, n, s in held if v == u and frozenset((b, n)) in sims))[:3]
        want = sum(s * w for _, _, w, s in near) / sum(w for _, _, w, _ in near) if near else means[b]
        assert abs(found[(u, b)] - want) < 1e-9
    assert moved < 8 * len(held)


def taste(n: int, seed: int) -> list[tuple[str, str, float]]:
    """Ratings of a few popular businesses, which many users share, and of others."""
    draw = random.Random(seed)
    held = {(f"u{u}", f"hub{h}"): float(draw.randint(1, 5)) for u in range(n) for h in range(6) if draw.random() < 0.5}
    held |= {(f"u{u}", f"b{draw.randrange(n)}"): float(draw.randint(1, 5)) for u in range(n) for _ in range(draw.choice([1, 3, 6, 20]))}
    return [(u, b, s) for (u, b), s in held.items()]


def similar_users(held) -> dict:
    """Positive correlations of users with three common businesses, of users and businesses with three ratings."""
    for k in (1, 0):
        many = collections.Counter(r[k] for r in held)
        held = [r for r in held if many[r[k]] >= 3]
    of: dict = {}
    for u, b, s in held:
        of.setdefault(u, {})[b] = s
    found = {}
    for a, b in itertools.combinations(sorted(of), 2):
        if len(both := sorted(of[a].keys() & of[b].keys())) >= 3 and len(both) >= 0.01 * len(of[a].keys() | of[b].keys()):
            x, y = [of[a][i] for i in both], [of[b][i] for i in both]
            if np.std(x) and np.std(y) and (c := np.corrcoef(x, y)[0, 1]) > 1e-12:
                found[(a, b)] = c
    return found


@pytest.mark.parametrize("large, block, dense, step", [(512, 2048, 256, 1 << 19), (512, 2048, 8, 64), (512, 20, 4, 1 << 12), (9, 20, 4, 1 << 12), (512, 20, 256, 1 << 19), (0, 20, 4, 64)])
def test_similar_users_of_popular_businesses(spark, monkeypatch, large, block, dense, step):
    """Users are compared where they meet, in any way; neither pairs nor their ratings are moved."""
    for name, value in (("LARGE", large), ("BLOCK", block), ("DENSE", dense), ("STEP", step)):
        monkeypatch.setattr(neighbours, name, value)
    held = taste(300, 3)
    rated, found = spark.createDataFrame(held, "user_id string, business_id string, stars double"), {}
    moved = shuffled(spark, lambda: found.update({(r[0], r[1]): r[2] for r in recommend.user_cf_model(rated, lsh=False).collect()}))
    want = similar_users(held)
    assert len(want) > 5000 and found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    if block == 2048:
        assert moved < 12 * len(held)
    same = {tuple(r[:2]) for r in recommend.user_cf_model(rated).collect()}
    assert same == signed(held, found)


def signed(held, pairs) -> set:
    """Those of the pairs whose signatures, of thirty hashes of the number of a business, agree somewhere."""
    for k in (1, 0):
        many = collections.Counter(r[k] for r in held)
        held = [r for r in held if many[r[k]] >= 3]
    number = {b: k for k, b in enumerate(sorted({r[1] for r in held}))}
    of: dict = {}
    for u, b, _ in held:
        of.setdefault(u, []).append(number[b])
    sig = {u: [min((a * k + b) % 23_333_333_333 % (2 * len(number)) for k in ks) for a, b in coefficients(2, 30, 1, 999_999, 0)] for u, ks in of.items()}
    return {(a, b) for a, b in pairs if any(x == y for x, y in zip(sig[a], sig[b]))}


@pytest.mark.parametrize("large, block, dense", [(512, 2048, 256), (9, 20, 4)])
def test_prediction_by_users_of_popular_businesses(spark, monkeypatch, large, block, dense):
    """The tasks that find similar users sum up what these say; neither pairs nor ratings are moved for it."""
    for name, value in (("LARGE", large), ("BLOCK", block), ("DENSE", dense)):
        monkeypatch.setattr(neighbours, name, value)
    held, draw = taste(300, 4), random.Random(4)
    raters = collections.Counter(b for _, b, _ in held)
    seldom = [b for b in sorted(raters) if raters[b] < 3]
    asked = [(f"u{draw.randrange(300)}", b) for b in seldom for _ in range(20)] + [(f"u{u}", f"hub{u % 6}") for u in range(200)] + [("u1", "nowhere"), ("nobody", "hub1"), (None, "hub1"), ("u2", "hub2")]
    rated, wanted = spark.createDataFrame(held, "user_id string, business_id string, stars double"), spark.createDataFrame(asked, "user_id string, business_id string")
    averages, found = recommend.entity_averages(rated, "user_id").where("user_id != 'u7'"), {}
    moved = shuffled(spark, lambda: found.update({r[:2]: r[2] for r in map(tuple, recommend.user_cf_predict(wanted, rated, None, averages).collect())}))
    want = {r[:2]: r[2] for r in map(tuple, recommend.user_cf_predict(wanted, rated, recommend.user_cf_model(rated), averages).collect())}
    means = dict(map(tuple, averages.collect()))
    for kind in (seldom, ["hub1"]):
        assert sum(abs(v - means.get(u, 3.83)) > 1e-9 for (u, b), v in want.items() if b in kind) >= 5
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    if block == 2048:
        assert moved < 20 * len(held)


def test_similar_candidates_of_popular_records(spark, monkeypatch):
    """Candidates of one-row bands between records of many items and no similarity are not spread over their items."""
    held = [(f"r{k:02d}", f"i{j}") for k in range(40) for j in range(k * 100, k * 100 + 104)]
    df = spark.createDataFrame(held, "id string, item string")
    sigs = df.select("id").distinct().withColumn("sig", F.array(*(F.lit(k) if k < 2 else F.xxhash64("id") + k if k > 3 else F.when(F.col("id") < "r38", 5).otherwise(7 + F.ascii(F.substring("id", 3, 1))) for k in range(6))))
    sigs = spark.createDataFrame(sigs.collect(), sigs.schema)
    found: list = []
    moved = shuffled(spark, lambda: found.extend(rows(similarity.lsh_join(df, "id", "item", sigs, 0.01, 3))))
    assert len(found) == 39 and moved < 12 * len(held)
    assert len(rows(similarity.lsh_join(df, "id", "item", sigs.withColumn("sig", F.slice("sig", 3, 2)), 0.01, 2))) == 37
    monkeypatch.setattr(similarity, "few_meet", lambda *_: False)
    assert rows(similarity.lsh_join(df, "id", "item", sigs, 0.01, 3)) == found


def test_user_digests(spark, monkeypatch):
    """As from the rows of words, which are not shuffled by user: a popular business's words go to a bucket once."""
    seen = [(f"u{k}", "hub") for k in range(400)] + [(f"u{k}", f"b{k % 7}") for k in range(300)] + [("solo", "one"), ("lost", "nowhere"), (None, "hub")]
    held = [("hub", f"wörd{j}") for j in range(200)] + [(f"b{b}", f"w{j * b}") for b in range(7) for j in range(20)] + [("one", "word")]
    users, words = spark.createDataFrame(seen, "user_id string, business_id string"), spark.createDataFrame(sorted(set(held)), "doc string, word string")
    want = profiles.user_profile(users, words).groupBy("user_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("word")), " ")).alias("words_md5"))
    monkeypatch.setattr(profiles, "USER_ROWS", 200)
    found: list = []
    moved = shuffled(spark, lambda: found.extend(rows(profiles.user_digests(users, words))))
    assert found == rows(want) and len(found) == 400
    assert moved < 5_000


def test_hash_fold(spark):
    df = spark.createDataFrame([("Los Angeles", 1704853), ("Montréal", 1300130), ("x", 851), ("a very long city name that is more than sixteen bytes", 299951)], "s string, want long")
    p = 23_333_333_333
    assert all(r[0] == r[1] for r in df.select(universal(bytes_mod(F.col("s"), p), 7, 11, p, 3_736_850), "want").collect())
    h = spark.createDataFrame([(0, 0), (1, 0), (8, 3), (12, 2)], "h long, z int")
    assert all(r[0] == r[1] for r in h.select(trailing_zeros(F.col("h")), "z").collect())
    assert len(set(coefficients(2, 30, 1, 99_999, 0))) == 30


def test_similarity(spark):
    sets = {"a": "1234", "b": "1234", "c": "3456", "d": "9", "e": "34567890"}
    df = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v] + [("a", "1"), (None, "1"), ("z", None)], "id string, item string")
    j = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    want = sorted((a, b, j(a, b)) for a in sets for b in sets if a < b and j(a, b) >= 0.2)
    assert rows(similarity.jaccard_join(df, "id", "item", 0.2)) == want
    for large in (2, 4, 10_000):
        similarity.LARGE = large
        assert rows(similarity.jaccard_join(df, "id", "item", 0.2)) == want and rows(similarity.jaccard_join(df, "id", "item", 0.5)) == [w for w in want if w[2] >= 0.5]
    similarity.LARGE = 20_000
    assert [w for w in rows(similarity.jaccard_join(df, "id", "item", 0.1)) if w[2] >= 0.2] == want
    index = similarity.dense_index(df, "item")
    assert rows(index) == [(str(k), k) for k in range(10)]
    sigs = similarity.minhash(df.join(index, "item"), "id", "idx")
    made = {r.id: list(r.sig) for r in sigs.collect()}
    assert made["a"] == made["b"] and all(len(s) == 30 for s in made.values())
    want = sorted((a, b) for a in made for b in made if a < b and any(x == y for x, y in zip(made[a], made[b])))
    assert rows(similarity.lsh_candidates(sigs, "id")) == want
    want = sorted((a, b) for a in made for b in made if a < b and any(made[a][k:k + 3] == made[b][k:k + 3] for k in range(0, 30, 3)))
    assert rows(similarity.lsh_candidates(sigs, "id", 10)) == want
    assert set(rows(similarity.jaccard_join(df, "id", "item", 0.2, similarity.lsh_candidates(sigs, "id")))) <= set(rows(similarity.jaccard_join(df, "id", "item", 0.2)))
    assert similarity.dense_index(df.limit(0), "item").count() == 0


def test_profiles(spark):
    docs = spark.createDataFrame([("b1", "apple, apple pear"), ("b1", "The (fig)"), ("b2", "apple plum"), ("b3", None), (None, "x")], "business_id string, text string")
    stop = spark.createDataFrame([("the",)], "word string")
    scores = profiles.tfidf(docs, "business_id", "text", stop)
    got = {(r.doc, r.word): (r.tf, round(r.score, 6)) for r in scores.collect()}
    assert got == {("b1", "apple"): (1.0, 0.0), ("b1", "pear"): (0.5, 0.5), ("b1", "fig"): (0.5, 0.5), ("b2", "apple"): (1.0, 0.0), ("b2", "plum"): (1.0, 1.0)}
    top = profiles.business_profile(scores, 2)
    assert rows(top) == [("b1", "fig"), ("b1", "pear"), ("b2", "apple"), ("b2", "plum")]
    seen = spark.createDataFrame([("u", "b1"), ("u", "b1"), ("v", "b2"), ("w", "b3"), (None, "b1")], "user_id string, business_id string")
    users = profiles.user_profile(seen, top)
    assert rows(users) == [("u", "fig"), ("u", "pear"), ("v", "apple"), ("v", "plum")]
    asked = spark.createDataFrame([("u", "b1"), ("u", "b1"), ("u", "b2"), ("x", "b1"), (None, "b1")], "user_id string, business_id string")
    assert [(r[0], r[1], round(r[2], 9)) for r in rows(profiles.cosine_score(asked, users, top))] == [("u", "b1", 1.0)]
    assert rows(profiles.rare_words(docs, "text", 0.2)) == [(w, 1) for w in ("fig", "pear", "plum", "the", "x")]


def pearson(x, y):
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    num = sum((a - mx) * (b - my) for a, b in zip(x, y))
    den = (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    return num / den if num and den else 0.0


def test_recommend(spark):
    draw = random.Random(5)
    given_ = {(f"u{draw.randrange(12)}", f"b{draw.randrange(9)}"): float(draw.randrange(1, 6)) for _ in range(90)}
    rated = spark.createDataFrame([(u, b, s) for (u, b), s in given_.items()], "user_id string, business_id string, stars double")
    of_b: dict = {}
    for (u, b), s in given_.items():
        of_b.setdefault(b, {})[u] = s
    sims = {}
    for a in of_b:
        for b in of_b:
            both = sorted(of_b[a].keys() & of_b[b].keys())
            if a < b and len(both) >= 3 and (r := pearson([of_b[a][u] for u in both], [of_b[b][u] for u in both])) > 1e-12:
                sims[(a, b)] = r
    model = recommend.item_cf_model(rated)
    assert {(r.b1, r.b2): round(r.sim, 9) for r in model.collect()} == {k: round(v, 9) for k, v in sims.items()}
    asked = spark.createDataFrame([("u1", "b1"), ("u1", "b1"), ("u2", "b3"), ("nobody", "b1"), ("u1", "nowhere"), (None, "b1")], "user_id string, business_id string")
    averages = recommend.entity_averages(rated, "business_id")
    got = {(r.user_id, r.business_id): r.stars for r in recommend.item_cf_predict(asked, rated, model, averages).collect()}
    assert set(got) == {("u1", "b1"), ("u2", "b3")}
    for u, b in got:
        best = sorted(((-sims.get((min(b, o), max(b, o)), 0), o, s) for (v, o), s in given_.items() if v == u and sims.get((min(b, o), max(b, o)), 0) > 0))[:3]
        want = sum(-w * s for w, _, s in best) / sum(-w for w, _, _ in best) if best else sum(of_b[b].values()) / len(of_b[b])
        assert got[(u, b)] == pytest.approx(want)
    users = recommend.user_cf_model(rated, lsh=False)
    assert users.where("u1 >= u2 or sim <= 0 or sim > 1.0000001").count() == 0
    assert set(rows(recommend.user_cf_model(rated).select("u1", "u2"))) <= set(rows(users.select("u1", "u2")))
    made = recommend.user_cf_predict(asked, rated, users, recommend.entity_averages(rated, "user_id"))
    assert made.count() == 2 and made.where("stars is null").count() == 0
    assert recommend.item_cf_model(rated.limit(0)).count() == 0


def test_latest_rating(spark):
    df = spark.createDataFrame([("u", "b", 2.0, "2020-01-02"), ("u", "b", 5.0, "2020-01-01"), ("u", "b", 4.0, None), ("u", "c", None, "2020-01-01"), (None, "b", 1.0, None)], "user_id string, business_id string, stars double, date string")
    assert rows(recommend.ratings(df)) == [("u", "b", 2.0)]


def test_bloom(spark):
    names = spark.createDataFrame([("a",), ("é",), ("a",), ("",), (None,)], "n string")
    bits = sketches.bloom_build(names, "n")
    asked = spark.createDataFrame([("a",), ("é",), ("zzz",), ("",), (None,)], "n string")
    assert {r.name: r.hit for r in sketches.bloom_probe(asked, "n", bits).collect()} == {"a": True, "é": True, "zzz": False, "": False, None: False}
    assert not any(r.hit for r in sketches.bloom_probe(asked, "n", sketches.bloom_build(names.limit(0), "n")).collect())


def test_reservoir_and_tags(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = sketches.reservoir(df, "k", 100)
    assert one.count() == 100 and rows(one) == rows(sketches.reservoir(df.repartition(7), "k", 100)) and rows(one) != rows(sketches.reservoir(df, "k", 100, seed=1))
    assert sketches.reservoir(df.limit(7), "k", 100).count() == 7
    tags = spark.createDataFrame([(["a", "b"],), (["a"],), (["c"],), (["b-"],), ([],), (None,), (["d"],), (["a", "c"],), (["e", "e"],)], "t array<string>")
    assert rows(sketches.trending_tags(tags, "t", 2)) == [("a", 3), ("c", 2), ("e", 2)]


def test_fm_window_empty_and_nulls(spark):
    from datetime import datetime as d

    df = spark.createDataFrame([(d(2024, 1, 1), "a"), (d(2024, 1, 1, 0, 0, 5), "b"), (d(2024, 1, 1), None), (None, "a"), (d(2024, 1, 1), "")], "ts timestamp, v string")
    got = sketches.fm_window(df, "ts", "v").collect()
    assert len(got) == 3 and {r.exact for r in got} == {2} and all(r.estimate >= 1 for r in got)
    assert sketches.fm_window(df.limit(0), "ts", "v").count() == 0


def test_regression(spark):
    draw = random.Random(3)
    users = spark.createDataFrame([(f"u{k}", k, k % 3) for k in range(20)] + [("u1", 1, 1), ("n", None, 1)], "user_id string, useful long, funny long")
    places = spark.createDataFrame([(f"b{k}", float(k), 1.0) for k in range(20)] + [("bad", float("nan"), 1.0)], "business_id string, latitude double, longitude double")
    rated = spark.createDataFrame([(f"u{draw.randrange(20)}", f"b{k % 20}", float(1 + k % 5)) for k in range(200)] + [("n", "b1", 3.0), ("u1", "bad", 2.0), ("none", "b1", 1.0)], "user_id string, business_id string, stars double")
    features = regression.rating_features(rated, users, places)
    assert features.count() == 203 and features.where("user_id in ('n', 'none') or business_id = 'bad'").where("x0 + x1 + x2 + x3 != 0").count() == 0
    model = regression.fit_ratings(features, 200)
    made = regression.predict_ratings(model, features)
    error = made.join(features, ["user_id", "business_id"]).selectExpr("avg((stars - y) * (stars - y))").first()[0]
    base = features.selectExpr("var_pop(y)").first()[0]
    assert error < base
    with pytest.raises(Exception, match="lacks a feature"):
        regression.rating_features(rated, users, places, "error").collect()


def test_trees(spark, tmp_path):
    """The sum over rows equals that over cells, a held-out error far below the spread, and a model that is saved whole."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (3000, 4))
    y = 3 + np.where(x[:, 0] > 0.2, 1.5, -0.5) * np.where(x[:, 2] > -0.3, 1, -1) + 0.1 * rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"user_id": np.arange(3000).astype(str), "business_id": "b", **{f"x{k}": x[:, k] for k in range(4)}, "y": y}))
    model = regression.fit_ratings(df.where("cast(user_id as int) < 2000"), 300, 0.05)
    held = df.where("cast(user_id as int) >= 2000")
    made = regression.predict_ratings(model, held.drop("y"))
    error = made.join(held, ["user_id", "business_id"]).selectExpr("sqrt(avg(pow(stars - y, 2)))").first()[0]
    assert made.count() == 1000 and error < 0.3 < np.std(y) / 3
    model.save(spark, str(tmp_path / "m"))
    again = regression.Trees.load(spark, str(tmp_path / "m"))
    assert rows(regression.predict_ratings(again, held)) == rows(made)
    nothing = regression.fit_ratings(df.limit(0))
    assert regression.predict_ratings(nothing, held).select("stars").distinct().collect()[0].stars == 0.0
    one = next(regression.boosted(np.array([[0], [1], [2]]), np.array([2, 1, 4]), np.array([2.0, 5.0, 20.0]), 0.0, 3, 1, 1.0, 2, 1.0, 1.0, 0.0, rng))
    assert sorted(set(one[2])) == [0.0, 1.0, 5.0]  # leaves hold the means


def test_hot_keys(spark):
    df = spark.createDataFrame([("hot", k) for k in range(500)] + [(f"k{k}", k) for k in range(100)] + [(None, 0)] * 50, "key string, v int")
    hot = skew.hot_keys(df, "key", shares=8, floor=50)
    assert rows(hot) == [("hot", 7)]
    spread = skew.salted(df, "key", F.col("v"), hot)
    assert spread.count() == df.count() and spread.where("key = 'hot'").select("salt").distinct().count() == 7 and spread.where("key != 'hot' and salt != 0").count() == 0
    assert skew.hot_keys(df, "key").count() == 0


def test_scratch(spark):
    import os

    from dredgeline import session

    held = session.written(spark.range(5), "kept")
    path = session._scratch[-1]
    assert held.count() == 5 and os.path.isdir(path.replace("file://", ""))
    session._scratch[:] = [path]
    session.drop_scratch(spark)
    assert not os.path.exists(path.replace("file://", ""))


def test_recall_of_banding(spark, data):
    """Candidates from signatures against all pairs above the threshold."""
    from dredgeline.plans.mining import QUERIES

    some, every = ({(r.id1, r.id2) for r in QUERIES[name](spark, data).collect()} for name in ("lsh_jaccard", "jaccard_join"))
    assert some <= every and len(some) >= 0.9 * len(every) > 100
