"""Term index, top items and distinctive terms against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dredgeline.llm import distinctive_terms, term_index, top_items
from ..conftest import rows

SAID = [("1", "The cat. THE dog's 2nd tail_"), ("2", "the\ncat"), ("3", ""), ("4", None), ("5", "L'été à Köln ½"), ("6", "the the the"), ("7", "x" * 200_000 + " cat"), ("7", "…")]


def test_marks(spark):
    df = spark.createDataFrame([(i, t, "a", 9) for i, t in SAID], "id string, text string, term string, records int")
    count, held = Counter(), Counter()
    for _, t in SAID:
        found = re.findall(r"[^\W_]+", (t or "").lower())
        count.update(found)
        held.update(set(found))
    want = sorted(((w, count[w], held[w], "rare" if held[w] < 2 else "common" if held[w] > 0.35 * 7 else None) for w in count), key=repr)
    assert rows(term_index.marked_terms(df, "text", 2, 0.35)) == want


def test_terms_of_arrays(spark):
    df = spark.createDataFrame([(["A b", "c"],), (["c", "c", None],), ([],), (None,)], "v array<string>")
    assert rows(term_index.marked_terms(df, "v", 2, 0.5)) == [("A b", 1, 1, "rare"), ("c", 3, 2, "common")]
    assert term_index.marked_terms(df.limit(0), "v").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=60), st.integers(0, 3))
def test_containers(members, kind):
    if kind:
        members |= set(range(0, 65536, [0, 16, 15, 7][kind]))
    array = np.array(sorted(members), int)
    packed = term_index.pack(array)
    assert term_index.unpack(packed).tolist() == array.tolist() and len(packed) == min(2 * len(members), 8192)
    other = np.arange(3, 9000, 2)
    assert term_index.unpack(term_index.union([packed, term_index.pack(other)])).tolist() == sorted(members | set(other.tolist()))


def test_chunks_and_merge(spark, monkeypatch):
    monkeypatch.setattr(term_index, "CHUNK", 1 << 16)
    df = spark.range(0, 70_000, numPartitions=1).selectExpr("concat('all w', id % 3, if(id % 2 = 0, ' even', '')) as t")
    index = term_index.term_index(df, "t")
    assert index.select("chunk").distinct().count() == 2
    want = [("all", 70_000, 70_000), ("even", 35_000, 35_000)] + [(f"w{k}", 23_333 + (k == 0), 23_333 + (k == 0)) for k in range(3)]
    assert rows(term_index.term_frequencies(index)) == want
    twice = term_index.merged(index, index)  # the same records once more
    assert rows(term_index.term_frequencies(twice)) == [(t, 2 * n, d) for t, n, d in want]


# --- top items ---

def best(items, n):
    groups: dict = {}
    for g, s, t in items:
        if None not in (g, s, t):
            groups.setdefault(g, []).append((-s, t))
    return sorted(((g, -s, t, k + 1) for g, v in groups.items() for k, (s, t) in enumerate(sorted(v)[:n])), key=repr)


def test_top_items(spark):
    draw = random.Random(2)
    items = [(f"g{int(draw.paretovariate(0.5)) % 40}", draw.randrange(20), f"t{k % 900:03d}") for k in range(3000)]
    items += [(None, 1, "a"), ("g1", None, "a"), ("g1", 5, None), ("solo", -3, "é")] + items[:20]
    df = spark.createDataFrame([(g, s, t, "x", 0) for g, s, t in items], "g string, s int, t string, grp string, score int")
    for n in (1, 3, 50):
        assert rows(top_items.top_items(df, "g", "s", "t", n)) == best(items, n)
    assert top_items.top_items(df.limit(0), "g", "s", "t", 3).count() == 0


def test_hot_group_is_spread_and_skipped(spark, tmp_path):
    draw = random.Random(6)
    items = [("hot", draw.randrange(100_000), f"t{k:05d}") for k in range(30_000)] + [(f"g{k % 50}", k % 7, f"t{k:05d}") for k in range(1000)]
    df = spark.createDataFrame(items, "g string, s int, t string")
    path = str(tmp_path / "clustered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one file
    try:
        top_items.write_clustered(df, "g", "s", "t", path, row_group_bytes=4096, shares=16, floor=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(top_items.read_top(df, path, 3)[0]) == sorted(((g, s, t, k) for g, s, t, k in best(items, 3)), key=repr)
    of = df.sparkSession.read.parquet(path)
    assert of.where("grp = 'hot'").selectExpr("input_file_name()").distinct().count() > 1
    cost = top_items.read_top(df, path, 3)[1].first()
    assert cost.skipped > cost.read  # most row groups of the hot group are never read


def test_most_of_a_group_of_a_million_is_skipped(spark):
    """At the default sizes; groups smaller than a row group are read whole."""
    many = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("s"), F.format_string("t%07d", "id").alias("t"))
    few = spark.range(3000).select(F.concat(F.lit("g"), (F.col("id") % 500).cast("string")).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("s"), F.format_string("t%07d", "id").alias("t"))
    found, cost = top_items.top_items(many.unionByName(few), "g", "s", "t", 3, report=True)
    cost = cost.first()
    assert cost.skipped > 9 * cost.read and cost.bytes_skipped > 9 * cost.bytes_read
    assert [(r.s, r.t) for r in found.where("g = 'hot'").orderBy("rank").collect()] == [(r.s, r.t) for r in many.orderBy(F.desc("s"), "t").limit(3).collect()]
    assert found.where("g != 'hot'").count() == 1500


def test_skips_only_what_is_strictly_below(tmp_path):
    """Ties with the N-th score are read, and so is what begins a group."""
    held = [("a", 9 - k // 2, f"t{k}") for k in range(12)] + [("b", 1, "t")] + [("c", 5, f"t{k}") for k in range(6)]
    table = pa.table({"grp": [h[0] for h in held], "score": [h[1] for h in held], "tie": [h[2] for h in held]})
    pq.write_table(table, tmp_path / "f.parquet", row_group_size=3)
    for n in (1, 2, 3, 6, 100):
        got, cost = top_items.read_best(str(tmp_path / "f.parquet"), n)
        assert set(zip(*got.to_pydict().values())) >= {h for h in held if sum(x[0] == h[0] and (-x[1], x[2]) < (-h[1], h[2]) for x in held) < n}
        assert cost["read"] + cost["skipped"] == 7 and (n > 1 or cost["skipped"] == 3) and (n < 100 or not cost["skipped"])


def test_names_of_storage():
    assert top_items.filesystem("file:///a/b c")[1] == "/a/b c" and top_items.filesystem("file:/a")[1] == "/a" and top_items.filesystem("/a:b")[1] == "/a:b"
    fs, name = top_items.filesystem("s3a://bucket/a/b.parquet?region=eu-north-1")
    assert fs.type_name == "s3" and name == "bucket/a/b.parquet"


# --- distinctive terms ---

def profile(docs):
    once = {(r, d): t for r, d, t in docs if r is not None and d is not None and t is not None}
    k: dict = {}
    n_docs = Counter()
    for (r, _), t in once.items():
        found = re.findall(r"[^\W_]+", t.lower())
        n_docs[r] += bool(found)
        if found:
            k.setdefault(r, Counter()).update(found)
    d = Counter(w for c in k.values() for w in c)
    cf = Counter()
    for c in k.values():
        cf.update(c)
    return k, d, cf, n_docs


def em(counts, background, weight=0.1, rounds=20_000):
    p = {w: c / sum(counts.values()) for w, c in counts.items()}
    for _ in range(rounds):
        e = {w: c * weight * p[w] / (weight * p[w] + (1 - weight) * background[w]) for w, c in counts.items()}
        total = sum(e.values())
        new = {w: x / total for w, x in e.items()}
        if max(abs(new[w] - p[w]) for w in p) < 1e-9:
            return new
        p = new
    return p


DOCS = [(f"r{k % 7}", f"d{k}", " ".join(random.Random(k).choices(["alpha", "beta", "gamma", "the", "the", f"only{k % 7}", f"w{k}"], k=12))) for k in range(60)]
DOCS += [("hot", f"h{k}", f"the hot rare{k % 9} {'the ' * (k % 5)}") for k in range(150)] + DOCS[:9] + [(None, "x", "a"), ("r1", None, "a"), ("r1", "n", None), ("blank", "b1", " .. "), ("solo", "s1", "Été")]


@pytest.mark.parametrize("floor", [10**6, 50])
def test_distinctive_terms(spark, floor):
    """The same whether hot records are spread over tasks or not."""
    k, d, cf, n_docs = profile(DOCS)
    n, tokens = len(k), sum(cf.values())
    df = spark.createDataFrame([(r, i, t, "x", 1) for r, i, t in DOCS], "rec string, id string, body string, term string, k int")
    got = {(x.record, x.term): x for x in distinctive_terms.distinctive_terms(df, "rec", "id", "body", floor=floor, shares=8).collect()}
    assert set(got) == {(r, w) for r, c in k.items() for w in c}
    for r, c in k.items():
        p = em(c, {w: cf[w] / tokens for w in c})
        for w in c:
            x = got[(r, w)]
            assert (x.k, x.d, x.n, x.docs) == (c[w], d[w], n, n_docs[r])
            assert x.p_background == pytest.approx(cf[w] / tokens) and x.p_record == pytest.approx(p[w], abs=2e-4)
            assert x.score == pytest.approx(round(c[w] * math.log2(n / d[w]), 6), abs=1.1e-6)


@pytest.mark.parametrize("floor", [10**6, 50])
def test_best_terms(spark, floor):
    k, d, cf, _ = profile(DOCS)
    df = spark.createDataFrame(DOCS, "rec string, id string, body string")
    got = rows(distinctive_terms.distinctive_terms(df, "rec", "id", "body", per_record=2, by="score", floor=floor, shares=8).select("record", "term"))
    want = sorted((r, w) for r, c in k.items() for w in sorted(c, key=lambda w: (-round(c[w] * math.log2(len(k) / d[w]), 6), w))[:2])
    assert got == want


def test_common_terms_lose(spark):
    df = spark.createDataFrame(DOCS, "rec string, id string, body string")
    best_ = {x.record: x.term for x in distinctive_terms.distinctive_terms(df, "rec", "id", "body", per_record=1).collect()}
    assert all(best_[f"r{k}"] == f"only{k}" for k in range(7)) and best_["hot"] == "hot"


def test_no_documents(spark):
    df = spark.createDataFrame([], "rec string, id string, body string")
    assert distinctive_terms.distinctive_terms(df, "rec", "id", "body").count() == 0
    df = spark.createDataFrame([("a", "b", None), ("a", "c", "..")], "rec string, id string, body string")
    assert distinctive_terms.distinctive_terms(df, "rec", "id", "body").count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([("a", "1", "word " * 100_000 + "end"), ("b", "2", "word")], "rec string, id string, body string")
    got = {(x.record, x.term): x.k for x in distinctive_terms.distinctive_terms(df, "rec", "id", "body").collect()}
    assert got == {("a", "word"): 100_000, ("a", "end"): 1, ("b", "word"): 1}
