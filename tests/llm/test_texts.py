"""Container filling, source mixing, visual form."""

import math
import os
import random
import string
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dredgeline.llm import mixing, packing, tokens, visual_form
from ..conftest import rows


def filled(spark, sizes, capacity, **more):
    df = spark.createDataFrame([(k, s, 0) for k, s in enumerate(sizes)], "id long, tokens long, container int")
    got = packing.fill_containers(df, "id", "tokens", capacity, **more).collect()
    load: dict = {}
    whole: dict = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.size
        whole.setdefault(r.id, []).append((r.piece, r.size))
    for k, s in enumerate(sizes):
        if s is None:
            assert k not in whole
            continue
        pieces = sorted(whole[k])
        assert sum(x for _, x in pieces) == s and [p for p, _ in pieces] == list(range(max(1, math.ceil(s / capacity)))) and all(x == capacity for _, x in pieces[:-1])
    assert all(x <= capacity for x in load.values())
    assert sorted(load) == list(range(len(load)))
    return len(load)


def test_containers(spark):
    draw = random.Random(1)
    sizes = [min(int(draw.lognormvariate(4, 1)), 9000) for _ in range(1500)] + [0, 0, None, 100, 100, 100, 250, 5000]
    used = filled(spark, sizes, 100)
    assert used <= math.ceil(sum(s or 0 for s in sizes) / 100) * 1.08
    small = [draw.randrange(1, 40) for _ in range(3000)]
    assert filled(spark, small, 100) == math.ceil(sum(small) / 100)


def test_odd_containers(spark, monkeypatch):
    assert filled(spark, [0, 0, None], 10) == 1
    assert filled(spark, [10] * 5, 10) == 5
    assert filled(spark, [7] * 9, 10) == 9
    assert filled(spark, [25], 10) == 3
    df = spark.createDataFrame([], "id long, tokens long")
    assert packing.fill_containers(df, "id", "tokens", 10).count() == 0
    monkeypatch.setattr(packing, "RANKED", 3)
    assert filled(spark, [3] * 40 + [4] * 30 + [6] * 30, 10) == 44


def optimal(sizes, capacity):
    """Fewest containers, by search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[k] <= capacity and bins[b] not in bins[:b]:
                bins[b] += sizes[k]
                go(k + 1, bins)
                bins[b] -= sizes[k]
        go(k + 1, bins + [sizes[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 29), min_size=1, max_size=11))
def test_branch_and_bound(sizes):
    """The exact search, after any other, ends with the fewest containers."""
    counts = np.bincount(sizes, minlength=31).astype(np.int64)
    for limits in ({}, {"nodes": 0}, {"width": 1, "tried": 1, "budget": 1}):
        search = packing.bin_completion(counts, 30, **limits)
        left = counts.copy()
        for filling, times in search.best:
            assert sum(s * c for s, c in filling.items()) <= 30 and times > 0
            for s, c in filling.items():
                left[s] -= c * times
        assert not left.any() and search.proven and search.fewest == sum(t for _, t in search.best) == optimal(sizes, 30)


def test_limits_are_reported(spark):
    """Best fit decreasing needs three containers where two do; without search, that is what comes out, and is said."""
    df = spark.createDataFrame(list(enumerate([5, 4, 3, 3, 3, 2, 10])), "id long, tokens long")
    _, whole = packing.fill_containers(df, "id", "tokens", 10, report=True)
    filled_, cut = packing.fill_containers(df, "id", "tokens", 10, report=True, nodes=0, steps=0)
    assert rows(whole) == [(3, 3, True)] and rows(cut) == [(4, 3, False)] and filled_.select("container").distinct().count() == 4


def test_dominated_fillings_go():
    stock = packing._Stock(np.bincount([2, 3, 5, 7], minlength=11).astype(np.int64))
    out = packing.fillings(stock, 10, 3)
    assert out[0] in ({7: 1, 3: 1}, {5: 1, 3: 1, 2: 1}) and all(sum(s * c for s, c in f.items()) == 10 for f in out)
    stock = packing._Stock(np.bincount([2, 3, 4, 9], minlength=11).astype(np.int64))
    assert not packing._undominated({2: 1, 3: 1, 4: 1}, 10, stock)  # 9 in place of all three
    assert not packing._undominated({3: 1}, 10, stock) and packing._undominated({9: 1}, 10, stock)
    stock = packing._Stock(np.bincount([1, 1, 2, 6], minlength=11).astype(np.int64))
    assert not packing._undominated({1: 2, 6: 1}, 9, stock)  # 2 in place of both


# --- mixing ---

def mixed(spark, records, targets, total=None):
    df = spark.createDataFrame([(k, s, n, "x") for k, (s, n) in enumerate(records)], "id long, src string, tokens long, budget string")
    t = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    chosen, shares = mixing.mix_sources(df, "id", "src", "tokens", t, total)
    got = chosen.collect()
    report = {r.source: r for r in shares.collect()}
    caps = {s: c for s, _, c in targets}
    for r in got:
        assert records[r.id] == (r.source, r.size) and 1 <= r.repeats <= caps[r.source]
    for s, r in report.items():
        assert r.reached == sum(x.size * x.repeats for x in got if x.source == s)
    return got, report


def test_shares(spark):
    draw = random.Random(3)
    records = [(draw.choice(["a"] * 8 + ["b"] * 3 + ["c", "z"]), draw.randrange(1, 50)) for _ in range(4000)] + [(None, 5), ("a", None), ("a", 0)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("absent", 0.05, 3)]
    got, report = mixed(spark, records, targets)
    for s, w, _ in targets[:3]:
        assert report[s].share == pytest.approx(w / 0.95, abs=0.002)
        assert abs(report[s].reached - report[s].budget) <= 25
    assert report["absent"].share == 0
    assert any(report[s].budget == report[s].max_repeats * report[s].available for s in "abc")
    assert {r.source for r in got} == {"a", "b", "c"}


def test_totals_are_nested(spark):
    draw = random.Random(4)
    records = [(draw.choice("ab"), draw.randrange(1, 50)) for _ in range(1000)]
    targets = [("a", 0.6, 1), ("b", 0.4, 3)]
    before: dict = {}
    for total in (0, 500, 5000, 20_000, 10**9):
        got, report = mixed(spark, records, targets, total)
        now = {r.id: r.repeats for r in got}
        assert all(now.get(k, 0) >= n for k, n in before.items())
        before = now
    assert report["a"].reached == report["a"].available and report["b"].reached == 3 * report["b"].available


def test_mixing_odd(spark):
    got, report = mixed(spark, [], [("a", 1.0, 2)])
    assert got == [] and report["a"].share == 0
    got, report = mixed(spark, [("a", 7)], [])
    assert got == [] and report == {}
    got, report = mixed(spark, [("a", 7)] * 3, [("a", 1.0, 2), ("n", None, 1)])
    assert sum(r.repeats for r in got) == 6 and report["a"].share == 1.0


# --- tokens ---

def test_token_counts(spark):
    if not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "日本語" * 3000)], "id int, text string")
    got = {r.id: r.tokens for r in tokens.token_counts(df, ["id"], "text").collect()}
    encode = tokens.encoder(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY))
    assert got == {1: 2, 2: 0, 3: 0, 4: len(encode.encode_ordinary("<|endoftext|>")), 5: len(encode.encode_ordinary("日本語" * 3000))}
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    for t in ["It's  a test\n\n of 42 things…", "El niño", "  x\t"]:
        assert len(encode.encode_ordinary(t)) == len(other.encode(t, add_special_tokens=False).ids)


# --- visual form ---

SAME = [
    ("Ｃafé １２３！", "Café 123!"), ("café", "café"), ("ﬁne ﬂag oﬀer", "fine flag offer"), ("a​b­c﻿", "abc"), ("a b　c d ", "a b c d "),
    ("раураl", "paypal"), ("ｶﾞｷﾞﾊﾟ", "ガギパ"), ("が", "が"), ("Οld ΝEW", "Old NEW"), ("q̣̇", "q̣̇"), ("ệ", "ệ"), ("한", "한"),
    ("한", "한"), ("ё", "ë"), ("й", "й"), ("Å", "Å"), ("ǆ", "dž"), ("⼀", "一"), ("क़", "क़"), ("x️", "x"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("1", "l"), ("it's", "it’s"), ("a b", "ab"), ("a\nb", "a b"), ("²", "2"), ("…", "..."), ("½", "1/2"), ("-", "–"), ("ß", "ss"), ("œ", "oe"), ("и", "u"), ("o", "0")]


def formed(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "id long, body string, form string, pos int")
    got = {r.id: r.form for r in visual_form.visual_form(df, "id", "body").collect()}
    assert len(got) == len(texts)
    return [got[k] for k in range(len(texts))]


def test_forms(spark):
    flat = [t for p in SAME + DIFFERENT for t in p]
    got = formed(spark, flat)
    assert got == [visual_form.form(t, visual_form.look_alikes(spark)) for t in flat]
    for k in range(0, 2 * len(SAME), 2):
        assert got[k] == got[k + 1], flat[k:k + 2]
    for k in range(2 * len(SAME), len(flat), 2):
        assert got[k] != got[k + 1], flat[k:k + 2]
    assert formed(spark, got) == got


def test_odd_texts(spark):
    long = "Ｌong café " * 20_000
    texts = [None, "", " ", "​​", "́", "́́á", "plain\ttext\r\n", "\x00a\x7f", "𝒳😀‍😀", long]
    assert formed(spark, texts) == [None if t is None else visual_form.form(t, visual_form.look_alikes(spark)) for t in texts]
    assert formed(spark, []) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=12), min_size=1, max_size=40), st.integers(0, 10**6))
def test_any_text(spark, texts, seed):
    draw = random.Random(seed)
    marks = [chr(c) for c in (0x300, 0x301, 0x308, 0x323, 0x327, 0x3099, 0x1161, 0x11a8, 0x93c, 0x9be)]
    texts = texts + ["".join(x + draw.choice(marks) * draw.randrange(3) for x in t) for t in texts]
    assert formed(spark, texts) == [visual_form.form(t, visual_form.look_alikes(spark)) for t in texts]


def test_form_is_stable(spark):
    alike = visual_form.look_alikes(spark)
    for o in range(0x80, 0x30000):
        c = chr(o)
        if unicodedata.category(c) not in ("Cs", "Cn", "Co"):
            assert visual_form.form(visual_form.form(c, alike), alike) == visual_form.form(c, alike), hex(o)


def test_letters_of_many_alphabets(spark):
    """Of the Unicode confusables, not only the commonest alphabets."""
    alike = visual_form.look_alikes(spark)
    assert {alike[c] for c in "ᎪꓮА"} == {"A"} and alike["ꓲ"] == alike["Ӏ"] == "I" and alike["ց"] == "g" and alike["ⲟ"] == "o"
    assert not set(alike) & set("ßœæþłийзлж一ー가") and all(len(v) == 1 and v in string.ascii_letters for v in alike.values()) and len(alike) > 250
    assert formed(spark, ["ᎪꓐϹ", "ρɑу"]) == ["ABC", "pay"]


def test_composition_is_canonical(spark):
    """Against the standard library: every composed code point, decomposed, with marks of other classes between."""
    draw = random.Random(8)
    marks = sorted(visual_form.classes())
    parts = [unicodedata.normalize("NFD", c) for c in visual_form.decompositions()] + [chr(0x1100 + k % 19) + chr(0x1161 + k % 21) + chr(0x11A7 + k % 28) for k in range(120)]
    parts += [p[0] + "".join(draw.choice(marks) for _ in range(draw.randrange(4))) + p[1:] + draw.choice(marks) for p in parts]
    parts += ["".join(draw.choice("aͅọ̧가ᅡᆨक़াো") + draw.choice(marks) * draw.randrange(2) for _ in range(draw.randrange(1, 8))) for _ in range(500)] + ["a" + "\u0301" * 500]
    got = {r.part: r.whole for r in visual_form.composed(spark.createDataFrame([(p,) for p in parts], "part string")).collect()}
    assert {p: unicodedata.normalize("NFC", p) for p in set(parts)} == got


def test_same_look(spark):
    texts = ["abc", "abc", "ａbc", "a​bc", "", " ", "​", None, "other", "OTHER", "abc"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, body string")
    pairs, members = visual_form.same_look(visual_form.visual_form(df, "id", "body"), "id", "body")
    assert pairs.count() == 3 and members.count() == 7
    key = {r.record: r.text_key for r in members.collect()}
    assert key[0] == key[1] == key[10] and len({key[0], key[2], key[3]}) == 3
