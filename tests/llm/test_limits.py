"""Where expectation-maximisation ends, against a long run of it."""

import numpy as np
import pytest

from dredgeline.llm.distinctive_terms import distinctive_terms, parsimonious
from .test_terms import DOCS, profile


def records(seed, n=8, terms=60, length=400):
    """Records little different from their background, which take many rounds."""
    draw = np.random.default_rng(seed)
    share = 1 / np.arange(1, terms + 1)
    drawn = draw.multinomial(length, share / share.sum() * 0.9 + draw.dirichlet(np.full(terms, 0.1)) * 0.1, n)
    cf = drawn.sum(0) + 1
    held = [(c[c > 0], (cf / cf.sum())[c > 0]) for c in drawn]
    starts = np.append(0, np.cumsum([len(c) for c, _ in held])[:-1])
    return np.concatenate([c for c, _ in held]), np.concatenate([b for _, b in held]), starts


def em(k, b, weight, rounds):
    p = k / k.sum()
    for _ in range(rounds):
        e = k * weight * p / (weight * p + (1 - weight) * b)
        p = e / e.sum()
    return p


@pytest.mark.parametrize("weight", [0.02, 0.1, 0.6])
def test_parsimonious_is_the_limit(weight):
    counts, background, starts = records(int(weight * 100))
    got = parsimonious(counts, background, starts, weight)
    late = False
    for a, z in zip(starts, np.append(starts[1:], len(counts))):
        k, b, p = counts[a:z], background[a:z], got[a:z]
        assert p.sum() == pytest.approx(1, abs=1e-12) and (p >= 0).all()
        gain = k * weight / (weight * p + (1 - weight) * b)  # of more p: the same where p > 0, nowhere more
        assert gain[p > 0] == pytest.approx(gain.max(), rel=1e-9)
        assert p == pytest.approx(em(k, b, weight, 10_000), abs=2e-4)
        late |= bool(np.abs(p - em(k, b, weight, 50)).max() > 1e-3)
    assert late or weight > 0.5  # some record is far from its end after 50 rounds


def test_parsimonious_of_a_record_is_its_own():
    counts, background, starts = records(7)
    together = parsimonious(counts, background, starts)
    for a, z in zip(starts, np.append(starts[1:], len(counts))):
        assert together[a:z] == pytest.approx(parsimonious(counts[a:z], background[a:z], np.array([0])), abs=1e-14)


def test_parsimonious_of_copies():
    counts, background, copies = np.array([5, 2, 1]), np.array([1e-4, 3e-3, 2e-2]), np.array([2, 3, 4])
    apart = parsimonious(np.repeat(counts, copies), np.repeat(background, copies), np.array([0]))
    assert np.repeat(parsimonious(counts, background, np.array([0]), copies=copies), copies) == pytest.approx(apart, abs=1e-14)


@pytest.mark.parametrize("floor", [10**6, 50])
def test_terms_at_the_limit(spark, floor):
    """The same whether hot records are spread over tasks or not."""
    k, _, cf, _ = profile(DOCS)
    df = spark.createDataFrame(DOCS, "rec string, id string, body string")
    got = {(x.record, x.term): x.p_record for x in distinctive_terms(df, "rec", "id", "body", floor=floor, shares=8).collect()}
    assert set(got) == {(r, w) for r, c in k.items() for w in c}
    for r, c in k.items():
        p = em(np.array(list(c.values())), np.array([cf[w] for w in c]) / sum(cf.values()), 0.1, 50_000)
        assert [got[(r, w)] for w in c] == pytest.approx(p, abs=1e-4)
