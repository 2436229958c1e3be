import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dredgeline.operators.unpack import DELIMITERS, dialects, parse, unpacked
from .conftest import rows


def values(spark, fields, **more):
    df = spark.createDataFrame([(str(k), f, "x") for k, f in enumerate(fields)], "id string, packed string, value string")
    out: dict = {}
    for r in sorted(unpacked(df, "id", "packed", **more).collect(), key=lambda r: (r.id, r.pos)):
        out.setdefault(int(r.id), []).append(r.value)
    return [out.get(k, []) for k in range(len(fields))]


@pytest.mark.parametrize("field, want", [
    ("a, b ,c", ["a", "b", "c"]),
    ('"Parks, Trails";Swim;x', ["Parks, Trails", "Swim", "x"]),
    ('["a b","c"]', ["a b", "c"]),
    ('The, "The ""Quick"" Counter",b', ["The", 'The "Quick" Counter', "b"]),
    ('"""Old"" Barbers" | x', ['"Old" Barbers', "x"]),
    ("“a, b ” ; c", ["a, b", "c"]),
    (",, a,,b ,", ["a", "b"]),
    ('""', []), ("", []), (" , ", []),
    ("a, a,b", ["a", "a", "b"]),
    ('5" pipe, b', ['5" pipe', "b"]),
    ('"open, b', ['"open', "b"]),
    ("a\tb\nc", ["a", "b", "c"]),
    ("Farmers' Stalls,x", ["Farmers' Stalls", "x"]),
])
def test_parse(field, want):
    assert parse(field, DELIMITERS, True) == want


def test_columns_and_positions(spark):
    df = spark.createDataFrame([("k", "a; b ;a", 1), ("k", "a; b ;a", 1), ("n", None, 1), ("e", " ", 1), (None, "c", 1)], "id string, pos string, value int")
    assert rows(unpacked(df, "id", "pos")) == [("k", 1, "a"), ("k", 2, "b"), ("k", 3, "a"), (None, 1, "c")]


def test_dialect_of_fewest_bits(spark):
    """A delimiter inside values that other fields know whole does not separate there."""
    known = ["24/7 Diners; Solar", "Vegan; 24/7 Diners"] + ["24/7 Diners, x", "Solar, 24/7 Diners", '"24/7 Diners"'] * 20 + ["Solar", "Vegan"] * 20
    got = values(spark, [*known, "Solar/Vegan", "24/7 Diners, Vegan"])
    assert got[-1] == ["24/7 Diners", "Vegan"] and got[-2] == ["Solar", "Vegan"] and got[0] == ["24/7 Diners", "Solar"]


def test_long_and_empty(spark):
    many = [f"v{k}" for k in range(5000)]
    assert values(spark, [",".join(many), "", None]) == [many, [], []]
    assert values(spark, []) == []


def test_every_reading_is_bounded():
    assert len(dialects('"a",b;c|d/e\tf\n[g]')) == 2 * 2 ** len(DELIMITERS)
    assert dialects("plain") == [("", True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='ab",;| ', min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_quoted_round_trip(items):
    field = ", ".join('"' + i.replace('"', '""') + '"' for i in items)
    assert parse(field, DELIMITERS, True) == items


def test_as_separated_everywhere(spark, data):
    """On the test table no delimiter outside quotes is part of a value."""
    b = pd.read_parquet(f"{data}/business.parquet").drop_duplicates()
    want = sorted((i.strip(), k + 1, v) for i, c in zip(b.business_id, b.categories) if isinstance(c, str) for k, v in enumerate(parse(c, DELIMITERS, True)))
    from dredgeline.plans.places import p7_found

    assert sorted(map(tuple, p7_found(spark, data).collect())) == want
