"""The command line on small files."""

import json
import random

import pytest

from dredgeline.__main__ import COMMANDS, main
from .test_graph import TOY


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    draw = random.Random(2)

    def lines(name, rows):
        (root / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    reviews = [{"review_id": str(k), "user_id": f"u{draw.randrange(8)}", "business_id": f"b{draw.randrange(6)}", "stars": str(1 + draw.randrange(5)), "text": draw.choice(["good food the", "bad, (slow)", "nice view"]), "date": f"20{18 + k % 3}-01-01"} for k in range(120)]
    lines("reviews", reviews)
    lines("business", [{"business_id": f"b{k}", "categories": "Food, Bar" if k % 2 else "Bar", "latitude": 1.0 * k, "longitude": 2.0} for k in range(6)])
    lines("users", [{"user_id": f"u{k}", "useful": k, "funny": 1, "fans": 0} for k in range(8)])
    lines("pairs", [{"user_id": f"u{k}", "business_id": f"b{k % 6}"} for k in range(8)])
    lines("names", [{"name": "a"}, {"name": None}, {"name": ""}, {"name": "Montréal"}])
    lines("probes", [{"name": "Montréal"}, {"name": "x"}, {"name": None}, {"name": "a"}])
    (root / "stop").write_text("the\n")
    (root / "toy.csv").write_text("user_id,state\n" + "".join(f"{a},{b}\n" for a, b in TOY))
    return root


def text(path):
    return sorted(line for p in path.glob("part-*") for line in p.read_text().splitlines())


def test_commands(spark, made):
    run = lambda *a: main([str(x) for x in a], spark)
    f = lambda name: made / name
    assert run("review-stats", f("reviews"), f("o1"), f("stop"), 2019, 3, 2) == 0
    got = json.loads(f("o1").read_text())
    assert got["A"] == 120 and got["B"] == 40 and got["C"] == 6 and len(got["D"]) == 3 and len(got["E"]) == 2
    run("top-categories", f("reviews"), f("business"), f("o2"), 5)
    assert {c for c, _ in json.loads(f("o2").read_text())["result"]} == {"Food", "Bar"}
    run("partition-stats", f("reviews"), f("o3"), 5, "--partitions", 4)
    got = json.loads(f("o3").read_text())
    assert got["n_partitions"] == 4 and sum(got["n_items"]) == 120
    run("itemsets", f("toy.csv"), f("o4"), 3, "--case", 2)
    assert f("o4").read_text().endswith("Frequent Itemsets:\n('A'),('C'),('D')\n\n")
    run("similar-business", f("reviews"), f("o5"))
    assert json.loads(text(f("o5"))[0]).keys() == {"b1", "b2", "sim"}
    run("content-train", f("reviews"), f("m1"), f("stop"))
    run("content-predict", f("pairs"), f("m1"), f("o6"))
    run("cf-train", f("reviews"), f("m2"), "item")
    run("cf-predict", f("reviews"), f("pairs"), f("m2"), f("o7"), "item")
    run("cf-train", f("reviews"), f("m3"), "user")
    run("cf-predict", f("reviews"), f("pairs"), f("m3"), f("o8"), "user")
    assert len(text(f("o7"))) == len(text(f("o8"))) == 8
    run("communities", f("toy.csv"), f("o9"), 1)
    assert "".join(text(f("o9"))).count("'") == 10
    run("divide", f("toy.csv"), f("o10"), f("o11"), "--case", 1)
    assert text(f("o10")) == sorted(["'B', 'CA', 'PQ'", "'BC', 'E', 'OU'", "'A', 'C', 'D', 'MB', 'MV', 'UV'"])
    assert "('BC', 'C'), 15.5" in text(f("o11"))
    run("bloom", f("names"), f("probes"), f("o12"))
    assert f("o12").read_text() == "T F F T"
    run("rate-train", f("reviews"), f("users"), f("business"), f("m4"))
    run("rate-predict", f("pairs"), f("users"), f("business"), f("m4"), f("o13"))
    assert len(text(f("o13"))) == 8


def test_usage(capsys):
    assert main(["nothing"]) == 2
    said = capsys.readouterr().out
    assert all(c in said for c in COMMANDS)
