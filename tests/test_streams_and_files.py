import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dredgeline.operators.sketches import fm_window
from dredgeline.sources import files, reports
from dredgeline.streaming import sampling, windows
from .conftest import rows


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    draw = random.Random(1)
    events = [(start + timedelta(seconds=k), str(draw.randrange(40))) for k in range(300)]
    for part in range(3):
        spark.createDataFrame(events[part * 100:(part + 1) * 100], "ts timestamp, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = windows.distinct_stream(stream, "ts", "v")
    windows.start(counts, str(tmp_path / "c1"), table="closed_windows").awaitTermination()
    batch = {tuple(r) for r in fm_window(spark.createDataFrame(events, "ts timestamp, v string"), "ts", "v").collect()}
    got = {tuple(r) for r in spark.table("closed_windows").collect()}
    assert got <= batch and len(got) >= 25
    report = tmp_path / "report.csv"
    windows.start(counts, str(tmp_path / "c2"), csv=str(report)).awaitTermination()
    lines = report.read_text().splitlines()
    assert lines[0] == "Time,Ground Truth,Estimation" and len(lines) == 1 + len(got)


def test_reservoir_stream(spark, tmp_path):
    messages = [(["good"],), (["bad-tag"],), ([],), (None,), (["a", "b"],)] * 100
    spark.createDataFrame(messages, "tags array<string>").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tags array<string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    report = tmp_path / "trend.csv"
    sampling.report_trending(sampling.reservoir_stream(stream, "tags", capacity=30), str(report), str(tmp_path / "c"), capacity=30).awaitTermination()
    lines = [x.split(",") for x in report.read_text().splitlines()]
    assert lines[0] == ["seen", "tag", "n"] and lines[-1][0] == "200"
    last = [x for x in lines[1:] if x[0] == "200"]
    assert {x[1] for x in last} == {"good", "a", "b"} and 30 <= sum(int(x[2]) for x in last) <= 60
    n = sampling.running_count(stream, "tags").writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "r")).trigger(availableNow=True).start()
    n.awaitTermination()
    assert rows(spark.table("running")) == [(200,)]


def test_shards_are_merged_and_replays_count_once(spark, tmp_path):
    class Sampled:
        """Stands for a stream whose batches are given by hand."""

        def __getattr__(self, _):
            return lambda *a, **k: self

        def foreachBatch(self, call):
            self.call = call
            return self

    sampled = Sampled()
    sampled.writeStream = sampled
    report = tmp_path / "t.csv"
    sampling.report_trending(sampled, str(report), "-", top=1, capacity=6)
    batches = [[(0, 3, ["a"])] * 3, [(1, 5, ["b"])] * 5, [(2, 9, ["c"])] * 6 + [(3, 1, ["b"])]]
    frames = [spark.createDataFrame(b, "shard int, seen long, tags array<string>") for b in batches]
    for number, f in enumerate(frames):
        sampled.call(f, number)
    first = report.read_text()
    lines = [x.split(",") for x in first.splitlines()]
    assert lines[0] == ["seen", "tag", "n"] and {x[0] for x in lines[1:]} == {"8", "18"}  # 3 are fewer than the capacity
    sampled.call(frames[2], 2)  # the last batch again, and one before it
    sampled.call(frames[1], 1)
    assert report.read_text() == first
    sampled.call(frames[0].limit(0), 3)
    assert report.read_text() == first


def test_four_shards_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(k, ["x", "y"] if k % 2 else ["x"]) for k in range(400)], "id long, tags array<string>").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, tags array<string>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    report = tmp_path / "four.csv"
    sampled = sampling.reservoir_stream(stream, "tags", capacity=50, shards=4, spread="id")
    sampling.report_trending(sampled, str(report), str(tmp_path / "c"), capacity=50).awaitTermination()
    lines = [x.split(",") for x in report.read_text().splitlines()]
    assert lines[-1][0] == "400" and [x[1:] for x in lines if x[0] == "400"][0] == ["x", "50"]


def test_reservoir_is_uniform():
    hits = [0] * 20
    for trial in range(3000):
        kept: list = []
        draw, seen = random.Random(trial), 0
        for k in range(20):
            seen = sampling.keep(kept, seen, [k], 5, draw)
        for k in kept:
            hits[k] += 1
    assert all(abs(h - 750) < 120 for h in hits)


def test_merged_shards_are_uniform():
    hits = [0] * 30
    for trial in range(3000):
        draw = random.Random(trial)
        shards = {}
        for k, (start, end) in enumerate([(0, 20), (20, 27), (27, 30)]):
            kept: list = []
            shards[k] = (sampling.keep(kept, 0, list(range(start, end)), 6, draw), kept)
        merged = sampling.merge_shards(shards, 6, draw)
        assert len(set(merged)) == 6
        for k in merged:
            hits[k] += 1
    assert all(abs(h - 600) < 110 for h in hits)
    assert sampling.merge_shards({}, 5) == [] and sampling.merge_shards({1: (2, ["a", "b"])}, 5, random.Random(1)) in (["a", "b"], ["b", "a"])


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"review_id": "1", "text": "x", "more": 1}\n{"review_id": "2", "stars": "5.0"}\n')
    got = files.json_lines(spark, str(tmp_path / "r.json"), files.REVIEW)
    assert [(r.review_id, r.text, r.stars) for r in got.orderBy("review_id").collect()] == [("1", "x", None), ("2", None, "5.0")]
    (tmp_path / "bad.json").write_text('{"review_id": \n')
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "bad.json"), files.REVIEW).collect()
    assert files.json_lines(spark, str(tmp_path / "bad.json"), files.REVIEW, strict=False).count() == 1
    (tmp_path / "p.csv").write_text("user,state\nA,CA\nB,MB\n")
    assert rows(files.csv_pairs(spark, str(tmp_path / "p.csv"))) == [("A", "CA"), ("B", "MB")]
    assert rows(files.csv_pairs(spark, str(tmp_path / "p.csv"), swap=True)) == [("CA", "A"), ("MB", "B")]
    (tmp_path / "q.csv").write_text("user,state\nA,CA\nuser,state\nB,\n")
    assert rows(files.csv_pairs(spark, str(tmp_path / "q.csv"))) == [("A", "CA"), ("B", None)]
    (tmp_path / "stop").write_text("the\n a \n\nthe\n")
    assert rows(files.stop_words(spark, str(tmp_path / "stop"))) == [("a",), ("the",)]
    (tmp_path / "m.json").write_text('{"type": "u", "id": "1", "n": 2}\n{"type": "b", "id": "9"}\n')
    assert rows(files.tagged(spark, str(tmp_path / "m.json"), "id string, n int", "u")) == [("1", 2)]
    (tmp_path / "avg").write_text('{"a": 4.5, "b": 1}\n{"c": 2}\n')
    assert rows(files.average_map(spark, str(tmp_path / "avg"))) == [("a", 4.5), ("b", 1.0), ("c", 2.0)]
    lines = spark.createDataFrame([('{"state": "CA"}',), ("{",)], "value string")
    assert rows(files.parsed(lines, "state string")) == [("CA",), (None,)]
    said = spark.createDataFrame([("Spark is fun",), ("nothing",), (None,)], "t string")
    assert files.tracked(said, "t", ["SPARK", "flink"]).count() == 1 and files.tracked(said, "t", []).count() == 0


def test_reports(spark, tmp_path):
    sets = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "items array<string>")
    reports.itemset_report(str(tmp_path / "i"), sets, sets.limit(0))
    assert (tmp_path / "i").read_text() == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n"
    parts = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "id string, community string")
    assert [r.line for r in reports.community_lines(parts).collect()] == ["'c'", "'a', 'b'"]
    scores = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "src string, dst string, betweenness double")
    assert [r.line for r in reports.betweenness_lines(scores).collect()] == ["('a', 'c'), 2.5", "('a', 'b'), 1.0"]
    reports.json_object(str(tmp_path / "o"), A=3, D=scores.orderBy("dst").select("dst"))
    assert json.loads((tmp_path / "o").read_text()) == {"A": 3, "D": [["b"], ["c"]]}
    reports.hits_row(str(tmp_path / "h"), [True, False])
    assert (tmp_path / "h").read_text() == "T F"
    reports.json_lines(scores, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    reports.csv(scores, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["src", "dst", "betweenness"]
    reports.text(reports.community_lines(parts), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2
