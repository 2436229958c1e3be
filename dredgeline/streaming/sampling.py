"""Reservoir sampling and trending tags over a stream of tagged messages."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketches import trending_tags, well_tagged
from ..sources.reports import append_batch

STATE = "seen long, draws long, kept array<array<string>>"
OUTPUT = "shard int, seen long, tags array<string>"


def _accepted(tags) -> bool:
    return tags is not None and len(tags) > 0 and all(t is not None and t.isalnum() for t in tags)


def keep(kept: list, seen: int, new: list, capacity: int, draw: random.Random) -> int:
    """Algorithm R: ``kept`` stays a uniform sample of all that was seen. Returns how many were seen."""
    for one in new:
        seen += 1
        if len(kept) < capacity:
            kept.append(one)
        elif (at := draw.randrange(seen)) < capacity:
            kept[at] = one
    return seen


def reservoir_stream(messages: DataFrame, tags: str, capacity: int = 100, shards: int = 1, seed: int = 0, spread: str | None = None) -> DataFrame:
    """``(shard, seen, tags)`` in update mode: after each batch, the sample of the tag lists seen so far by each shard.

    Only messages with tags, all of letters and digits, are taken. The state is bounded by ``capacity``. One shard is one
    task a batch; a fast stream wants several, over which messages are spread by the column ``spread`` (an id or a time of
    the message; without one, by their tags), each with a uniform sample of its own messages, and :func:`merge_shards`
    makes one sample of the latest of each.
    """
    rows = messages.select(F.col(tags).alias("tags"), F.pmod(F.xxhash64(spread or F.to_json(F.struct(tags))), F.lit(shards)).cast("int").alias("shard"))

    def update(key, batches, state):
        seen, draws, kept = state.get if state.exists else (0, 0, [])
        kept = [list(t) for t in kept]
        draw = random.Random(f"{seed}:{key[0]}:{draws}")
        for t in batches:
            seen = keep(kept, seen, [list(x) for x in t["tags"] if _accepted(x)], capacity, draw)
        state.update((seen, draws + 1, kept))
        if kept:
            yield pd.DataFrame({"shard": [key[0]] * len(kept), "seen": [seen] * len(kept), "tags": kept})

    return rows.groupBy("shard").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")


def merge_shards(shards: dict[int, tuple[int, list]], capacity: int = 100, draw: random.Random | None = None) -> list:
    """A uniform sample of everything seen, from the uniform samples of several shards: ``{shard: (seen, kept)}``.

    Each place goes to a shard in proportion to what it has seen and not yet given, so every set is equally likely.
    """
    draw = draw or random.Random(0)
    left = {k: seen for k, (seen, _) in shards.items()}
    kept = {k: draw.sample(list(rows), len(rows)) for k, (_, rows) in shards.items()}
    out: list = []
    while len(out) < capacity and (total := sum(left.values())):
        at = draw.randrange(total)
        for k, n in left.items():
            if at < n:
                break
            at -= n
        if not kept[k]:
            raise ValueError("a shard's sample is smaller than the capacity asked for")
        out.append(kept[k].pop())
        left[k] -= 1
    return out


def report_trending(sampled: DataFrame, path: str, checkpoint: str, top: int = 3, capacity: int = 100, once: bool = True) -> StreamingQuery:
    """After each batch adds the number of messages so far and the trending tags of the sample to a report.

    A batch brings the samples of the shards that it has changed; the latest of each (bounded by shards and capacity) is kept
    beside the report, and all of them are merged into one sample. There is nothing to report before ``capacity``
    messages have been seen. A batch that is replayed after a failure is reported once.
    """

    def report(batch: DataFrame, number: int) -> None:
        changed: dict[str, list] = {}
        for r in batch.collect():
            changed.setdefault(str(r.shard), [r.seen, []])[1].append(list(r.tags))

        def make(before: dict) -> tuple[list[tuple], dict]:
            after = {**before, **changed}
            seen = sum(n for n, _ in after.values())
            if not changed or seen < capacity:
                return [], after
            sample = merge_shards({k: (n, kept) for k, (n, kept) in sorted(after.items())}, capacity, random.Random(number))
            found = trending_tags(batch.sparkSession.createDataFrame([(t,) for t in sample], "tags array<string>"), "tags", top)
            return [(seen, r.tag, r.n) for r in found.orderBy(F.desc("n"), "tag").collect()], after

        append_batch(path, number, ["seen", "tag", "n"], make)

    writer = sampled.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(report)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_count(messages: DataFrame, tags: str) -> DataFrame:
    """``(n)`` of accepted messages since the start, for complete or update mode."""
    return messages.where(well_tagged(tags)).agg(F.count("*").alias("n"))
