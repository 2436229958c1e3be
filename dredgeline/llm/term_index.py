"""Occurrences and document frequency of every term, from a vertical index of compressed record bitmaps."""

from __future__ import annotations

import re
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records in a chunk; the low 16 bits of a record number. A container of SPARSE or more members is a bit set.
CHUNK, SPARSE = 1 << 16, 4096

INDEX_SCHEMA = "term string, chunk long, occurrences long, container binary"

_TERM = re.compile(r"[^\W_]+")


def pack(members: np.ndarray) -> bytes:
    """Sorted distinct numbers below 65,536 as 16-bit numbers, or as 8,192 bytes of bits where that is shorter."""
    if len(members) < SPARSE:
        return np.asarray(members, "<u2").tobytes()
    bits = np.zeros(CHUNK, bool)
    bits[members] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """The members of a container: bits if it has 8,192 bytes, else numbers."""
    if len(container) == 2 * SPARSE:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little")).astype("<u2")
    return np.frombuffer(container, "<u2")


def union(containers: list[bytes]) -> bytes:
    """The union of containers of one chunk."""
    if len(containers) == 1:
        return containers[0]
    return pack(np.unique(np.concatenate([unpack(c) for c in containers])))


def _rows(postings: dict[str, array], occurrences: dict[str, int], chunk: int) -> pa.RecordBatch:
    names = list(postings)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([chunk] * len(names), pa.int64()), pa.array([occurrences[t] for t in names], pa.int64()),
         pa.array([pack(np.frombuffer(postings[t], np.uint16)) for t in names], pa.binary())],
        names=["term", "chunk", "occurrences", "container"])


def term_index(records: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """``(term, chunk, occurrences, container)``: for each term, the records holding it, 65,536 records to a chunk.

    ``column`` is text, of which the terms are maximal runs of letters or digits of its lower case (or matches of
    ``pattern``), or an array of values, each one a term. Every task numbers its own records, in chunks of its own, and
    combines them before anything is shuffled; it holds one chunk's terms at a time. NULL records and NULL values hold
    no term.
    """
    is_text = dict(records.dtypes)[column] == "string"
    find = re.compile(pattern).findall if pattern else _TERM.findall

    def build(batches):
        chunk, low = TaskContext.get().partitionId() << 32, 0
        postings: dict[str, array] = defaultdict(lambda: array("H"))  # two bytes a posting
        occurrences: dict[str, int] = defaultdict(int)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value is None:
                    continue
                terms = find(value.lower()) if is_text else [v for v in value if v is not None]
                for t in terms:
                    occurrences[t] += 1
                for t in set(terms):
                    postings[t].append(low)
                low += 1
                if low == CHUNK:
                    yield _rows(postings, occurrences, chunk)
                    postings.clear()
                    occurrences.clear()
                    chunk, low = chunk + 1, 0
        if postings:
            yield _rows(postings, occurrences, chunk)

    values = F.col(column) if is_text else F.col(column).cast("array<string>")
    return records.select(values.alias("value")).mapInArrow(build, INDEX_SCHEMA)


def merged(*indexes: DataFrame) -> DataFrame:
    """Indexes of separate record sets, or of overlapping ones under the same record numbers, as one by union.

    Containers of a term are united chunk by chunk, so no group is larger than the number of indexes.
    """
    both = indexes[0]
    for other in indexes[1:]:
        both = both.unionByName(other)

    @F.pandas_udf("binary")
    def unite(parts):
        return parts.map(lambda p: union(list(p)))

    grouped = both.groupBy("term", "chunk").agg(F.sum("occurrences").alias("occurrences"), F.collect_list("container").alias("parts"))
    return grouped.select("term", "chunk", "occurrences", unite("parts").alias("container"))


def _cardinality():
    """Members of a container: from its length, or by counting bits where it is a bit set (one page of 8,192 bytes)."""

    @F.pandas_udf("long")
    def count(container):
        return container.map(lambda c: len(unpack(c)) if len(c) == 2 * SPARSE else len(c) // 2)

    return count(F.col("container"))


def term_frequencies(index: DataFrame) -> DataFrame:
    """``(term, occurrences, records)``: the document frequency is the sum of the cardinalities over the chunks."""
    return index.select("term", "occurrences", _cardinality().alias("held")).groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("held").alias("records"))


def marked_terms(records: DataFrame, column: str, rare_below: int = 3, common_above: float = 0.3, pattern: str | None = None) -> DataFrame:
    """``(term, occurrences, records, mark)`` for every term of the collection.

    ``mark`` is ``rare`` below ``rare_below`` records, ``common`` above the share ``common_above`` of the non-null
    records, else NULL. A term that is both is ``rare``. An empty collection gives no rows.
    """
    total = records.agg(F.count(column).alias("_total"))  # one row
    frequency = term_frequencies(term_index(records, column, pattern)).crossJoin(F.broadcast(total))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("_total"), "common")
    return frequency.withColumn("mark", mark).drop("_total")
