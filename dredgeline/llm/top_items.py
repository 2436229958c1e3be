"""Top N items of every group, by statistics-guided skipping over files clustered by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..operators.skew import hot_keys, salted
from ..session import scratch_path, written

ROWS = ("grp", "score", "tie")
#: What the reading of a file cost; beside the rows, in a row of its own.
COSTS = ("read", "skipped", "bytes_read", "bytes_skipped")

#: Schemes of one storage under which the reader knows it by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def write_clustered(df: DataFrame, group: str, score: str, tie: str, path: str, row_group_bytes: int = 1 << 17, shares: int = 4096, floor: int = 1_000_000) -> None:
    """Writes ``(grp, score, tie)`` clustered by group; within a file by group, then descending score, then tie.

    A group above ``floor`` rows, and above ``1 / shares`` of all, is spread over several files, so no task sorts a group of
    unbounded size. Row groups are small, so that those of a large group hold that group alone and narrow ranges of its score.
    """
    # written once: counting the groups must not compute the rows again
    narrow = written(df.select(F.col(group).alias("grp"), F.col(score).alias("score"), F.col(tie).alias("tie")).dropna(), "narrow")
    spread = salted(narrow, "grp", F.col("tie"), hot_keys(narrow, "grp", shares, floor))
    (spread.repartition("grp", "salt").sortWithinPartitions("grp", F.desc("score"), "tie").drop("salt")
     .write.option("parquet.block.size", str(row_group_bytes)).parquet(path))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a file as Spark names it."""
    scheme, _, rest = uri.partition(":")
    if "/" in scheme or not rest:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def read_best(file, n: int) -> tuple[pa.Table, dict[str, int]]:
    """The rows of one file that can be among the best ``n`` of their group, and what reading cost.

    Row groups are read in descending maximum score. One is skipped if its maximum is strictly below the current N-th score
    of every group in it. The file is sorted by group, so a group in the middle of a row group is nowhere else and has no N-th
    score before; only where a row group begins and ends with the same group are all of its groups known.
    """
    reader = pq.ParquetFile(file)
    meta, order = reader.metadata, []
    for k in range(meta.num_row_groups):
        columns = {meta.row_group(k).column(c).path_in_schema: meta.row_group(k).column(c).statistics for c in range(meta.num_columns)}
        group, score = columns["grp"], columns["score"]
        known = group is not None and group.has_min_max and score is not None and score.has_min_max
        order.append((known, score.max if known else 0, group.min if known else None, group.max if known else None, k))
    cost, best = dict.fromkeys(COSTS, 0), [reader.schema_arrow.empty_table().select(list(ROWS))]
    highest: dict = {}  # the best scores so far of groups that begin or end a row group
    for known, top, low, high, k in sorted(order, key=lambda o: (o[0], -o[1], o[4])):
        size = meta.row_group(k).total_byte_size
        scores = highest.get(low, ()) if known and low == high else ()
        if len(scores) == n and top < scores[-1]:
            cost["skipped"] += 1
            cost["bytes_skipped"] += size
            continue
        cost["read"] += 1
        cost["bytes_read"] += size
        rows = reader.read_row_group(k, columns=list(ROWS)).combine_chunks()
        group = rows["grp"].chunk(0)
        begins = np.flatnonzero(np.append(True, pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)))
        lengths = np.diff(np.append(begins, len(group)))
        place = np.arange(len(group)) - np.repeat(begins, lengths)
        best.append(rows.filter(pa.array(place < n)))
        for at in {0, len(begins) - 1}:
            seen = rows["score"].slice(begins[at], min(n, lengths[at])).to_pylist()
            name = group[begins[at]].as_py()
            highest[name] = sorted([*highest.get(name, ()), *seen], reverse=True)[:n]
    return pa.concat_tables(best), cost


def read_top(df: DataFrame, path: str, n: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, cost)``: the N best of each group in a clustered layout at ``path``, and the sums of :data:`COSTS`.

    ``df`` gives the session and the column types."""
    spark = df.sparkSession
    stored = spark.read.parquet(path)
    files = stored.inputFiles()
    costs = [F.lit(None).cast("long").alias(c) for c in COSTS]
    schema = stored.select(*ROWS, *costs).schema
    arrow = to_arrow_schema(schema)

    def best(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, name = filesystem(uri)
                with fs.open_input_file(name) as file:
                    rows, cost = read_best(file, n)
                nothing = [pa.nulls(rows.num_rows, pa.int64())] * len(COSTS)
                yield from pa.table([*(rows[c].cast(arrow.field(c).type) for c in ROWS), *nothing], schema=arrow).to_batches()
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, arrow.field(c).type) for c in ROWS), *(pa.array([cost[c]], pa.int64()) for c in COSTS)], schema=arrow)

    if files:
        listed = spark.createDataFrame([(f,) for f in files], "uri string").repartition(max(1, min(len(files), 4096)), "uri")
        partial = written(listed.mapInArrow(best, schema), "best")
    else:
        partial = spark.createDataFrame([], schema)
    # a group is spread over few files, each with N rows at most
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "tie"))
    rows = partial.where("grp is not null").select(*ROWS).withColumn("rank", rank).where(F.col("rank") <= n)
    return rows, partial.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COSTS))


def top_items(df: DataFrame, group: str, score: str, tie: str, n: int, report: bool = False, **layout: int) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``(group, score, tie, rank)``: the ``n`` rows of highest score of each group, ties to the smaller ``tie``.

    Rows with a NULL group, score or tie do not take part; repeated rows count as often as they occur, so pass distinct
    rows where they should not. A group of fewer than ``n`` rows is returned whole. ``score`` must be numeric and not NaN.
    With ``report``, also one row of how many row groups and bytes were read and skipped. ``layout``: see
    :func:`write_clustered`; the rows do not depend on it.
    """
    path = scratch_path(df.sparkSession, "clustered")
    write_clustered(df, group, score, tie, path, **layout)
    found, cost = read_top(df, path, n)
    rows = found.select(F.col("grp").alias(group), F.col("score").alias(score), F.col("tie").alias(tie), "rank")
    return (rows, cost) if report else rows
