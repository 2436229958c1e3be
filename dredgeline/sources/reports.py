"""Report writers. Those of one file take small results; the others write in parallel."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_object(path: str, **parts) -> None:
    """One JSON object of named values; a DataFrame becomes the list of its rows, so it must be small."""
    value = {k: [list(r) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    with open(path, "w") as out:
        json.dump(value, out, ensure_ascii=False, default=str)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _quoted(items: str):
    inner = F.array_join(F.transform(F.col(items), lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", ")
    return F.concat(F.lit("("), inner, F.lit(")"))


def itemset_lines(sets: DataFrame) -> DataFrame:
    """``(size, line)``: for each size, its sets in order, ``('x')`` for single items, separated by commas."""
    rows = sets.select(F.size("items").alias("size"), "items", _quoted("items").alias("text"))
    grouped = rows.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("items", "text"))).alias("all"))
    return grouped.select("size", F.array_join("all.text", ",").alias("line")).orderBy("size")


def itemset_report(path: str, candidates: DataFrame, frequent: DataFrame) -> None:
    """``Candidates:`` and ``Frequent Itemsets:``, a line for each size and an empty line after it."""
    with open(path, "w") as out:
        for title, sets in (("Candidates:", candidates), ("Frequent Itemsets:", frequent)):
            out.write(title + "\n")
            for row in itemset_lines(sets).toLocalIterator():
                out.write(row.line + "\n\n")


def community_lines(communities: DataFrame) -> DataFrame:
    """``(line)``: the members of each community in order, small communities first, then by their members."""
    grouped = communities.groupBy("community").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("members"))
    line = F.array_join(F.transform("members", lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", ")
    return grouped.orderBy(F.size("members"), "members").select(line.alias("line"))


def betweenness_lines(scores: DataFrame) -> DataFrame:
    """``(line)``: ``('a', 'b'), score``, highest first, then by the ends. Scores are written without an exponent."""
    plain = F.regexp_replace(F.col("betweenness").cast("decimal(38,9)").cast("string"), r"(\.\d+?)0+$", "$1")
    score = F.when(F.col("betweenness") < 10_000_000, F.col("betweenness").cast("string")).otherwise(plain)
    line = F.concat(F.lit("('"), F.col("src").cast("string"), F.lit("', '"), F.col("dst").cast("string"), F.lit("'), "), score)
    return scores.orderBy(F.desc("betweenness"), "src", "dst").select(line.alias("line"))


def text(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def tagged(parts: dict[str, DataFrame], path: str) -> None:
    """Rows of several kinds as JSON lines in one place, told apart by their field ``type``."""
    whole = None
    for kind, df in parts.items():
        rows = df.withColumn("type", F.lit(kind))
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    json_lines(whole, path)


def hits_row(path: str, hits: Iterable[bool]) -> None:
    """One line of T and F, separated by spaces; ``hits`` may come one by one."""
    with open(path, "w") as out:
        for k, h in enumerate(hits):
            out.write((" " if k else "") + ("T" if h else "F"))


def append_batch(path: str, batch: int, header: list[str], make: Callable[[dict], tuple[list[tuple], dict]]) -> None:
    """Adds the rows of a batch to a CSV file, once even if the batch comes again; the header comes first.

    ``make`` gives the rows and the new state from the state before the batch (small, as JSON). A file beside the report notes
    the state and the length of the report before the last batch, so a batch that is replayed takes the place of itself,
    and an older one changes nothing.
    """
    beside = f"{path}.state"
    note = {"batch": -1, "length": 0, "before": {}, "after": {}}
    if os.path.exists(beside):
        with open(beside) as held:
            note = json.load(held)
    if batch < note["batch"]:
        return
    if batch > note["batch"]:
        note = {"batch": batch, "length": os.path.getsize(path) if os.path.exists(path) else 0, "before": note["after"], "after": note["after"]}
    rows, note["after"] = make(note["before"])
    with open(f"{beside}.new", "w") as out:
        json.dump(note, out)
    os.replace(f"{beside}.new", beside)
    with open(path, "a") as out:
        out.truncate(note["length"])
        out.seek(note["length"])
        if not note["length"]:
            out.write(",".join(header) + "\n")
        out.writelines(",".join(map(str, r)) + "\n" for r in rows)
