"""Several values packed in one field: parses chosen by minimum description length."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Opening quotes and the quotes that close them, fixed values.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»"}

DELIMITERS = ",;|/\t\n"

#: Bits for one character of a value that the code does not know.
CHARACTER_BITS = 8.0


def parse(field: str, delimiters: str, quoted: bool) -> list[str]:
    """The values of a field under a dialect, in written order.

    Any character of ``delimiters`` separates. With ``quoted``, a quote that begins a value holds separators until it is
    closed, a doubled closing quote being one quote, and brackets around the whole field are dropped. Values are
    trimmed, inside quotes too; empty ones are left out.
    """
    text = field.strip()
    if quoted and len(text) > 1 and text[0] + text[-1] in ("[]", "{}", "()"):
        text = text[1:-1]
    out, at, n = [], 0, len(text)
    while at <= n:
        while at < n and text[at].isspace() and text[at] not in delimiters:
            at += 1
        close = QUOTES.get(text[at]) if quoted and at < n else None
        end, value = at + 1, []
        if close:
            while end < n:
                if text[end] == close:
                    if text[end + 1:end + 2] != close:
                        break
                    end += 1
                value.append(text[end])
                end += 1
            rest = end + 1
            while rest < n and text[rest].isspace() and text[rest] not in delimiters:
                rest += 1
            if end < n and (rest >= n or text[rest] in delimiters):
                out.append("".join(value).strip())
                at = rest + 1
                continue
        # no quotes, or quotes that do not enclose the value: they are part of it
        end = at
        while end < n and text[end] not in delimiters:
            end += 1
        out.append(text[at:end].strip())
        at = end + 1
    return [v for v in out if v]


def dialects(field: str, delimiters: str = DELIMITERS) -> list[tuple[str, bool]]:
    """Every dialect that can matter to a field: subsets of the delimiters it has, most first, with and without quotes."""
    present = [d for d in delimiters if d in field]
    marked = any(q in field for q in QUOTES) or field.strip()[:1] in ("[", "{", "(")
    sets = ["".join(s) for k in range(len(present), -1, -1) for s in itertools.combinations(present, k)]
    return [(s, q) for q in ((True, False) if marked else (True,)) for s in sets]


def _readings(fields: DataFrame, delimiters: str) -> DataFrame:
    """``(field, weight, several, choice, used, values)``: the different parses of each field. ``choice`` 0 splits at every
    delimiter; ``several`` says whether there are others."""

    def read(batches):
        for t in batches:
            rows = []
            for field, weight in zip(t["field"], t["weight"]):
                found = {}
                for choice, (used, quoted) in enumerate(dialects(field, delimiters)):
                    values = parse(field, used, quoted)
                    if not (values or choice):
                        break  # nothing but delimiters and markup
                    if values:
                        found.setdefault(tuple(values), (choice, len(used) + (not quoted), values))
                rows += [(field, weight, len(found) > 1, *r) for r in found.values()]
            yield pd.DataFrame(rows, columns=["field", "weight", "several", "choice", "used", "values"])

    return fields.mapInPandas(read, "field string, weight long, several boolean, choice int, used int, values array<string>")


def unpacked(df: DataFrame, key: str, packed: str, delimiters: str = DELIMITERS, rounds: int = 1) -> DataFrame:
    """``(key, pos, value)``: the values packed in ``packed``, one to a row, numbered from 1 in written order.

    Each field is read in every dialect that could matter (which of the delimiters it has separate, whether quotes and
    brackets are markup), and in the end in the one with the shortest description: the bits of its values under a code
    shared by all fields, and of the dialect. The code gives a value ``-log2`` of its share of the values of all fields
    as read so far (at first split at every delimiter outside quotes), and spells an unknown value out.

    Rows equal in key and field count once. NULL, blank or valueless fields give no rows; NULL keys are kept. A field of
    any length is one value at least; the number of readings is bounded by the delimiters, not by the field.
    """
    rows = df.select(F.col(key).alias("key"), F.col(packed).alias("field")).where(F.col("field").isNotNull()).distinct()
    # a number that is not adapted: fields are short, but there is much work for each
    fields = rows.groupBy("field").agg(F.count("*").alias("weight")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "field")
    readings = written(_readings(fields, delimiters), "readings")
    chosen = readings.where(F.col("choice") == 0)
    for _ in range(rounds):
        chosen = _cheapest(readings, _code(chosen))
    return rows.join(chosen, "field").select(F.col("key").alias(key), F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def _code(chosen: DataFrame) -> DataFrame:
    """``(value, bits)``; the row of the NULL value has the bits of the sign that a value is spelled out."""
    counts = chosen.select("weight", F.explode("values").alias("value")).groupBy("value").agg(F.sum("weight").alias("n"))
    total = counts.agg((F.sum("n") + F.count("*") + 1).alias("all"))  # one row
    known = counts.crossJoin(F.broadcast(total)).select("value", F.log2(F.col("all") / F.col("n")).alias("bits"))
    return known.unionByName(total.select(F.lit(None).cast("string").alias("value"), F.log2("all").alias("bits")))


def _cheapest(readings: DataFrame, code: DataFrame) -> DataFrame:
    """The reading of fewest bits of each field; of equal ones the first in the order of :func:`dialects`.

    Fields with one reading need no bits and are not joined with the code.
    """
    several, single = readings.where("several"), readings.where("not several").select("field", "weight", "values")
    escape = code.where(F.col("value").isNull()).select(F.col("bits").alias("escape"))
    parts = several.select("field", "choice", "used", F.explode("values").alias("value"))
    spelled = F.col("escape") + F.length("value") * CHARACTER_BITS
    cost = parts.join(code.where(F.col("value").isNotNull()), "value", "left").crossJoin(F.broadcast(escape)).groupBy("field", "choice", "used").agg(
        F.sum(F.coalesce("bits", spelled)).alias("bits"))
    best = cost.groupBy("field").agg(F.min(F.struct(F.round(F.col("bits") + F.col("used"), 6).alias("bits"), "choice")).alias("b")).select("field", F.col("b.choice").alias("choice"))
    return several.join(best, ["field", "choice"]).select("field", "weight", "values").unionByName(single)
