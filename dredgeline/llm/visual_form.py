"""One consistent form of texts that look the same but differ in their characters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from string import ascii_letters

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written

#: Letters of other alphabets with the shape of a Latin letter, those of the commonest alphabets.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "г": "r", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѡ": "w", "ѵ": "v", "ү": "y", "һ": "h", "ҽ": "e", "ӏ": "i", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ꙇ": "i",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ь": "b", "Ѕ": "S", "І": "I", "Ј": "J", "Ѵ": "V", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϝ": "F", "Ϳ": "J", "Ϻ": "M",
    # Armenian
    "ա": "w", "գ": "q", "զ": "q", "հ": "h", "ո": "n", "ռ": "n", "ս": "u", "ց": "g", "ք": "f", "օ": "o", "Ս": "U", "Տ": "S", "Օ": "O",
    # Phonetic
    "ɑ": "a", "ɡ": "g", "ɣ": "y", "ɩ": "i", "ɪ": "i", "ɯ": "w", "ʋ": "u", "ʏ": "y",
}

#: Scripts, by the first word of a letter's name, whose signs are not letters of an alphabet.
NOT_ALPHABETS = ("CJK", "HANGUL", "KATAKANA", "HIRAGANA", "KANGXI", "TANGUT", "NUSHU", "KHITAN", "EGYPTIAN", "ANATOLIAN", "CUNEIFORM", "BAMUM", "VAI", "YI")

#: Compatibility decompositions that change only a letter's width or its place in a joined word.
WIDTH_OR_SHAPE = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>")

#: Format characters that are drawn.
DRAWN_FORMATS = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def _invisible(c: str) -> bool:
    """Format and control characters (but for line ends and tabs), joiners and selectors that draw nothing."""
    kind, o = unicodedata.category(c), ord(c)
    if kind == "Cf":
        return o not in DRAWN_FORMATS
    if kind == "Cc":
        return c not in "\t\n\v\f\r\x85"
    return o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or 0xE0100 <= o <= 0xE01EF


def _letters(s: str) -> bool:
    return all(unicodedata.category(c)[0] in "LM" for c in s)


def _alphabetic(c: str) -> bool:
    """A letter, written from the left, that stands for itself; of Latin only the phonetic ones."""
    if unicodedata.category(c) not in ("Lu", "Ll", "Lo") or unicodedata.decomposition(c) or unicodedata.bidirectional(c) != "L":
        return False
    script = unicodedata.name(c, "CJK").replace("-", " ").split()[0]
    return script not in NOT_ALPHABETS and (script != "LATIN" or 0x250 <= ord(c) < 0x2B0)


_alike: dict[str, str] = {}


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of other alphabets and the Latin letter of the same shape: :data:`LOOK_ALIKE`, and for all other alphabets
    those that the confusables of the Unicode standard, as the engine's own library has them, map to a single letter."""
    if not _alike:
        found: dict[str, str] = {}
        try:
            skeleton = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
            latin: dict[str, list[str]] = {}
            for letter, shape in zip(ascii_letters, skeleton("\n".join(ascii_letters)).split("\n")):
                latin.setdefault(shape, []).append(letter)
            asked = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if _alphabetic(c)]
            for c, shape in zip(asked, skeleton("\n".join(asked)).split("\n"), strict=True):
                # capital I and small l have one shape there
                if letters := latin.get(shape):
                    found[c] = letters[0 if unicodedata.category(c) == "Ll" else -1]
        except TypeError:  # a library without it: its name is then not callable
            pass
        _alike.update({**found, **LOOK_ALIKE})
    return _alike


def _expanded(c: str, alike: dict[str, str]) -> str:
    """The characters that a code point stands for, fully decomposed; "" if it is invisible."""
    if _invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    kind, _, parts = unicodedata.decomposition(c).rpartition(">")
    mapped = "".join(chr(int(p, 16)) for p in parts.split())
    if kind:
        kind += ">"
        joined = kind == "<compat>" and unicodedata.category(c)[0] == "L" and len(mapped) > 1 and _letters(mapped)
        radical = kind == "<compat>" and unicodedata.category(c) == "So" and len(mapped) == 1 and unicodedata.category(mapped) == "Lo"
        if not (kind in WIDTH_OR_SHAPE or kind == "<noBreak>" or joined or radical):
            return alike.get(c, c)
        return "".join(_expanded(m, alike) for m in mapped)
    if parts:
        return "".join(_expanded(m, alike) for m in unicodedata.normalize("NFD", c))
    return alike.get(c, c)


def form(text: str, alike: dict[str, str] = LOOK_ALIKE) -> str:
    """The consistent form of one string: what the DataFrame operator computes, for tests."""
    return unicodedata.normalize("NFC", "".join(_expanded(c, alike) for c in text))


# --- tables, all of a size that does not depend on the data ---

#: Fixed values of Hangul: first lead, vowel, trail and syllable, and how many of each.
LEAD, VOWEL, TRAIL, SYLLABLE, LEADS, VOWELS, TRAILS = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28


def _assigned() -> Iterator[str]:
    """Code points beyond ASCII that have a meaning; Hangul syllables are composed already and follow a rule."""
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        if unicodedata.category(c) not in ("Cs", "Co", "Cn") and not SYLLABLE <= o < SYLLABLE + LEADS * VOWELS * TRAILS:
            yield c


@cache
def decompositions() -> dict[str, str]:
    """What each composed code point consists of, canonically and fully, in the order of the marks' classes."""
    return {c: d for c in _assigned() if (d := unicodedata.normalize("NFD", c)) != c}


@cache
def classes() -> dict[str, int]:
    """The combining class of each mark that has one; marks of one class keep their order."""
    return {c: k for c in _assigned() if (k := unicodedata.combining(c))}


@cache
def compositions() -> dict[str, dict[str, str]]:
    """By second code point: the first ones that compose with it, and to what."""
    out: dict[str, dict[str, str]] = {}
    for c in _assigned():
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            out.setdefault(chr(int(parts[1], 16)), {})[chr(int(parts[0], 16))] = c
    for v in range(VOWELS):
        out[chr(VOWEL + v)] = {chr(LEAD + k): chr(SYLLABLE + (k * VOWELS + v) * TRAILS) for k in range(LEADS)}
    for t in range(1, TRAILS):
        out[chr(TRAIL + t)] = {chr(SYLLABLE + k * TRAILS): chr(SYLLABLE + k * TRAILS + t) for k in range(LEADS * VOWELS)}
    return out


def _joins(c: str) -> bool:
    """Whether the code point may combine with what stands before it."""
    return unicodedata.combining(c) > 0 or c in compositions()


@cache
def _mapped(alike: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, str, bool]], set[str]]:
    """Code points that do not stand for themselves alone: ``(code point, its form, whether that begins by joining)``."""
    rows, joining, letters = [], set(), dict(alike)
    for c in _assigned():
        parts = unicodedata.normalize("NFC", _expanded(c, letters))
        if parts != c:
            rows.append((c, parts, bool(parts) and _joins(parts[0])))
        if parts and _joins(parts[0]):
            joining.add(c)
    rows += [(chr(o), "", False) for o in (*range(0x09), *range(0x0E, 0x20), 0x7F)]
    return rows, joining


def mapping_rows(alike: dict[str, str]) -> tuple[list[tuple[str, str, bool]], set[str]]:
    return _mapped(tuple(sorted(alike.items())))


def _ranges(points: set[str]) -> str:
    """A regular expression class of the code points."""
    out, order = [], sorted(map(ord, points))
    start = last = None
    for o in [*order, None]:
        if start is not None and o != last + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
            start = None
        if start is None:
            start = o
        last = o
    return "".join(out)


def composed(letters: DataFrame) -> DataFrame:
    """``(part, whole)`` of the letters with their marks in ``part``: decomposed, the marks ordered by class, and recomposed.

    Decompositions and combining classes are joined code point by code point. Marks are put in order of their class between
    code points without one. Then a letter is composed with each mark in turn, unless one of the same or a higher class
    stands between and is left over.
    """
    spark = letters.sparkSession
    table = lambda rows, names: F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=names.replace(" string", "").replace(" int", "").split(", ")), names))
    points = letters.select("part").distinct().select("part", F.posexplode(F.split("part", "")).alias("pos", "ch"))
    points = points.join(table(list(decompositions().items()), "ch string, parts string"), "ch", "left").select(
        "part", "pos", F.posexplode(F.split(F.coalesce("parts", "ch"), "")).alias("sub", "ch"))
    points = points.join(table(list(classes().items()), "ch string, class int"), "ch", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    run = F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(Window.partitionBy("part").orderBy("pos", "sub"))
    ordered = points.withColumn("run", run).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("run", "class", "pos", "sub", "ch"))).alias("seq"))
    pairs = F.broadcast(spark.createDataFrame([(compositions(),)], "pairs map<string,map<string,string>>"))  # one row

    def add(acc, e):
        """``acc``: what is finished, the letter, the marks left over after it, the class of the last of these."""
        whole = F.col("pairs")[e["ch"]][acc["letter"]]
        free = (acc["marks"] == "") | ((acc["last"] > 0) & (acc["last"] < e["class"]))
        state = lambda done, letter, marks, last: F.struct(done.alias("done"), letter.alias("letter"), marks.alias("marks"), last.alias("last"))
        return F.when(whole.isNotNull() & free, state(acc["done"], whole, acc["marks"], acc["last"])).when(
            e["class"] == 0, state(F.concat(acc["done"], acc["letter"], acc["marks"]), e["ch"], F.lit(""), F.lit(0))).otherwise(
            state(acc["done"], acc["letter"], F.concat(acc["marks"], e["ch"]), e["class"]))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("letter"), F.lit("").alias("marks"), F.lit(0).alias("last"))
    whole = F.aggregate("seq", start, add, lambda acc: F.concat(acc["done"], acc["letter"], acc["marks"]))
    return ordered.crossJoin(pairs).select("part", whole.alias("whole"))


def visual_form(df: DataFrame, record: str, text: str, alike: dict[str, str] | None = None) -> DataFrame:
    """``(record, text, form)``: each text with the form that all texts of the same look share.

    Full- and half-width forms, presentation forms and letter ligatures become plain letters; letters of the same shape in
    another alphabet become Latin; every kind of space becomes a space; invisible characters go; letters with marks are
    composed, the marks in canonical order. Case, accents, digits, punctuation and line ends stay. A NULL text has a
    NULL form; a text of invisible characters only has the empty form. ``record`` must be unique; other columns are
    not read.

    Texts of code points that stand for themselves, and join nothing, are their own form. All others are taken apart into positioned code
    points, mapped by a broadcast join, and rebuilt; where marks stand apart from their letters, each letter is
    recomposed with its marks, see :func:`composed`. ``alike`` replaces the table of :func:`look_alikes`.
    """
    spark = df.sparkSession
    mapping, joining = mapping_rows(look_alikes(spark) if alike is None else alike)
    joined = r"[\p{M}" + _ranges({c for c in joining if unicodedata.category(c)[0] != "M"}) + "]"
    rows = df.select(F.col(record).alias("record"), F.col(text).alias("text"))
    # a text without any of these some 4,000 code points is in its form already; translate looks each code point up in
    # one table, which a character class of hundreds of ranges does not
    kept = F.translate("text", "".join(sorted({r[0] for r in mapping} | joining)).replace("\0", ""), "")
    touched = F.coalesce((F.col("text") != kept) | F.contains("text", F.lit("\0")), F.lit(False))
    plain = rows.where(~touched).select("record", "text", F.col("text").alias("form"))
    # written once, as several branches read it; shuffled as texts, and code points then stay where they are
    apart = written(rows.where(touched).withColumn("marked", F.col("text").rlike(joined)), "touched").repartition("record")
    table = F.broadcast(spark.createDataFrame(pd.DataFrame(mapping, columns=["ch", "parts", "joins"]), "ch string, parts string, joins boolean"))

    points = apart.select("record", "marked", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    mapped = points.join(table, "ch", "left").select(
        "record", "marked", "pos", F.coalesce("parts", "ch").alias("part"), F.coalesce("joins", F.col("ch").rlike(joined)).alias("joins")).where("part != ''")
    simple = mapped.where(~F.col("marked")).select("record", "pos", "part")

    order = Window.partitionBy("record").orderBy("pos")
    lettered = mapped.where("marked").withColumn("letter", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    letters = lettered.groupBy("record", "letter").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    letters = letters.select("record", "pos", F.array_join("parts.part", "").alias("part"), (F.size("parts") > 1).alias("several"))
    # each distinct letter with marks is composed once
    several = letters.where("several").select("part").distinct()
    whole = letters.join(composed(several), "part", "left").select("record", "pos", F.coalesce("whole", "part").alias("part"))
    rebuilt = lambda parts: parts.groupBy("record").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "part"))).getField("part"), "").alias("form"))
    done = plain
    for part, built in ((~F.col("marked"), simple), (F.col("marked"), whole)):
        done = done.unionByName(apart.where(part).join(rebuilt(built), "record", "left").select("record", "text", F.coalesce("form", F.lit("")).alias("form")))
    return done.select(F.col("record").alias(record), F.col("text").alias(text), "form")


def same_look(forms: DataFrame, record: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)`` of texts that differ but share their form.

    ``members(record, text_key)`` names each record's text by its digest; ``pairs(key_a, key_b)`` has each pair of
    different texts of one form once. Copies of a text are one member group, so no pairs are made among them. Blank
    and NULL texts take no part.
    """
    seen = forms.where(F.col("form").rlike(r"[^\s\p{Z}\p{C}]")).select(F.col(record).alias("record"), F.md5(text).alias("text_key"), F.md5("form").alias("form_key"))
    seen = written(seen, "forms")  # read several times
    texts = seen.select("form_key", "text_key").distinct()
    several = texts.groupBy("form_key").count().where(F.col("count") > 1).select("form_key")
    able = texts.join(several, "form_key", "left_semi")
    pairs = able.select("form_key", F.col("text_key").alias("key_a")).join(able.select("form_key", F.col("text_key").alias("key_b")), "form_key").where(F.col("key_a") < F.col("key_b"))
    return pairs.select("key_a", "key_b"), seen.select("record", "text_key")
