"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A maximal run of letters or digits.
WORD = r"[\p{L}\p{N}]+"
#: Characters removed from a token, fixed values: the basic and the extended set.
PUNCTUATION = ".,!?;:)](["
PUNCTUATION_EXTENDED = PUNCTUATION + '"#$'


def words(text: Column) -> Column:
    """The words of the lower-cased text: maximal runs of letters or digits. NULL stays NULL."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """How many words; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(WORD)), F.lit(0))


def has_word(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def tokens(text: Column, also: str = "") -> Column:
    """Lower-cased tokens between white space, or any of the characters ``also``."""
    return F.split(F.lower(text), rf"[{also} \t\n\r\f]+")


def cleaned(token: Column, punctuation: str) -> Column:
    """The token without any of the characters of ``punctuation``."""
    return F.translate(token, punctuation, "")


def key(column: Column) -> Column:
    """An id for comparison: trimmed, the empty string as NULL."""
    return F.nullif(F.trim(column), F.lit(""))
