"""Column builders for text: blanks, trimming, normal forms. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character Unicode or Python calls white space (Java's \s alone is ASCII).
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def trim_blanks(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def squeeze(c: Column) -> Column:
    """Outer blanks dropped, runs of inner blanks as one space."""
    return F.regexp_replace(trim_blanks(c), rf"{BLANK}+", " ")


def name_key(c: Column) -> Column:
    """Names equal up to outer blanks, case, and inner blanks or hyphens for underscores."""
    return F.lower(F.regexp_replace(trim_blanks(c), rf"[-]|{BLANK}", "_"))


def normalize(c: Column) -> Column:
    """Lower case; whatever is no letter, digit or underscore becomes one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct tokens of the normal form; empty array for empty text."""
    n = normalize(c)
    return F.when((n == "") | n.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(n, " ")))


def is_missing(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """Null or one of the spelled-out markers for nothing, in any case."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "null", "none", *extra)
