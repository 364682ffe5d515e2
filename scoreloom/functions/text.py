"""Whitespace, word and character-run functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a Python string counts as whitespace, as a Java character class.
SPACE = r"[\s\x1c-\x1f]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    parts = F.split(_col(text), f"(?U){SPACE}+")
    return F.filter(parts, lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def strip(text) -> Column:
    return F.regexp_replace(_col(text), rf"(?U)^{SPACE}+|(?<!{SPACE}){SPACE}++\z", "")


def reduce_whitespace(text, replacement: str = "\n\n", at_least: int = 10) -> Column:
    """Strip, then replace long runs of whitespace."""
    return F.regexp_replace(strip(text), rf"(?U){SPACE}{{{at_least},}}", replacement)


def longest_char_run(text) -> Column:
    """The longest run of one character; the first of equals; '' for an empty text."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.aggregate(
        runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best)
    )


def collapse_runs(text, min_length: int = 10) -> Column:
    """Shorten every run of at least ``min_length`` equal characters to two."""
    if min_length < 3:
        raise ValueError("min_length must be at least 3")
    return F.regexp_replace(_col(text), rf"(?s)(.)\1{{{min_length - 1},}}", "$1$1")


def cut_before_last(text: Column, value: Column) -> Column:
    """Text up to the rightmost occurrence of a value; unchanged when there is none."""
    from_end = F.position(F.reverse(value), F.reverse(text))
    kept = F.substring(
        text, F.lit(1), F.length(text) - from_end - F.length(value) + F.lit(1)
    )
    return F.when((value == "") | (from_end == 0), text).otherwise(kept)
