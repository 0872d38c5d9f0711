"""Words, lines, n-grams and shingles of a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def words(text: Column) -> Column:
    """Runs of letters of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))


def char_ngrams(text: Column, n: int) -> Column:
    """All substrings of n characters; none where the text is shorter. Each is looked at from where the last began: a substring by its
    place would be counted out from the text's begin."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)), F.array().cast("array<string>"))


def shingles(word_array: Column, n: int) -> Column:
    """All runs of n words, joined by spaces; none where there are fewer words. The words should be a column of their own: an expression
    would be worked out again for every run."""
    starts = F.sequence(F.lit(1), F.size(word_array) - (n - 1))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(word_array, i, n), " "))
    return F.when(F.size(word_array) >= n, joined).otherwise(F.array().cast("array<string>"))


def delimiter_rows(text: Column, delimiter: str = "|", least: int = 2) -> Column:
    """The lines that hold the delimiter at least ``least`` times, in order."""
    return F.filter(lines(text), lambda x: F.size(F.split(x, F.lit(f"\\Q{delimiter}\\E"))) > least)
