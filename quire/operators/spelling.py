"""Words that one edit makes of each other, found by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.intermediate import written

#: Characters from which on a word is looked up by its halves, two keys of its own length, instead of by all its deletions.
LONG = 24


def _deletions(word: Column) -> Column:
    """The word and what is left of it without one character."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), without))


def _halves(word: Column, length: Column) -> Column:
    """Keys under which a word would be the same as one of ``length`` that it is an edit away from: if the edit is in one half, the
    other half is at the word's other end."""
    head = (length / 2).cast("int")
    tail = length - head
    return F.array(F.struct(length.alias("n"), F.lit(0).alias("half"), F.substr(word, F.lit(1), head).alias("part")), F.struct(length.alias("n"), F.lit(1).alias("half"), F.substr(word, F.length(word) - tail + 1, tail).alias("part")))


def one_edit_apart(words: DataFrame, long: int = LONG) -> DataFrame:
    """a < b: all pairs of different words (column ``word``) that one insertion, deletion or change of a character turns into each other.

    Words of up to ``long`` characters meet where they share a deletion (or one is the other's). A longer word is met under its halves by
    words of its length and of one more, so a key never costs more than the word. Every pair is verified. Nulls and repeated words are left
    out; the empty word is an edit away from words of one character.
    """
    distinct = written(words.select("word").where("word is not null").distinct(), "words")
    n = F.length("word")
    short = written(distinct.where(n <= long).select("word", F.explode(_deletions(F.col("word"))).alias("key")), "deletions")
    by_deletion = short.select("key", F.col("word").alias("a")).join(short.select("key", F.col("word").alias("b")), "key")
    lengthy = distinct.where(n >= long)
    indexed = lengthy.select(F.col("word").alias("a"), F.explode(_halves(F.col("word"), n)).alias("key"))
    asking = lengthy.select(F.col("word").alias("b"), F.explode(F.concat(_halves(F.col("word"), n), _halves(F.col("word"), n - 1))).alias("key"))
    by_half = indexed.join(asking, "key")
    met = by_deletion.select("a", "b").unionByName(by_half.select("a", "b")).where(F.col("a") != F.col("b"))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where((F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1))
