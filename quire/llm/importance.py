"""Importance resampling towards a target's distribution of hashed word features, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ascii_lower
from .frames import written

#: Buckets of features, words of a feature, words of a document that may be drawn, and of a hundred of these those that are.
BUCKETS, WORDS, LEAST_WORDS, PERCENT = 10_000, 1, 20, 10
SEED = 2024
#: Runs of digits, letters and all that is not ASCII; the case of A-Z is folded word by word.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))
    return F.transform(found, lambda w: ascii_lower(w))


def buckets_of(words: Column, most: int = WORDS, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to ``most`` words. ``words`` is a column of its own, not an expression."""
    hashed = lambda feature: (F.crc32(feature) % buckets).cast("int")

    def runs(k: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: i <= F.size(words) - (k - 1))
        return F.transform(starts, lambda i: hashed(F.array_join(F.slice(words, i, k), " ")))

    return F.concat(F.transform(words, hashed), *[runs(k) for k in range(2, most + 1)])


def bucketed(texts: DataFrame, most: int, buckets: int, *others: Column) -> DataFrame:
    """n_words, buckets and ``others`` of every text."""
    found = texts.select(*others, words_of(F.col("text")).alias("words"))
    return found.select(*[F.col(f"`{n}`") for n in found.columns if n != "words"], F.size("words").cast("long").alias("n_words"), buckets_of(F.col("words"), most, buckets).alias("buckets"))


def _totals(found: DataFrame) -> dict[int, int]:
    """Features in each bucket; a task gives a row for each bucket at most, and so does all."""
    return dict(found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toLocalIterator())


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """What a feature of each bucket says for the target, in thousandths of a nat; one feature is added to each bucket."""
    s_all, t_all = sum(source.values()), sum(target.values())
    each = lambda b: math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s_all + buckets) / ((source.get(b, 0) + 1.0) * (t_all + buckets))))
    return [each(b) for b in range(buckets)]


def _literal(values: list[int], kind: str = "int") -> Column:
    """One array literal, which Spark makes of the text when it plans."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def weight_of(buckets: Column, gain: list[int]) -> Column:
    """The floored mean of the gains of a text's features; 0 where there are none."""
    table = _literal(gain)
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(table, b + 1))
    n = F.size(buckets).cast("long")
    return F.when(n == 0, F.lit(0)).otherwise((total - F.pmod(total, n)) / n).cast("long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that the seed and the id fix, in thousandths, floored; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.ln(-F.ln(share)))


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` with rank: 1, 2, 3 and on for the share of the rows marked ``drawable`` that is drawn, null for others.

    Rows are dealt by range and numbered where they lie, so none of them meet in one task; what comes to the driver is the
    number of rows of each partition, which becomes a literal again.
    """
    order = [F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = written(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("at", 33).cast("int")
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("drawable").cast("long")).alias("drawable")).collect()
    before = [0] * (1 + max((r["part"] for r in counts), default=0))
    for r in sorted(counts):
        before[r["part"] + 1 :] = [r["n"] + before[r["part"]]] * (len(before) - r["part"] - 1)
    drawn = sum(r["drawable"] for r in counts) * percent // 100
    place = F.element_at(_literal(before, "bigint"), part + 1) + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("rank", F.when(F.col("drawable") & (place <= drawn), place))


def resample(docs: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: which ``percent`` of those with ``least_words`` words are drawn.

    Features are runs of 1 to ``most`` words of whole texts, hashed to buckets. Each text becomes an array of buckets once;
    only counts of buckets are summed over texts, and a text is scored where it lies, by looking its buckets up in an array of gains.
    A score is the text's weight with Gumbel noise that the seed and doc_id fix; the highest scores are drawn, of equal ones the smaller id.

    A null or empty text has no feature and weight 0; a null id comes after all others of its score; repeated rows are each scored and ranked; an
    empty table of documents gives no rows; an empty target has counts of 0; columns other than doc_id and text are ignored. A text of any length
    is one array.
    """
    found = written(bucketed(docs.select(F.col("doc_id").cast("long"), "text"), most, buckets, F.col("doc_id")), "buckets")
    gain = gains(_totals(found), _totals(bucketed(target, most, buckets)), buckets)
    scored = found.select("doc_id", F.size("buckets").cast("long").alias("n_features"), weight_of(F.col("buckets"), gain).alias("weight"), (F.col("n_words") >= least_words).alias("drawable"))
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return _ranked(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")
