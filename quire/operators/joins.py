"""Joins that Spark has no operator for, as equi-joins of bounded fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _hours(time: Column, kind: str) -> Column:
    """Whole hours of a date or time, in the order of the times whatever the session's zone."""
    if kind == "timestamp":
        return F.floor(F.unix_seconds(time) / 3600)
    local = time.cast("timestamp_ntz")
    return F.unix_date(local.cast("date")).cast("long") * 24 + F.hour(local)


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], hours: int = 24) -> DataFrame:
    """Each left row with the latest right row of its key that isn't later; nulls where there is none.

    Both sides are merged and cut by key and spans of ``hours``. In a span the last right row is carried forward;
    what a span begins with is the last of the spans before it, of which there is a row each. So no pair of rows is
    made and a busy key is spread over its spans. ``columns`` of the right side are added. Of equal times the
    right row counts as before; of right rows of one time, one counts, the same in every run. Rows
    with a null key or time meet none.
    """
    usable = lambda time: F.col(key).isNotNull() & F.col(time).isNotNull()
    at = lambda df, time: (F.floor(_hours(F.col(time), dict(df.dtypes)[time]) / hours).alias("_span"), F.col(time).alias("_time"))
    of = F.struct(*columns)
    rights = right.where(usable(right_time)).select(F.col(key).alias("_key"), *at(right, right_time), F.lit(0).alias("_side"), F.xxhash64(of).alias("_tie"), of.alias("_right"))
    lefts = left.where(usable(left_time)).select(F.col(key).alias("_key"), *at(left, left_time), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    merged = lefts.unionByName(rights, allowMissingColumns=True)
    within_span = Window.partitionBy("_key", "_span").orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumn("_seen", F.last("_right", ignorenulls=True).over(within_span)).where("_side = 1")
    ends = merged.groupBy("_key", "_span").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_time", "_tie"))).alias("_end"))
    spans_before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("_key", "_span", F.last("_end", ignorenulls=True).over(spans_before).alias("_begin"))
    met = seen.join(begins.where("_begin is not null"), ["_key", "_span"], "left").withColumn("_met", F.coalesce("_seen", "_begin"))
    kinds = dict(right.dtypes)
    alone = left.where(~usable(left_time)).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    return met.select("_left.*", *[F.col(f"_met.{c}").alias(c) for c in columns]).union(alone)


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key whose right time follows the left time within ``seconds`` (inclusive).

    Time is cut in buckets of that length; a right row within reach is in the left row's bucket or the
    next, so the join is on key and bucket and a busy key is spread over its buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    lefts = left.withColumn("_b", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    rights = right.withColumn("_b", bucket(right_time))
    step = F.expr(f"interval {seconds} seconds")
    met = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + step)
    return lefts.join(rights, [key, "_b"]).where(met).drop("_b")
