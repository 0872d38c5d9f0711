"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.intermediate import written


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], neighbours: bool = False) -> DataFrame:
    """``key`` and a double for each name of ``shares``: the value at that share of the group's order, interpolated
    between neighbours. Null values don't count, a group without others has no row, and null is a key like any other.
    With ``neighbours`` also ``<name>_below`` and ``<name>_above``: the values of the group that it lies between.

    Equal values are counted first; the counts are dealt by ranges of key and value, so that a group lies in as many
    tasks as it needs. The ranges' totals say which of them hold a wanted rank, and only those are ordered within.
    """
    rows = df.select(F.col(key), F.col(value).cast("double").alias("_v")).where("_v is not null")
    counts = rows.groupBy(key, "_v").agg(F.count("*").alias("_n"))
    ranged = written(counts.repartitionByRange(key, "_v").withColumn("_part", F.spark_partition_id()), "counts")
    parts = ranged.groupBy(key, "_part").agg(F.sum("_n").alias("_size"))
    of_key = Window.partitionBy(key)
    ahead = F.sum("_size").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(ahead, F.lit(0)).alias("_ahead"), "_size", F.sum("_size").over(of_key).alias("_total"))
    place = {name: F.lit(float(share)) * (F.col("_total") - 1) for name, share in shares.items()}
    ends = {name: (F.floor(p), F.ceil(p)) for name, p in place.items()}
    holds = lambda low, high: reduce(or_, [(e >= low) & (e < high) for pair in ends.values() for e in pair])
    wanted = parts.where(holds(F.col("_ahead"), F.col("_ahead") + F.col("_size")))
    found = ranged.join(wanted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    upto = F.col("_ahead") + F.sum("_n").over(Window.partitionBy(key, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = found.select(key, "_v", "_total", (upto - F.col("_n")).alias("_from"), upto.alias("_to"))
    at = lambda e: F.max(F.when((e >= F.col("_from")) & (e < F.col("_to")), F.col("_v")))
    picked = ranked.groupBy(key, "_total").agg(*[at(e).alias(f"_{side}_{name}") for name, pair in ends.items() for side, e in zip(("low", "high"), pair, strict=True)])

    def between(name: str):
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(low == high, low).otherwise(low + (high - low) * (place[name] - F.floor(place[name]))).alias(name)

    ends_of = [F.col(f"_{side}_{name}").alias(f"{name}_{end}") for name in shares for side, end in (("low", "below"), ("high", "above"))]
    return picked.select(key, *map(between, shares), *(ends_of if neighbours else []))
