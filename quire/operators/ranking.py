"""Top rows of groups, with a stated order of nulls and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each partition to k rows a group before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)

