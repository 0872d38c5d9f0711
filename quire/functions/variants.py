"""Semi-structured values: JSON text as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The text as VARIANT; null where it is null or no JSON."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str) -> Column:
    """What lies at ``path`` as ``kind``; null where nothing does, or something of another kind that can't be cast."""
    return F.try_variant_get(value, path, kind)


def exploded(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """pos, key and value (VARIANT) of each field of an object, or element of an array (whose key is null), in ``column``, beside ``keep``. Rows of scalars,
    JSON null or none have no row."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer())).select(*keep, "pos", "key", "value")


def schema_of(column: Column) -> Column:
    """The one schema that all values of a group have a place in."""
    return F.schema_of_variant_agg(column)
