"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

SHARDS = 40


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """A record's score at a shard: -weight / ln(u), u the pair's hash as a number in (0, 1).

    The record goes to the shard of the highest score, which then is any one shard with the
    probability weight / sum of weights, whatever the other shards are.
    """
    bits = F.shiftrightunsigned(F.xxhash64(F.lit("rendezvous"), F.lit(shard), key), 11)
    return F.lit(-weight) / F.log((bits + F.lit(0.5)) / F.lit(float(2**53)))


def choose(key: Column, weights: dict[int, float]) -> Column:
    """The shard of the highest score; of equal scores the higher shard number."""
    if not weights:
        raise ValueError("no shard")
    scored = [F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def assign(records: DataFrame, key: str = "doc_id", shards: int = SHARDS, weights: list[float] | None = None) -> DataFrame:
    """Shards and slots for all records: doc_id (the key), size, text_crc32, law ("key"),
    shard, slot and grown_shard.

    A key's shard depends on the key and the weighted shards alone. ``grown_shard`` is the
    shard under one more shard of weight 1: it is the same or the new one. Slots count each
    shard's records from 0 without gaps. Size: UTF-8 bytes of the text (null: none) plus 16.

    Slots are dealt in two levels: records are numbered within the partition they were
    read from, which no key can make larger, and each shard's partitions follow one another.
    The numbered rows, without texts, are written to the shared folder before they are counted,
    so both levels see the same numbers even if a partition is computed again.

    A null key is a key like any other (all go to one shard); a null text has size 16 and the
    crc32 of the empty string; repeated rows share a shard and have slots of their own; an
    empty table gives no rows; other columns are ignored.
    """
    weights = weights or [1.0] * shards
    now = dict(enumerate(weights))
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = records.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        choose(F.coalesce(F.col(key).cast("string"), F.lit("null")), now).alias("shard"),
        choose(F.coalesce(F.col(key).cast("string"), F.lit("null")), {**now, len(weights): 1.0}).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = written(placed, "placed").withColumn("part", F.shiftright("row", 33))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy("row")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(firsts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), "grown_shard")
    )
