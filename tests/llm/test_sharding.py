from __future__ import annotations

import math
import zlib
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from quire.llm import queries, sharding
from quire.llm.frames import table


def _check(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.grown_shard in (r.shard, shards) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_all_documents(spark, small):
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    rows = queries.op4_rendezvous_sharding(spark, small).collect()
    assert len(rows) == len(texts)
    _check(rows, 40)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))


def test_odd_rows(odd, empty):
    rows = sharding.assign(odd, shards=3).collect()
    assert len(rows) == 11 and sharding.assign(empty).count() == 0
    _check(rows, 3)
    assert {r.size for r in rows if r.doc_id in (3, 5)} == {16}
    assert len({r.shard for r in rows if r.doc_id == 9}) == 1


def test_weights_and_growth(spark):
    keys = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign(keys, weights=[1.0, 2.0, 1.0]).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20000 for r in rows}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    three, four = (sharding.assign(keys, shards=n).select("doc_id", F.col("shard").alias(f"s{n}"), F.col("grown_shard").alias(f"g{n}")) for n in (3, 4))
    both = three.join(four, "doc_id")
    assert both.where("g3 <> s4").count() == 0
    assert both.where("s3 <> s4 and s4 <> 3").count() == 0
    assert abs(both.where("s3 <> s4").count() / 20000 - 0.25) < 0.02


def _best(key, weights):
    """The shard of the highest score, by hand."""
    scores = []
    for shard, weight in enumerate(weights):
        h = xxhash.xxh64_intdigest(b"rendezvous", 42)
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), h)
        h = xxhash.xxh64_intdigest(key.encode(), h)
        scores.append((-weight / math.log(((h >> 11) + 0.5) / 2**53), shard))
    return max(scores)[1]


def test_shards_against_a_plain_argmax(spark):
    keys = spark.range(-50, 400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for weights in ([1.0] * 40, [1.0, 2.5, 0.5], [3.0]):
        for r in sharding.assign(keys, weights=weights).collect():
            assert (r.shard, r.grown_shard) == (_best(str(r.doc_id), weights), _best(str(r.doc_id), [*weights, 1.0]))


def test_of_equal_scores_the_higher_shard(spark):
    row = spark.range(5).select(sharding.choose(F.col("id").cast("string"), {0: 0.0, 2: 0.0, 1: 0.0}).alias("s"))
    assert {r.s for r in row.collect()} == {2}
