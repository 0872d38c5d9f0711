from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t, most)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x, most)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, fs in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    drawable = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = drawable[: len(drawable) * percent // 100]
    ranks = {id(r): k for k, r in enumerate(drawn, 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 10), (2, 500, 50), (3, 97, 100)])
def test_against_counters(spark, small, most, buckets, percent):
    docs, target = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    texts = [r[0] for r in target.select("text").collect()]
    assert found(importance.resample(docs.repartition(5), target, most, buckets, percent)) == plain(rows, texts, most, buckets, percent)


ROWS = [(1, None), (2, ""), (3, "... --- `"), (None, "Word " * 30), (None, "word " * 30), (7, "É é ÉCOLE école 12a_b " * 10), (7, "É é ÉCOLE école 12a_b " * 10), (8, "too few words"), (9, "many different words " * 20_000)]


def test_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    target = spark.createDataFrame([("école of words",), (None,)], "text string")
    assert found(importance.resample(docs, target, percent=60, least_words=5)) == plain(ROWS, ["école of words", None], percent=60, least=5)
    nothing = target.where("false")
    assert found(importance.resample(docs, nothing, percent=100)) == plain(ROWS, [], percent=100)
    assert importance.resample(empty, target).count() == 0
    clash = odd.withColumn("buckets", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("at", F.lit("clash"))
    assert importance.resample(clash, target).count() == odd.count()


def test_ties_of_every_row(spark):
    """A third and more of the rows have one id and text, so one score: they are ranked without meeting."""
    rows = [(5, "same words again " * 10)] * 400 + [(n, f"words of number {n} " * 6) for n in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = importance.resample(docs, spark.createDataFrame([("words again",)], "text string"), percent=100)
    ranked = [(r["rank"], r["score"], r["doc_id"]) for r in out.orderBy("rank").collect()]
    assert [r[0] for r in ranked] == list(range(1, 701))
    assert all((-a[1], a[2]) <= (-b[1], b[2]) for a, b in zip(ranked, ranked[1:]))
