"""Files of several stripes: read in parallel, and pruned by their indexes and Bloom filters."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyarrow import orc
from tokenizers import Tokenizer

from quire.llm import token_files, tokens
from quire.llm.frames import shared_folder

ROWS = 40_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return {3 * i: " ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for i in range(ROWS)}


@pytest.fixture(scope="module")
def files(spark, texts):
    path = f"{shared_folder(spark)}/stripes"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    token_files.write_token_files(docs, path, files=2, stripe_bytes=1 << 16)
    return path


def _paths(path):
    return sorted(Path(path.removeprefix("file:")).glob("part-*.orc"))


def test_stripes_are_read_in_parallel(spark, files, texts):
    stripes = [orc.ORCFile(p).nstripes for p in _paths(files)]
    assert len(stripes) == 2 and min(stripes) >= 3
    largest = max(p.stat().st_size for p in _paths(files))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", largest // 4)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        read = token_files.read_token_files(spark, files)
        assert read.rdd.getNumPartitions() >= 6
        sizes = [n for n in read.selectExpr("spark_partition_id() as p").groupBy("p").count().select("count").collect()]
        assert len(sizes) >= 4  # several tasks have stripes
        found = token_files.positions(spark, files).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    library = Tokenizer.from_file(tokens.vocabulary(tokens.WORD_VOCABULARY))
    start = 0
    assert [r.doc_id for r in found] == sorted(texts)
    for r in found:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def _scanned(df):
    """Rows that the scan handed on."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return rows, leaf.metrics().apply("numOutputRows").value()


def test_row_groups_are_pruned(spark, files):
    some, read = _scanned(token_files.read_documents(spark, files, [300, 303]))
    assert len(some) == 2 and read <= 3 * token_files.INDEX_ROWS
    # inside every minimum and maximum, but no document's id: the Bloom filters alone rule it out
    none, read = _scanned(token_files.read_documents(spark, files, [301]))
    assert not none and read == 0


def test_odd_rows_come_back(spark, odd, rows_of):
    path = f"{shared_folder(spark)}/odd"
    token_files.write_token_files(odd, path, files=3)
    library = Tokenizer.from_file(tokens.vocabulary(tokens.WORD_VOCABULARY))
    source = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    found = sorted(token_files.positions(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [i for i, _ in source]
    start = 0
    for r, (_, text) in zip(found, source, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_rows_without_an_id_are_dealt_to_several_files(spark):
    """A third of the rows have no id and another third one id and text; no file holds much more than its share."""
    from pyspark.sql import functions as F

    docs = spark.range(1200).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, "same").otherwise(F.concat(F.lit("word "), "id")).alias("text"))
    path = f"{shared_folder(spark)}/hot"
    token_files.write_token_files(docs, path, files=6)
    sizes = [r["count"] for r in token_files.read_token_files(spark, path).groupBy("part").count().collect()]
    assert sum(sizes) == 1200 and len(sizes) == 6 and max(sizes) < 400
    rows = token_files.positions(spark, path).orderBy("start").collect()
    starts = [r.start for r in rows]
    assert starts == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
