from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quire.sources import files, records

SCHEMA = "doc_id long, text string, n double"
ROWS = [(1, 'a "quoted", line\nand another', 1.5), (2, "é 🎉", None), (3, None, -2.0)]


@pytest.mark.parametrize("form", files.FORMATS)
def test_round_trip(spark, tmp_path, form):
    path = str(tmp_path / form)
    files.write(spark.createDataFrame(ROWS, SCHEMA), path, form)
    assert sorted(map(tuple, files.read(spark, path, form, SCHEMA).collect())) == ROWS


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "avro", SCHEMA)


def test_partitioned_files_are_pruned(spark, tmp_path):
    path = str(tmp_path / "parts")
    files.write(spark.createDataFrame(ROWS, SCHEMA), path, "parquet", ["doc_id"])
    plan = files.read(spark, path, "parquet", SCHEMA).where("doc_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(doc_id" in plan


def test_whole_files(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo"), ("b.bin", "xyz")):
        (tmp_path / name).write_text(text)
    assert {r.text for r in files.read_whole_texts(spark, str(tmp_path / "a.txt")).collect()} == {"one\ntwo"}
    assert [(r.length, bytes(r.content)) for r in files.read_binary(spark, str(tmp_path), "*.bin").collect()] == [(3, b"xyz")]


TEXTS = ["first", "a\n---\nb", "c", None, "", "\\N", "\\", "\\n", "\r\n", "ünicode 🎉\u2028\x00", " last ", "x" * 300_000, "\n" * 1000]


@pytest.mark.parametrize("splits", [1, 2, 5, 40])
def test_records(spark, tmp_path, splits):
    path = str(tmp_path / "records")
    records.write_records(spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1), path)
    for where in (path, f"file:{path}", f"file://{path}"):
        found = records.read_records(spark, where, splits).orderBy("position").collect()
        assert [r.text for r in found] == TEXTS
    spark.createDataFrame([], "t string").write.format("records").mode("overwrite").option("path", path).save()
    assert records.read_records(spark, path, splits).count() == 0


def test_images(spark, tmp_path):
    """A picture of 3 x 2 pixels, written by hand as PNG, and a file that is none."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = b"".join(b"\0" + bytes(range(9 * y, 9 * y + 9)) for y in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.png").write_bytes(b"not a picture")
    found = files.read_images(spark, str(tmp_path)).collect()
    assert [(r.width, r.height, r.channels) for r in found] == [(3, 2, 3)]
    assert bytes(found[0].pixels)[:3] == bytes([2, 1, 0])  # blue first


def test_a_folder_of_records(spark, tmp_path):
    texts = [f"text {i}\nof two lines" for i in range(50)] + ["", "é", None]
    path = str(tmp_path / "r")
    for _ in range(2):  # appended
        records.write_records(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), path)
    for splits in (1, 7):
        found = records.read_records(spark, path, splits).collect()
        assert sorted((r.text for r in found), key=str) == sorted(texts + texts, key=str)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = tmp_path / "failed"
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="stop|abort"):
        records.write_records(bad, str(path))
    assert not [p for p in path.rglob("*") if p.is_file()]
    records.write_records(spark.createDataFrame([("kept",)], "text string"), str(path))
    assert [r.text for r in records.read_records(spark, str(path)).collect()] == ["kept"]
