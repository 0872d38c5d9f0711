"""Documents and fields in and out of file formats, with stated schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "xml")


def write(df: DataFrame, path: str, form: str, partition_by: list[str] | None = None) -> None:
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    writer = df.write.format(form)
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"').option("multiLine", True)
    if form == "xml":
        writer = writer.option("rowTag", "row")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, form: str, schema: str) -> DataFrame:
    """No schema is inferred: that would read everything twice and could change with the data."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    reader = spark.read.format(form).schema(schema)
    if form == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    if form == "xml":
        reader = reader.option("rowTag", "row")
    return reader.load(path)


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each text file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row for each file: path, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """A row for each image file that can be decoded: path, width, height, channels and the pixels' bytes."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.col("image.origin").alias("path"), *[F.col(f"image.{n}").alias(a) for n, a in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "pixels"))])
