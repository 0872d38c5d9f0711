"""Queries that write documents in every format and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, records
from ..sources.intermediate import shared_folder
from ..sources.tables import table

_SCHEMA = "doc_id long, lang string, n_chars long, digest string"


def format_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lengths and digests through parquet, ORC, JSON, CSV and XML, summed by format and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.md5("text").alias("digest"))
    folder = shared_folder(spark)
    each = []
    for form in files.FORMATS:
        files.write(docs, f"{folder}/{form}", form)
        read = files.read(spark, f"{folder}/{form}", form, _SCHEMA)
        each.append(read.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("digest").alias("least")).withColumn("format", F.lit(form)))
    return reduce(DataFrame.unionByName, each)


def partitioned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parquet sink partitioned by language, of which one partition is read."""
    folder = shared_folder(spark)
    files.write(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), f"{folder}/by_lang", "parquet", ["lang"])
    read = files.read(spark, f"{folder}/by_lang", "parquet", "doc_id long, lang string, source string").where("lang = 'de'")
    return read.groupBy("source").agg(F.count("*").alias("n"))


def record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as records and read by the ``records`` source, by digest."""
    folder = f"{shared_folder(spark)}/records"
    records.write_records(table(spark, sf_dir, "documents").select("text"), folder)
    return records.read_records(spark, folder).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


QUERIES = {
    "format_round_trips": (
        format_round_trips,
        "SELECT lang, n, chars, least, format FROM (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(md5(text)) AS least FROM documents GROUP BY 1), (VALUES ('parquet'), ('orc'), ('json'), ('csv'), ('xml')) f(format)",
    ),
    "partitioned_documents": (partitioned_documents, "SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1"),
    "record_documents": (record_documents, "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1"),
}
