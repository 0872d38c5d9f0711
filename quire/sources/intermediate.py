"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder for this application's intermediate tables, below ``spark.checkpoint.dir``.

    Where the setting is absent, the session's checkpoint directory is used; where there is none
    either, a temporary one is set on a single machine, and on any other master it is an error.
    """
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and its lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Remove this application's intermediate tables. Results that have not been written are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
