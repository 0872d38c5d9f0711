"""Tables, Arrow batches and intermediate results shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.intermediate import forget, shared_folder, written  # noqa: F401
from ..sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` with the package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside takes so many rows at once out of ORC files and to Python workers: for rows of many kilobytes. The
    session's own settings hold again after it."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.orc.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, str(rows))
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that the objects made of one piece are gone before the next."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def unused(names: list[str], name: str) -> str:
    """``name``, or with underscores after it, so that no column (in any case) has it."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def batch(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
