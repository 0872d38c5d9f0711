"""The package on the path of Python workers, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each Spark context.

    Spark's own file server sends the archive. What is pickled by name (a module's functions and classes) needs it; it has to be there
    before Spark wraps the function, source or processor that runs in a worker.
    """
    context = spark.sparkContext
    if not getattr(context, "_quire_shipped", False):
        top = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='quire-')}/{top.name}", "zip", top.parent, top.name)
        context.addPyFile(archive)
        context._quire_shipped = True
