"""Python workers that don't find the package on a path of their own, as on a cluster."""

from __future__ import annotations

import os
import subprocess
import sys

from .conftest import ROOT, SMALL

NAMES = ["approximate_vectors", "record_documents", "argued_sessions", "streamed_balances", "silent_users"]
_RUN = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from quire.plans import registry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name in {NAMES!r}:
    print(name, registry.queries()[name](spark, {SMALL!r}).count() > 0)
spark.stop()
"""


def test_workers_get_the_package(tmp_path):
    """The queries run Python code that is pickled by name; the process starts elsewhere and workers inherit no path."""
    inherited = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", _RUN], cwd=tmp_path, env=inherited, capture_output=True, text=True, timeout=300)
    assert done.stdout.split("\n")[:-1] == [f"{n} True" for n in NAMES], done.stderr[-2000:]
