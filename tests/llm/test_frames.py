from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from quire.llm import frames


def _session(master, checkpoint=None):
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(sparkContext=context, conf={})


def test_intermediate_tables_need_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            frames.shared_folder(_session(master))
    assert frames.shared_folder(_session("yarn", "s3a://b/c/")).startswith("s3a://b/c/quire-app-1/")
    given = _session("yarn")
    given.conf = {"spark.checkpoint.dir": "hdfs://x/y"}
    assert frames.shared_folder(given).startswith("hdfs://x/y/quire-app-1/")


def test_forget_removes_what_was_written(spark):
    df = frames.written(spark.range(3).toDF("x"), "some")
    folder = df.inputFiles()[0].split(":", 1)[1].rsplit("/", 2)[0].replace("///", "/")
    assert df.count() == 3 and os.path.isdir(folder)
    frames.forget(spark)
    assert not os.path.exists(folder) and not os.path.exists(os.path.dirname(folder))
    assert frames.written(spark.range(2).toDF("x"), "some").count() == 2
