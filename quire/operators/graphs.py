"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.intermediate import written


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for all nodes of ``edges`` (a, b).

    Each round gives a node the least label among its own and its neighbours', then the label of
    that label, which halves long chains. Rounds are written to the shared folder, which
    cuts their lineage, until no label changes; all that comes to the driver is whether
    one did. Loops, repeated edges and either direction of an edge are the same to it; edges with a null
    end are left out.
    """
    edges = written(edges.select("a", "b").where("a is not null and b is not null"), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("offer"))
        lower = labels.join(offered, labels["node"] == offered["a"], "left").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root"))
        lower = written(lower, "lower")
        jump = lower.select(F.col("node").alias("via"), F.col("root").alias("end"))
        jumped = lower.join(jump, lower["root"] == jump["via"]).select("node", "old", F.col("end").alias("root"))
        jumped = written(jumped, "jumped")
        changed = jumped.where("old <> root").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
