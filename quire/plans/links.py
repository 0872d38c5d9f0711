"""Queries over graphs and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import components
from ..operators.search import approximate_nearest, nearest
from ..sources.tables import table


def buyer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even nodes) and parts (odd ones) that lines of a single unit connect, with their group's least node."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 1").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return components(lines.join(orders, "l_orderkey").select((F.col("o_custkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to every vector whose id is divisible by 50, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(_asked(vectors), vectors, 5).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


def approximate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return approximate_nearest(_asked(vectors), vectors, 5)


QUERIES = {
    "buyer_groups": (
        buyer_groups,
        """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity = 1),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, root) AS (SELECT a, a FROM x UNION SELECT x.b, reach.root FROM reach JOIN x ON x.a = reach.node)
SELECT node, min(root) AS root FROM reach GROUP BY 1""",
    ),
    "nearest_vectors": (
        nearest_vectors,
        """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(s, 5) AS similarity, rank FROM r WHERE rank <= 5""",
    ),
    "approximate_vectors": (approximate_vectors, None),
}
