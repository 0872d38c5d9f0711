"""Further relational queries: join kinds and strategies, sketches, URL, array and map functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..sources.tables import table

#: Relative error that the sketches of ``distinct_estimates`` must keep to.
BOUND = 0.1


def join_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join under three strategies. The broadcast side is the table of nations, whose size is fixed."""
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    each = [
        customers.join(nations.hint(hint), "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).withColumn("strategy", F.lit(hint))
        for hint in ("broadcast", "merge", "shuffle_hash")
    ]
    return reduce(DataFrame.unionByName, each)


def suppliers_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right join: all nations, with the number of suppliers above a balance, 0 where there is none."""
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return rich.join(table(spark, sf_dir, "nation"), "n_nationkey", "right").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


def segment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross join of two fixed dimensions (regions and order priorities), filled from the facts."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    counted = orders.join(customers, "o_custkey").join(nations, "n_nationkey").groupBy("r_regionkey", "o_orderpriority").agg(F.count("*").alias("n"))
    grid = table(spark, sf_dir, "region").crossJoin(orders.select("o_orderpriority").distinct())
    return grid.join(counted, ["r_regionkey", "o_orderpriority"], "left").select("r_name", "o_orderpriority", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distinct_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, and whether the sketches (a few kilobytes a group, whatever its size) come near them:
    HyperLogLog, theta, KLL and count-min. A value that is no number counts as none.

    Sketches and different users are aggregated apart: beside a distinct count Spark would make each sketch by type and user first.
    """
    events = table(spark, sf_dir, "events").withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None)))
    middles = quantiles(events, "event_type", "value", {"low": 0.45, "high": 0.55}, neighbours=True).select(F.col("event_type").alias("of_middles"), "low_below", "high_above")
    counted = events.groupBy(F.col("event_type").alias("of_users")).agg(F.countDistinct("user_id").alias("users"))
    middle = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("value"), F.lit(0.5))
    estimated = events.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.approx_count_distinct("user_id", 0.02).alias("approx"),
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("hll"),
        F.theta_sketch_estimate(F.theta_sketch_agg("user_id")).alias("theta"),
        F.when(F.count("value") > 0, middle).alias("kll"),
        F.percentile_approx("value", 0.5, 1000).alias("median"),
        (F.octet_length(F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.95), F.lit(42))) > 0).alias("count_min_there"),
    )
    near = lambda c: (F.abs(F.col(c) - F.col("users")) <= F.greatest(F.lit(1.0), BOUND * F.col("users"))).alias(f"{c}_near")
    # a group without values has no middle, by the sketches or exactly
    near_middle = lambda c: F.coalesce(F.col(c).between(F.col("low_below"), F.col("high_above")), F.col(c).isNull() & F.col("low_below").isNull()).alias(f"{c}_near")
    found = estimated.join(counted, F.col("event_type").eqNullSafe(F.col("of_users"))).join(middles, F.col("event_type").eqNullSafe(F.col("of_middles")), "left")
    return found.select("event_type", "users", "n", *map(near, ("approx", "hll", "theta")), *map(near_middle, ("kll", "median")), "count_min_there")


def frequent_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent event types by a bounded sketch, with its counts."""
    found = table(spark, sf_dir, "events").agg(F.expr("approx_top_k(event_type, 3, 100)").alias("top"))
    return found.select(F.explode("top").alias("x")).select(F.col("x.item").alias("event_type"), F.col("x.count").cast("long").alias("n"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the pages' addresses, and their encoded form and back."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.parse_url(url, F.lit("PROTOCOL")).alias("protocol"),
        F.parse_url(url, F.lit("PATH")).alias("path"),
        F.parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"),
        F.parse_url(url, F.lit("REF")).alias("fragment"),
        (F.url_decode(F.url_encode(url)) == url).alias("round_trip"),
        F.to_json(F.map_from_arrays(F.array(F.lit("id")), F.array("page_id"))).alias("as_json"),
    )


def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and maps of the words of part names and types."""
    name, kind = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    lengths = F.map_from_entries(F.transform(F.array_distinct(name), lambda w: F.struct(w.alias("key"), F.length(w).alias("value"))))
    joined = lambda a: F.array_join(F.array_sort(a), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        joined(F.array_union(name, kind)).alias("either"),
        joined(F.array_except(name, kind)).alias("name_only"),
        joined(F.array_intersect(name, kind)).alias("both"),
        F.arrays_overlap(name, kind).alias("overlap"),
        F.array_join(F.slice(name, 1, 2), "+").alias("first_two"),
        F.array_position(name, F.element_at(name, -1)).cast("long").alias("last_at"),
        F.aggregate(F.map_values(lengths), F.lit(0), lambda s, n: s + n).cast("long").alias("letters"),
        F.array_max(F.map_values(F.map_filter(lengths, lambda k, v: v > 3))).cast("long").alias("longest"),
        F.exists(name, lambda w: F.length(w) > 6).alias("has_long"),
        F.array_join(F.transform(F.arrays_zip(name, F.sequence(F.lit(1), F.size(name))), lambda z: F.concat(z["1"].cast("string"), F.lit(":"), z["0"])), ",").alias("numbered"),
    )


_URL = r"regexp_extract(url, '^([a-z]+)://[^/?#]+([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', {})"
QUERIES = {
    "join_strategies": (join_strategies, "SELECT n_name, n, balance, strategy FROM (SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), (VALUES ('broadcast'), ('merge'), ('shuffle_hash')) s(strategy)"),
    "suppliers_of_nations": (suppliers_of_nations, "SELECT n_name, count(s_suppkey) AS suppliers FROM (SELECT * FROM supplier WHERE s_acctbal > 8000) RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "segment_grid": (
        segment_grid,
        """WITH c AS (SELECT n_regionkey AS k, o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT r_name, g.p AS o_orderpriority, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) g LEFT JOIN c ON r_regionkey = k AND g.p = c.p""",
    ),
    "distinct_estimates": (
        distinct_estimates,
        "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, true AS approx_near, true AS hll_near, true AS theta_near, true AS kll_near, true AS median_near, true AS count_min_there FROM events GROUP BY 1",
    ),
    "frequent_types": (frequent_types, "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC LIMIT 3"),
    "url_parts": (
        url_parts,
        rf"""SELECT page_id, {_URL.format(1)} AS protocol, {_URL.format(2)} AS path, nullif(regexp_extract({_URL.format(3)}, '(?:^|&)page=([^&]*)', 1), '') AS page, nullif({_URL.format(4)}, '') AS fragment,
true AS round_trip, '{{"id":' || page_id || '}}' AS as_json FROM pages""",
    ),
    "array_functions": (
        array_functions,
        """WITH a AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS n, string_split(lower(p_type), ' ') AS k FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(n, k))), ' ') AS either, array_to_string(list_sort(list_distinct(list_filter(n, lambda w: NOT list_contains(k, w)))), ' ') AS name_only,
array_to_string(list_sort(list_distinct(list_filter(n, lambda w: list_contains(k, w)))), ' ') AS both, list_has_any(n, k) AS overlap, array_to_string(n[1:2], '+') AS first_two, CAST(list_position(n, n[-1]) AS BIGINT) AS last_at,
CAST(list_sum(list_transform(list_distinct(n), lambda w: length(w))) AS BIGINT) AS letters, CAST(list_max(list_transform(list_filter(n, lambda w: length(w) > 3), lambda w: length(w))) AS BIGINT) AS longest,
len(list_filter(n, lambda w: length(w) > 6)) > 0 AS has_long, array_to_string(list_transform(n, lambda w, i: i || ':' || w), ',') AS numbered FROM a""",
    ),
}
