"""Queries over the star schema: the relational base under the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import asof, within
from ..operators.quantiles import quantiles
from ..operators.ranking import top_per_group
from ..sources.tables import table

_long = lambda c: F.col(c).cast("long")


def filtered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") < 10) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6).alias("net"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables; the dimensions are small and fixed, Spark broadcasts those under its threshold."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("net"), 2).alias("revenue"))


def outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders above a price and lines of a flag: matched and unmatched rows of a full join."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey").distinct()
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    side = F.when(F.col("l_orderkey").isNull(), "left").when(F.col("o_orderkey").isNull(), "right").otherwise("both")
    return joined.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer")
    some = customers.join(orders, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("with_orders"))
    none = customers.join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("without"))
    return some.join(none, "c_mktsegment", "left").select("c_mktsegment", "with_orders", F.coalesce("without", F.lit(0)).cast("long").alias("without"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact statistics of five groups: sums and distinct counts are partial, quantiles are found by ranges of prices."""
    orders = table(spark, sf_dir, "orders")
    placed = quantiles(orders, "o_orderpriority", "o_totalprice", {"q1": 0.25, "mid": 0.5})
    counted = orders.groupBy("o_orderpriority").agg(
        F.round(F.stddev("o_totalprice"), 4).alias("sd"), F.countDistinct("o_custkey").alias("customers"), F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("corr"),
    )
    return counted.join(placed, "o_orderpriority", "left").select("o_orderpriority", "sd", F.round("q1", 4).alias("q1"), F.round("mid", 4).alias("mid"), "customers", "corr")


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))


def line_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def customer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.row_number().over(by).cast("long").alias("nth"), F.dense_rank().over(by).cast("long").alias("dense"), F.ntile(4).over(by).cast("long").alias("quarter"),
        F.round(F.lag(price).over(by), 2).alias("before"), F.round(F.sum(price).over(by.rowsBetween(-2, 0)), 2).alias("last_three"),
        F.round(F.nth_value(price, 2).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 2).alias("second"),
    )


def price_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts within 10 of a part's price and of its brand: a frame by range, not by rows. A brand is sorted in one task."""
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    by = Window.partitionBy("p_brand").orderBy("cents").rangeBetween(-1000, 1000)
    return table(spark, sf_dir, "part").withColumn("cents", cents).select("p_partkey", F.count("*").over(by).alias("near"), F.max("cents").over(by).alias("top"))


def last_purchase_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.last(bought, ignorenulls=True).over(by).alias("purchase"), F.first(bought, ignorenulls=True).over(by).alias("first_purchase"))


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


def top_orders_per_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_per_group(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return best.select("o_orderpriority", "o_orderkey", "rank")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": customers.unionByName(suppliers).distinct(), "intersect": customers.intersect(suppliers), "except_all": customers.exceptAll(suppliers), "union_all": customers.unionAll(suppliers)}
    out = None
    for name, df in parts.items():
        one = df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), _long("k").alias("k"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivot's values are given, so no extra pass looks for them."""
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_orderpriority", *[F.coalesce(s, F.lit(0)).cast("long").alias(s.lower()) for s in ("F", "O", "P")])


def status_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_pivot(spark, sf_dir).unpivot(["o_orderpriority"], ["f", "o", "p"], "status", "n")


def part_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return brands.groupBy("p_type").agg(F.array_join(F.sort_array(F.collect_list("p_brand")), ",").alias("brands"))


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    month = F.date_trunc("month", d).cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month"), (F.dayofweek(d) - 1).cast("long").alias("weekday")).agg(
        F.count("*").alias("n"), F.min(F.datediff(F.last_day(d), F.to_date(d))).cast("long").alias("days_left")
    )


def best_customer_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral subquery: for each nation its two richest customers."""
    for name in ("nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"quire_{name}")
    return spark.sql("""SELECT n_name, c_custkey, round(c_acctbal, 2) AS balance FROM quire_nation,
LATERAL (SELECT c_custkey, c_acctbal FROM quire_customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)""")


def dense_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day, days without any included: a recursive query makes the calendar."""
    table(spark, sf_dir, "events").createOrReplaceTempView("quire_events")
    return spark.sql("""WITH RECURSIVE span AS (SELECT min(to_date(ts)) AS lo, max(to_date(ts)) AS hi FROM quire_events),
days(d, hi) AS (SELECT lo, hi FROM span UNION ALL SELECT date_add(d, 1), hi FROM days WHERE d < hi),
counted AS (SELECT to_date(ts) AS d, count(*) AS n FROM quire_events GROUP BY 1)
SELECT days.d AS day, coalesce(n, 0L) AS n FROM days LEFT JOIN counted ON days.d = counted.d""")


def piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("quire_supplier")
    return spark.sql("FROM quire_supplier |> WHERE s_acctbal > 0 |> AGGREGATE count(*) AS n GROUP BY s_nationkey |> EXTEND n * 2 AS twice")


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, price, size = F.col("p_name"), F.col("p_retailprice"), F.col("p_size")
    words = F.split(name, " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.md5(name).alias("md5"), F.sha2(name, 256).alias("sha"), F.upper(F.substring(name, 1, 3)).alias("head"), F.lpad(size.cast("string"), 4, "0").alias("padded"),
        F.round(F.sqrt(price) + F.ln(price), 6).alias("math"), (size % 7).cast("long").alias("mod"), F.array_join(F.array_sort(words), "-").alias("sorted"),
        F.size(words).cast("long").alias("n_words"), F.map_from_entries(F.array(F.struct(F.lit("size"), size)))["size"].cast("long").alias("from_map"),
        F.translate(name, "aeiou", "AEIOU").alias("translated"), F.reverse(name).alias("reversed"),
    )


def orders_as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every error event the user's latest click not after it."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return asof(errors, clicks, "user_id", "ts", "click_ts", ["click_id"]).select("event_id", "click_id")


def clicks_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"))
    return within(clicks, bought, "user_id", "click_ts", "purchase_ts", 6 * 3600).select("user_id", "click_id", "purchase_id")


def orders_above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar and correlated subqueries: orders above their customer's average."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("quire_orders")
    return spark.sql("SELECT o_orderkey FROM quire_orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM quire_orders i WHERE i.o_custkey = o.o_custkey)")


QUERIES = {
    "filtered_lines": (filtered_lines, "SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "region_revenue": (region_revenue, "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "outer_joins": (outer_joins, "SELECT CASE WHEN l_orderkey IS NULL THEN 'left' WHEN o_orderkey IS NULL THEN 'right' ELSE 'both' END AS side, count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A') ON o_orderkey = l_orderkey GROUP BY 1"),
    "customers_without_orders": (customers_without_orders, "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without FROM customer GROUP BY 1"),
    "statistics": (statistics, "SELECT o_orderpriority, round(stddev(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS mid, count(DISTINCT o_custkey) AS customers, round(corr(o_totalprice, o_custkey), 6) AS corr FROM orders GROUP BY 1"),
    "order_rollup": (order_rollup, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "order_cube": (order_cube, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "line_grouping_sets": (line_grouping_sets, "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "customer_windows": (
        customer_windows,
        """SELECT o_orderkey, row_number() OVER w AS nth, dense_rank() OVER w AS dense, ntile(4) OVER w AS quarter, round(lag(o_totalprice) OVER w, 2) AS before,
round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, round(nth_value(o_totalprice, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 2) AS second
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    ),
    "price_ranges": (price_ranges, "SELECT p_partkey, count(*) OVER w AS near, max(cents) OVER w AS top FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part) WINDOW w AS (PARTITION BY p_brand ORDER BY cents RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING)"),
    "last_purchase_seen": (
        last_purchase_seen,
        """SELECT event_id, last_value(b IGNORE NULLS) OVER w AS purchase, first_value(b IGNORE NULLS) OVER w AS first_purchase FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS b FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ),
    "top_orders": (top_orders, "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20"),
    "top_orders_per_priority": (top_orders_per_priority, "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"),
    "set_operations": (
        set_operations,
        """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer), s AS (SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier)
SELECT 'union' AS op, k, count(*) AS n FROM (SELECT k FROM c UNION SELECT k FROM s) GROUP BY k UNION ALL SELECT 'intersect', k, count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM s) GROUP BY k
UNION ALL SELECT 'except_all', k, count(*) FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s) GROUP BY k UNION ALL SELECT 'union_all', k, count(*) FROM (SELECT k FROM c UNION ALL SELECT k FROM s) GROUP BY k""",
    ),
    "status_pivot": (status_pivot, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"),
    "status_unpivot": (status_unpivot, "SELECT o_orderpriority, s AS status, count(*) FILTER (lower(o_orderstatus) = s) AS n FROM orders, (VALUES ('f'), ('o'), ('p')) v(s) GROUP BY 1, 2"),
    "part_lists": (part_lists, "SELECT p_type, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY 1"),
    "order_calendar": (order_calendar, "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, dayofweek(o_orderdate) AS weekday, count(*) AS n, CAST(min(date_diff('day', CAST(o_orderdate AS DATE), last_day(o_orderdate))) AS BIGINT) AS days_left FROM orders GROUP BY 1, 2"),
    "best_customer_of_nation": (best_customer_of_nation, "SELECT n_name, c_custkey, round(c_acctbal, 2) AS balance FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)"),
    "dense_days": (dense_days, "SELECT d AS day, count(event_id) AS n FROM (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM events) LEFT JOIN events ON CAST(ts AS DATE) = d GROUP BY 1"),
    "piped": (piped, "SELECT s_nationkey, count(*) AS n, count(*) * 2 AS twice FROM supplier WHERE s_acctbal > 0 GROUP BY 1"),
    "scalar_functions": (
        scalar_functions,
        """SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha, upper(substr(p_name, 1, 3)) AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, round(sqrt(p_retailprice) + ln(p_retailprice), 6) AS math,
CAST(p_size % 7 AS BIGINT) AS mod, array_to_string(list_sort(string_split(p_name, ' ')), '-') AS sorted, len(string_split(p_name, ' ')) AS n_words, CAST(p_size AS BIGINT) AS from_map, translate(p_name, 'aeiou', 'AEIOU') AS translated, reverse(p_name) AS reversed FROM part""",
    ),
    "orders_as_of_events": (orders_as_of_events, "SELECT e.event_id, c.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts"),
    "clicks_before_purchases": (clicks_before_purchases, "SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR"),
    "orders_above_average": (orders_above_average, "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
}
