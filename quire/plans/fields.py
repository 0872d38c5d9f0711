"""Queries that extract and validate fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import PATTERNS, find, holds, is_valid
from ..sources.tables import table


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds in long form: doc_id, field, ordinal, value, valid; one scan of the documents."""
    docs = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.struct(F.lit(k).alias("field"), find(F.col("text"), k).alias("found")) for k in PATTERNS])
    each = docs.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.field", F.posexplode("k.found").alias("ordinal", "value"))
    valid = reduce(lambda c, k: c.when(F.col("field") == k, is_valid(k, F.col("value"))), PATTERNS, F)
    return each.select("doc_id", "field", F.col("ordinal").cast("long").alias("ordinal"), "value", valid.alias("valid"))


def field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted_fields(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return found.groupBy("source", "lang", "field").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("long")).alias("n_valid"))


def routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue for each document by what it holds, first rule first, and the queues' sizes by language."""
    text = F.col("text")
    has = {k: holds(text, k) for k in PATTERNS}
    queue = F.when(has["card"], "payment").when(has["email"] | has["phone"], "contact").when(has["ipv4"], "technical").when(F.contains(text, F.lit("|")), "tabular").when(has["licence"], "legal").otherwise("general")
    return table(spark, sf_dir, "documents").groupBy("lang", queue.alias("queue")).agg(F.count("*").alias("n"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(value).alias("sum_k"), F.min(value).alias("min_k"), F.max(value).alias("max_k"))


def event_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].cast("long").alias("k"), F.to_json(F.struct(parsed["k"].alias("k"))).alias("compact"))


def length_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.sum((F.col("n_chars") != F.length("text")).cast("long")).alias("wrong"), F.sum((F.octet_length("text") != F.length("text")).cast("long")).alias("multibyte"))


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the first word of each order priority and part type converts to a number."""
    head = F.substring_index("o_orderpriority", "-", 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("try_cast(substring_index(o_orderpriority, '-', 1) as int)").cast("long").alias("level"), F.expr("try_cast(o_orderpriority as double)").alias("number"), head.alias("head"))


def name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance between the names of nations of one region (ASCII)."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"))


_KIND = lambda k: PATTERNS[k].replace("'", "''")
_LUHN = "(list_sum(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CAST(substr(reverse(value), i, 1) AS INT) * 2) // 10 + (CAST(substr(reverse(value), i, 1) AS INT) * 2) % 10 ELSE CAST(substr(reverse(value), i, 1) AS INT) END)) % 10 = 0)"
_ALL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, unnest(f) AS value, generate_subscripts(f, 1) - 1 AS ordinal FROM (SELECT doc_id, regexp_extract_all(text, '{_KIND(k)}') AS f FROM documents)" for k in PATTERNS)
_EXTRACTED = f"""SELECT doc_id, field, ordinal, value, CASE field WHEN 'card' THEN {_LUHN} WHEN 'ipv4' THEN len(list_filter(string_split(value, '.'), lambda p: CAST(p AS INT) > 255)) = 0 ELSE true END AS valid FROM ({_ALL})"""
_HAS = lambda k: f"regexp_matches(text, '{_KIND(k)}')"

QUERIES = {
    "extracted_fields": (extracted_fields, _EXTRACTED),
    "field_summary": (field_summary, f"SELECT source, lang, field, count(*) AS n, CAST(sum(CAST(valid AS INT)) AS BIGINT) AS n_valid FROM ({_EXTRACTED}) JOIN documents USING (doc_id) GROUP BY 1, 2, 3"),
    "routed_documents": (
        routed_documents,
        f"SELECT lang, CASE WHEN {_HAS('card')} THEN 'payment' WHEN {_HAS('email')} OR {_HAS('phone')} THEN 'contact' WHEN {_HAS('ipv4')} THEN 'technical' WHEN contains(text, '|') THEN 'tabular' WHEN {_HAS('licence')} THEN 'legal' ELSE 'general' END AS queue, count(*) AS n FROM documents GROUP BY 1, 2",
    ),
    "event_properties": (event_properties, "SELECT event_type, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"),
    "event_structs": (event_structs, "SELECT event_id, k, '{\"k\":' || k || '}' AS compact FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"),
    "length_mismatches": (length_mismatches, "SELECT lang, CAST(sum(CAST(n_chars <> length(text) AS INT)) AS BIGINT) AS wrong, CAST(sum(CAST(octet_length(encode(text)) <> length(text) AS INT)) AS BIGINT) AS multibyte FROM documents GROUP BY 1"),
    "orphan_orders": (orphan_orders, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "safe_casts": (safe_casts, "SELECT o_orderkey, CAST(try_cast(split_part(o_orderpriority, '-', 1) AS INT) AS BIGINT) AS level, try_cast(o_orderpriority AS DOUBLE) AS number, split_part(o_orderpriority, '-', 1) AS head FROM orders"),
    "name_distances": (name_distances, "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"),
}
