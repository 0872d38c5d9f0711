"""Queries over page and document structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..functions.vectors import cosine, dot, norm
from ..operators.terms import tf_idf
from ..sources.tables import table


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(P.host(F.col("url")).alias("host"), P.link_count(F.col("html")).alias("links"))
    return pages.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("links").alias("n_links"))


def page_link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a page's characters that stand in links, the classical sign of boilerplate."""
    html = F.col("html")
    links = F.regexp_extract_all(html, F.lit("(?is)<a[^>]*>(.*?)</a>"), F.lit(1))
    in_links = F.aggregate(F.transform(links, F.length), F.lit(0), lambda s, n: s + n).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", in_links.alias("link_chars"), F.length(html).cast("long").alias("html_chars"), F.round(in_links / F.length(html), 6).alias("share"))


def decoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.decoded(P.title(F.col("html"))).alias("title"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("line").alias("line_md5"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def char_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = F.size(F.array_distinct(T.char_ngrams(F.col("text"), 5)))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), grams).cast("long").alias("distinct_5grams"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("words"))
    n = F.greatest(F.size("words") - 4, F.lit(0))
    return words.select("doc_id", n.cast("long").alias("n"), F.size(F.array_distinct(T.shingles(F.col("words"), 5))).cast("long").alias("n_distinct"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.delimiter_rows(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(rows).cast("long").alias("n_rows")).where("n_rows > 0")


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tf_idf(table(spark, sf_dir, "documents"))
    return weights.select("doc_id", "term", "n", F.round("weight", 5).alias("weight"))


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(v), 5).alias("norm"), F.round(dot(v, v), 5).alias("square"), F.round(cosine(v, F.reverse(v)), 5).alias("mirrored"))


_WORDS = "regexp_extract_all(lower(text), '\\p{L}+')"

QUERIES = {
    "page_hosts": (page_hosts, "SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS host, count(*) AS n_pages, CAST(sum(len(regexp_extract_all(html, '(?i)<a[ >]'))) AS BIGINT) AS n_links FROM pages GROUP BY 1"),
    "page_link_text": (
        page_link_text,
        """WITH x AS (SELECT page_id, length(html) AS html_chars, CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<a[^>]*>(.*?)</a>', 1), lambda s: length(s))), 0) AS BIGINT) AS link_chars FROM pages)
SELECT page_id, link_chars, html_chars, round(link_chars / html_chars, 6) AS share FROM x""",
    ),
    "decoded_titles": (
        decoded_titles,
        "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS title FROM pages",
    ),
    "document_lines": (document_lines, "SELECT doc_id, pos - 1 AS pos, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"),
    "word_counts": (word_counts, f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_WORDS}) AS word FROM documents) GROUP BY 1, 2"),
    "char_ngram_counts": (char_ngram_counts, "SELECT doc_id, CASE WHEN length(text) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5)))) END AS distinct_5grams FROM documents"),
    "shingle_counts": (
        shingle_counts,
        f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), s AS (SELECT doc_id, list_transform(range(1, greatest(len(ws) - 3, 1)), lambda i: array_to_string(ws[i:i + 4], ' ')) AS sh FROM w)
SELECT doc_id, len(sh) AS n, len(list_distinct(sh)) AS n_distinct FROM s""",
    ),
    "table_rows": (table_rows, "SELECT * FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: len(string_split(l, '|')) > 2)) AS n_rows FROM documents) WHERE n_rows > 0"),
    "term_weights": (
        term_weights,
        f"""WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
SELECT doc_id, term, n, round(n * ln((SELECT count(*) FROM documents) / df), 5) AS weight FROM c JOIN d USING (term)""",
    ),
    "vector_norms": (
        vector_norms,
        """SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, round(list_dot_product(e, e), 5) AS square, round(list_cosine_similarity(e, list_reverse(e)), 5) AS mirrored
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
    ),
}
