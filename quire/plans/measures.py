"""Queries that mask, measure and evaluate documents."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, text
from ..sources.tables import table

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = ["the", "of", "and", "to", "in", "der", "die", "und", "zu", "la", "le", "et", "les", "el", "los", "que"]
#: Characters that a line has at least, and documents that it stands in, for it to be a repeated line.
LINE, DOCUMENTS = 21, 3
#: A document's measures and the ranges, ends included, in which each gives a point.
RANGES = {"n_words": (20, 100_000), "symbols": (0.0, 0.1), "word_length": (3.0, 10.0), "stop_words": (0.02, 0.7), "repeated_lines": (0.0, 0.2)}


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its e-mail addresses, tokens, IP addresses, card and phone numbers masked, as a digest, and what changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fields.masked(F.col("text")).alias("masked"))
    return docs.select("doc_id", F.md5("masked").alias("masked_md5"), (F.col("masked") != F.col("text")).alias("changed"), (F.length("text") - F.length("masked")).cast("long").alias("shorter"))


def _measures(docs: DataFrame, *keep: str) -> DataFrame:
    """Ratios of a text's characters, words and lines; null where there is nothing to divide by."""
    body = F.col("text")
    words, lines = text.words(body), F.filter(text.lines(body), lambda x: x != "")
    of = docs.select(*keep, "text", words.alias("words"), lines.alias("lines"))
    symbols = F.length(F.regexp_replace(body, r"[\p{L}\p{N}\s]", ""))
    letters = F.aggregate(F.transform("words", F.length), F.lit(0), lambda s, n: s + n)
    stop = F.size(F.filter("words", lambda w: w.isin(STOP_WORDS)))
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    n_words, n_lines = F.size("words"), F.size("lines")
    return of.select(
        *keep,
        n_words.cast("long").alias("n_words"),
        ratio(symbols, F.length(body)).alias("symbols"),
        ratio(letters, n_words).alias("word_length"),
        ratio(stop, n_words).alias("stop_words"),
        ratio(n_lines - F.size(F.array_distinct("lines")), n_lines).alias("repeated_lines"),
    )


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measures(table(spark, sf_dir, "documents"), "doc_id")


def rule_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on the measures against the labels, by language: the four counts, precision and recall."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    said = (F.col("n_words") >= 100) & (F.col("stop_words") >= 0.05) & (F.col("symbols") < 0.1)
    judged = _measures(table(spark, sf_dir, "documents"), "doc_id", "lang").join(labels, "doc_id").select("lang", "good", F.coalesce(said, F.lit(False)).alias("said"))
    count = lambda c: F.sum(c.cast("long"))
    counted = judged.groupBy("lang").agg(
        count(F.col("said") & F.col("good")).alias("tp"), count(F.col("said") & ~F.col("good")).alias("fp"), count(~F.col("said") & F.col("good")).alias("fn"), count(~F.col("said") & ~F.col("good")).alias("tn")
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), 6)
    return counted.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each document by its measures, a point for each that lies in its range, and the queue it goes to.

    A measure that has nothing to divide by gives no point, so a text without words or lines is refused.
    """
    measured = _measures(table(spark, sf_dir, "documents"), "doc_id", "lang", "source")
    points = [F.when(F.col(name).between(low, high), 1).otherwise(0) for name, (low, high) in RANGES.items()]
    score = reduce(add, points).cast("long")
    queue = F.when(F.col("score") == len(points), "accepted").when(F.col("score") >= len(points) - 1, "reviewed").otherwise("refused")
    return measured.withColumn("score", score).select("doc_id", "lang", "source", "score", queue.alias("queue"))


def queue_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queues against the labels: documents, those labelled, and the share of good and of toxic ones among these."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = scored_documents(spark, sf_dir).join(labels, "doc_id", "left")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return rows.groupBy("queue").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), mean("quality"), mean("toxic"))


def _long_lines(docs: DataFrame) -> DataFrame:
    line: Column = F.explode(text.lines(F.col("text")))
    return docs.select("doc_id", line.alias("line")).where(F.length("line") >= LINE).select("doc_id", F.md5("line").alias("line_md5"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in several documents, such as headers and footers: how many documents, and how often.

    Lines are counted within a document before documents are, so that a line that is everywhere is
    a row a document, then a row a task.
    """
    within = _long_lines(table(spark, sf_dir, "documents")).groupBy("line_md5", "doc_id").agg(F.count("*").alias("n"))
    return within.groupBy("line_md5").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).where(F.col("documents") >= DOCUMENTS)


def self_repeating_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a line that isn't empty."""
    lines = F.filter(text.lines(F.col("text")), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.array_distinct(lines)).cast("long").alias("different"))
    return docs.where("different < lines")


def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a tenth of the documents, chosen by their key alone: the same ones wherever and whenever it runs."""
    chosen = F.md5(F.col("doc_id").cast("string")) < "1a"
    return table(spark, sf_dir, "documents").where(chosen).select("doc_id", "lang", "source")


_MASKED = "text"
for _kind in fields.MASKED:
    _pattern = fields.PATTERNS[_kind].replace("'", "''")
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '[{_kind.upper()}]', 'g')"
_IN_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_MEASURES = rf"""(WITH w AS (SELECT *, regexp_extract_all(lower(text), '\p{{L}}+') AS ws, list_filter(string_split(text, chr(10)), lambda l: l <> '') AS ls FROM documents)
SELECT doc_id, lang, source, len(ws) AS n_words, round(CAST(length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 6) AS symbols,
round(CAST(list_sum(list_transform(ws, lambda x: length(x))) AS DOUBLE) / nullif(len(ws), 0), 6) AS word_length,
round(CAST(len(list_filter(ws, lambda x: x IN ({_IN_STOP}))) AS DOUBLE) / nullif(len(ws), 0), 6) AS stop_words,
round(CAST(len(ls) - len(list_distinct(ls)) AS DOUBLE) / nullif(len(ls), 0), 6) AS repeated_lines FROM w)"""
_LINES = f"(SELECT doc_id, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= {LINE})"

_POINTS = " + ".join(f"(CASE WHEN {name} BETWEEN {low} AND {high} THEN 1 ELSE 0 END)" for name, (low, high) in RANGES.items())
_SCORED = f"""(SELECT doc_id, lang, source, score, CASE WHEN score = {len(RANGES)} THEN 'accepted' WHEN score >= {len(RANGES) - 1} THEN 'reviewed' ELSE 'refused' END AS queue
FROM (SELECT *, CAST({_POINTS} AS BIGINT) AS score FROM {_MEASURES}))"""

QUERIES = {
    "scored_documents": (scored_documents, f"SELECT * FROM {_SCORED}"),
    "queue_quality": (queue_quality, f"SELECT queue, count(*) AS documents, count(quality) AS labelled, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM {_SCORED} LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "masked_documents": (masked_documents, f"SELECT doc_id, md5(m) AS masked_md5, m <> text AS changed, length(text) - length(m) AS shorter FROM (SELECT doc_id, text, {_MASKED} AS m FROM documents)"),
    "text_measures": (text_measures, f"SELECT doc_id, n_words, symbols, word_length, stop_words, repeated_lines FROM {_MEASURES}"),
    "rule_evaluation": (
        rule_evaluation,
        f"""WITH j AS (SELECT lang, quality = 1 AS good, coalesce(n_words >= 100 AND stop_words >= 0.05 AND symbols < 0.1, false) AS said FROM {_MEASURES} m JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (said AND good) AS tp, count(*) FILTER (said AND NOT good) AS fp, count(*) FILTER (NOT said AND good) AS fn, count(*) FILTER (NOT said AND NOT good) AS tn FROM j GROUP BY 1)
SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall FROM c""",
    ),
    "repeated_lines": (repeated_lines, f"SELECT line_md5, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM {_LINES} GROUP BY 1 HAVING count(DISTINCT doc_id) >= {DOCUMENTS}"),
    "self_repeating_documents": (self_repeating_documents, "SELECT * FROM (SELECT doc_id, len(ls) AS lines, len(list_distinct(ls)) AS different FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: l <> '') AS ls FROM documents)) WHERE different < lines"),
    "sampled_documents": (sampled_documents, "SELECT doc_id, lang, source FROM documents WHERE md5(CAST(doc_id AS VARCHAR)) < '1a'"),
}
