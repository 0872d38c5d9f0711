"""Term statistics of a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.intermediate import written


def tf_idf(docs: DataFrame) -> DataFrame:
    """doc_id, term, n and weight = n * ln(documents / documents with the term).

    Terms are counted in each document, once, before anything is joined. Counts and frequencies are written before
    they are joined, so that Spark can split the rows of a term that nearly every document has.
    """
    counted = docs.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    counted = written(counted, "counted")
    frequency = written(counted.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    weight = F.col("n") * F.ln(docs.agg(F.count("*")).scalar() / F.col("df"))
    return counted.join(frequency, "term").select("doc_id", "term", "n", weight.alias("weight"))
