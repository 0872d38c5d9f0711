"""The corpus pipeline: documents through five stages to packed sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, language_id, packing, secrets, similar
from quire.llm.frames import arrow_map, in_slices, shared_folder, table

#: Nats a letter that a text may surprise its languages by: what guessing among 64 letters does.
MOST_SURPRISE = math.log(64)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no mixture of the languages explains better than
    guessing at letters does; a text in several languages stays, whatever their shares.

    The models are fitted on the labelled documents that come in; the columns stay as they are, and so do null
    ids and repeated rows. A null text has no letter. Where no document is labelled, only documents without a letter go.
    """
    model = language_id.fit(docs)
    none = not model.languages

    def run(batches):
        import pyarrow as pa

        for b in in_slices(batches):
            texts = b.column("text").to_pylist()
            if none:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            else:
                keep = [surprise is not None and surprise <= MOST_SURPRISE for *_, surprise in language_id.judge(texts, model)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts whose five-word shingles are alike to 0.8 the document of the least id stays.

    Candidates are SimHash fingerprints at most 3 bits apart by Golay keys, as in op6. Texts alike to 0.8 differ in
    about 10 bits, beyond those keys, so texts that share a min-hash key are candidates too; every link is verified. Null texts are
    alike, null ids come after all others, and repeated rows are copies.
    """
    return similar.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All secrets but copied examples are masked; every document stays."""
    return secrets.redact(docs, weak=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Language mixtures, Golay keys and the packing's order have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/stage{number}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
