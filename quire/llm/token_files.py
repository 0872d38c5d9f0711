"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import arrow_map, batch, batches_of, columns, written
from .tokens import WORD_VOCABULARY, WordIds, per_worker

END = 1
#: Bytes of a stripe, rows of an index group, and the Bloom filters' false positive rate.
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
FALSE_POSITIVES = 0.01
#: Rows that go to or from Python at once: whole texts and their ids.
BATCH_ROWS = 500


def write_token_files(docs: DataFrame, path: str, vocabulary: str = WORD_VOCABULARY, files: int | None = None, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encode whole texts, append the end id and write them in ascending doc_id order.

    The rows are dealt to files by ranges of doc_id and sorted within each; part numbers follow
    the order of ids. Columns: doc_id, local_start (ids of the documents before it in its
    file), n_tokens, ids. ORC run-length encodes the integers, keeps minimum, maximum and sum of
    each column for the file, for each stripe and for each ``INDEX_ROWS`` rows, and a Bloom
    filter on doc_id, so that a reader of some ids skips what cannot hold them.

    A null text has the end id alone; null ids come first; rows of one id may lie in several files, in the order of a hash of their texts;
    an empty table makes files without rows; other columns are ignored.
    """
    files = files or docs.rdd.getNumPartitions()
    schema = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(WordIds, vocabulary)
        before = 0
        for b in batches:
            doc_ids, texts = columns(b, "doc_id", "text")
            if not texts:
                continue
            encoded = [np.append(np.frombuffer(ids_of(t or ""), np.uint32), np.uint32(END)).astype(np.int32) for t in texts]
            sizes = list(map(len, encoded))
            ends = list(accumulate(sizes, initial=before))
            before = ends[-1]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(encoded)))
            yield batch(schema, doc_ids, ends[:-1], sizes, lists)

    # rows of one id, null ids above all, are dealt to several files by a hash and, if they are the same rows, by their number
    order = ["doc_id", "hash", "row"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    encoded = arrow_map(rows.select("doc_id", "text"), run, "doc_id long, local_start long, n_tokens long, ids array<int>")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        (
            encoded.write.option("orc.stripe.size", stripe_bytes)
            .option("orc.row.index.stride", INDEX_ROWS)
            .option("orc.create.index", "true")
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", FALSE_POSITIVES)
            .option("orc.compress", "zstd")
            .orc(path)
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, local_start, n_tokens, ids and ``part`` (the file's number). Stripes are read in
    parallel; filters on doc_id are pushed to the indexes and Bloom filters."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = spark.read.schema("doc_id long, local_start long, n_tokens long, ids array<int>").orc(path)
    return rows.select("*", name.alias("part"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups without them are pruned."""
    return read_token_files(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before: of the earlier files, one number each,
    and of its own. The files are read at once; what is found in them lies in the shared folder.
    """
    rows = read_token_files(spark, path)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "local_start", "n_tokens", "ids_crc32")] + [("part", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(np.asarray(lists.value_lengths()))
            data = flat.tobytes()
            crcs = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip([0, *ends[:-1]], ends)]
            yield batch(schema, b.column("doc_id"), b.column("local_start"), b.column("n_tokens"), crcs, b.column("part"))

    with batches_of(spark, BATCH_ROWS):
        read = written(arrow_map(rows, run, "doc_id long, local_start long, n_tokens long, ids_crc32 long, part int"), "positions")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = read.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return read.join(firsts, "part").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
