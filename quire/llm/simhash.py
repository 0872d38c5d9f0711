"""SimHash near-duplicate classes, found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .frames import arrow_map, batch, columns, written
from .golay import Code
from .tokens import per_worker

WORDS = 3
SEED = 42
BITS = 3
#: Fingerprints of one key that are compared in one task; larger keys are split in blocks of so many.
BLOCK = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SHINGLES_AT_ONCE = 100_000


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's word shingles.

    A-Z are lowered; words are runs of other than ASCII white space; shingles are ``WORDS``
    words joined by spaces, repeats included, or the whole sequence where there are fewer. No word: 0.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    hashed = xxhash.xxh64_digest
    set_, n = np.zeros(64, np.int64), max(1, len(words) - WORDS + 1)
    for at in range(0, n, _SHINGLES_AT_ONCE):
        some = words[at : at + _SHINGLES_AT_ONCE + WORDS - 1]
        if len(words) < WORDS:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(some[i:] for i in range(WORDS))))
        data = np.frombuffer(b"".join([hashed(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(data, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = columns(b, "doc_id", "text")
            yield batch(schema, ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def fuzzy_keys(fps: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64): number of the fingerprint, key.

    Of four 16-bit segments one is free of errors if at most 3 of the 64 bits differ; of two
    23-bit halves of the other 48 bits one has at most 1 error, and its Golay indices
    survive that. A key is the number and bits of the clean segment with a half's number and index.
    """
    numbers, keys = [], []
    for segment in range(4):
        shift = np.uint64(16 * segment)
        clean = ((fps >> shift) & np.uint64(0xFFFF)).astype(np.int64)
        low = fps & np.uint64((1 << 16 * segment) - 1)
        high = (fps >> (shift + np.uint64(16))) << shift if segment < 3 else np.zeros_like(fps)
        rest = low | high
        for half in range(2):
            vector = ((rest >> np.uint64(24 * half)) & np.uint64((1 << 23) - 1)).astype(np.int64)
            number, index = code.keys(vector)
            numbers.append(number)
            keys.append((np.int64(2 * segment + half) << 28) | (clean[number] << 12) | index)
    return np.concatenate(numbers), np.concatenate(keys)


def _keyed(distinct: DataFrame) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = per_worker(Code)
        for b in batches:
            all_ = b.column("fp").to_numpy()
            for i in range(0, len(all_), 4096):
                fps = all_[i : i + 4096]
                number, key = fuzzy_keys(fps.view(np.uint64), code)
                yield batch(schema, key, fps[number])

    return arrow_map(distinct, run, "key long, fp long")


def _trees(fps: np.ndarray, first: int, most: int) -> tuple[list, list]:
    """(member, root) for the classes of one key's fingerprints, links being at most ``most`` bits.

    A class is gone through from its first fingerprint, each member being compared once
    with all that are still unplaced: as many rows come out as members, not as pairs. With
    ``first`` > 0 only pairs of one fingerprint before it and one from it on are links.
    """
    members, roots = [], []
    side = np.arange(len(fps)) >= first
    unplaced = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not unplaced[start]:
            continue
        unplaced[start] = False
        waiting = [start]
        while waiting:
            at = waiting.pop()
            other = np.flatnonzero(unplaced & (side != side[at])) if first else np.flatnonzero(unplaced)
            near = other[np.bitwise_count((fps[other] ^ fps[at]).view(np.uint64)) <= most]
            unplaced[near] = False
            waiting += near.tolist()
            members += fps[near].tolist()
            roots += [int(fps[start])] * len(near)
    return members, roots


def links(distinct: DataFrame, most: int = BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs of fingerprints at most ``most``
    (3) bits apart. ``distinct`` has each fingerprint once.

    Fingerprints that share a fuzzy key meet in one row and are compared there; what comes out of
    a key is a tree for each of its classes. A key of more than ``block`` fingerprints is
    split into blocks, and every two blocks meet in a row of their own, so no row
    holds more than two blocks and no pair is left out.
    """
    if most > BITS:
        raise ValueError("the keys are complete up to 3 bits")
    keyed = _keyed(distinct)
    large = keyed.groupBy("key").count().where(F.col("count") > block)
    # written, so that its own size is known: a key of more than a block is a rare one, while the size that Spark gives the keys, which come out
    # of Python at 43 a fingerprint, is that of the fingerprints, and it would broadcast them all when they look smaller than the counts do
    large = written(large.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    plain = keyed.join(large, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("fps"))
    plain = plain.where(F.size("fps") > 1).select("fps", F.lit(0).alias("first"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = keyed.join(large, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("fp"))).alias("here"),
        F.collect_list(F.when(F.col("own") > F.col("other"), F.col("fp"))).alias("there"),
    )
    blocks = met.select(F.concat("here", "there").alias("fps"), F.when(F.col("i") == F.col("j"), 0).otherwise(F.size("here")).alias("first"))
    blocks = blocks.where((F.size("fps") > 1) & (F.col("first") < F.size("fps")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("fps")
            flat = lists.flatten().to_numpy()
            sizes = np.asarray(lists.value_lengths())
            starts = np.cumsum(sizes) - sizes
            firsts = b.column("first").to_numpy()
            two = starts[sizes == 2]
            near = np.bitwise_count((flat[two] ^ flat[two + 1]).view(np.uint64)) <= most
            out_a, out_b = [flat[two][near]], [flat[two + 1][near]]
            for i in np.flatnonzero(sizes > 2):
                members, roots = _trees(flat[starts[i] : starts[i] + sizes[i]], int(firsts[i]), most)
                out_a.append(np.array(members, np.int64))
                out_b.append(np.array(roots, np.int64))
            yield batch(schema, np.concatenate(out_a), np.concatenate(out_b))

    return arrow_map(plain.unionByName(blocks), run, "a long, b long").distinct()


def classes(fps: DataFrame, most: int = BITS) -> DataFrame:
    """fp, class (one fingerprint for all that are linked, directly or not) and component (the least
    doc_id of the class).

    ``fps`` has doc_id and fp and must be cheap and stable to read again. Fingerprints
    without a link are their own class. Null ids are left out of the least; a class of null ids alone has null.
    """
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp"), most))
    linked = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", "root")
    of_root = linked.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    single = linked.where("root is null").select("fp", F.col("fp").alias("class"), F.col("least").alias("component"))
    return linked.join(of_root, "root").select("fp", F.col("root").alias("class"), "component").unionByName(single)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents link where their fingerprints differ in at most 3 bits. A null or empty text
    has fingerprint 0 and links like any other; a null id stays null; repeated rows are
    documents of one class; an empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs), "fingerprints")
    # written, so that the rows of a fingerprint that a large part of all documents have can be split
    found = fps.join(written(classes(fps), "classes"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))

