"""Canonical exact digests of texts: Unicode, case and white space folded, wide xxhash, bytes compared."""

from __future__ import annotations

import hashlib
import struct
import unicodedata
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import arrow_map, batch, columns, written


def canonical(text: str) -> str:
    """NFKC, case folded, NFKC again (folding can undo it), runs of white space as one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


#: Hex digits of a digest: the 128 bits of XXH3.
DIGITS = 32


def digest(canon: bytes, digits: int = DIGITS) -> str:
    """XXH3's 128 bits in lower-case hex, or its first digits."""
    return xxhash.xxh3_128_hexdigest(canon)[:digits]


def checks(canon: bytes) -> tuple[int, int]:
    """128 bits of SHA-256, which tell apart forms that share a digest."""
    return struct.unpack("<qq", hashlib.sha256(canon).digest()[:16])


def likeness(a: bytes, b: bytes) -> float:
    """Of two canonical forms: 1 if their digests and then their bytes are equal, else 0."""
    return float(digest(a) == digest(b) and a == b)


def _packed(canon: bytes) -> bytes:
    """A canonical form for the comparison by bytes: the compressor is a function with an inverse,
    so packed forms are equal exactly where the forms are."""
    return zstandard.ZstdCompressor(level=1).compress(canon)


def digests(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, hash (of the text as it is), digest, check_a and check_b of each whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, hashes = columns(b, "doc_id", "text", "hash")
            canons = [canonical(t or "").encode() for t in texts]
            found = list(map(checks, canons))
            yield batch(_DIGESTS, ids, hashes, [digest(c, digits) for c in canons], [a for a, _ in found], [b for _, b in found])

    return arrow_map(docs.select("doc_id", "text", _hash()), run, "doc_id long, hash long, digest string, check_a long, check_b long")


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("digest", pa.string()), ("check_a", pa.int64()), ("check_b", pa.int64())])


def collisions(packed: DataFrame, forms: DataFrame) -> DataFrame | None:
    """digest, check_a, check_b and ``fingerprint`` of the forms whose digest another form has too; None
    if there is no such digest.

    ``packed`` has a digest and the packed form of every document whose digest is repeated, and these bytes are
    compared: a bucket's least and greatest are found by partial aggregation, so a bucket of any size is a row
    a task. ``forms`` has the digest and checks of all forms, edited ones as well. Where bytes or
    checks differ, a digest stands for several forms, and each after the first has its rank added. All that
    comes to the driver is whether there is such a digest, so without one nothing is joined.
    """
    differ = lambda df, *names: df.groupBy("digest").agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).where(" or ".join(f"min_{n} <> max_{n}" for n in names)).select("digest")
    collided = written(differ(packed, "packed").union(differ(forms, "check_a", "check_b")).distinct(), "collided")
    if collided.isEmpty():
        return None
    each = forms.join(collided, "digest", "left_semi").select("digest", "check_a", "check_b").distinct()
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("check_a", "check_b")) - 1
    named = F.concat_ws("-", "digest", F.when(F.col("rank") > 0, F.col("rank").cast("string")))
    return written(each.withColumn("rank", rank).select("digest", "check_a", "check_b", named.alias("fingerprint")), "ranked")


def _named(rows: DataFrame, ranked: DataFrame | None, digest: str, check_a: str, check_b: str, name: str) -> DataFrame:
    """``rows`` with column ``name``: the form's fingerprint."""
    if ranked is None:
        return rows.withColumn(name, F.col(digest))
    own = ranked.select(F.col("digest").alias(digest), F.col("check_a").alias(check_a), F.col("check_b").alias(check_b), F.col("fingerprint").alias(name))
    return rows.join(own, [digest, check_a, check_b], "left").withColumn(name, F.coalesce(name, digest))


def fingerprints(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """doc_id, fingerprint and copies (documents of the same canonical form) for whole texts.

    Equal texts have equal fingerprints, and texts of different canonical forms different ones.
    A null text counts as empty and null ids are kept; repeated rows are copies; an empty
    table gives no rows; other columns are ignored.
    """
    found = written(digests(docs, digits), "digests")
    many = written(found.groupBy("digest").count().where("count > 1").select("digest"), "many")
    schema = pa.schema([("digest", pa.string()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canons = [canonical(t or "").encode() for t in columns(b, "text")[0]]
            yield batch(schema, [digest(c, digits) for c in canons], list(map(_packed, canons)))

    packed = arrow_map(docs.select("text"), run, "digest string, packed binary").join(many, "digest", "left_semi")
    named = _named(found, collisions(packed, found), "digest", "check_a", "check_b", "fingerprint")
    counted = named.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    return named.join(written(counted, "counted"), "fingerprint").select("doc_id", "fingerprint", "copies")


def edits(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness.

    A document's edited text has its last floor(n/2) code points replaced by the first as many
    (or all) of the next document in ascending doc_id, the first following the last. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Which digests occur more than once is found first, from the digests alone. Then the
    documents are dealt by ranges of doc_id and a hash of the text and read in order, so a document meets its successor
    in the same task; only the first and last document of each range, a row a
    task each, are matched by a join. Documents of repeated digests hand on their packed forms for the
    comparison by bytes; edited texts are held against them by their SHA-256 (``collisions``). Nulls: a null
    text is empty, null ids come first, rows of one id are ordered by the hash, which deals those without an id to many tasks; a table of one row is its own
    successor; an empty table gives no rows.
    """
    found = written(digests(docs, digits), "digests")
    many = written(found.groupBy("digest").count().where("count > 1").select("digest"), "many")
    repeated = found.join(many, "digest", "left_semi").select("doc_id", "hash").distinct()
    n = docs.rdd.getNumPartitions()
    flags = repeated.select("doc_id", "hash", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    rows = docs.select("doc_id", _hash(), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("kind")).unionByName(flags)
    dealt = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "kind", "text")
    passed = written(arrow_map(dealt, partial(_in_order, digits=digits), _PASSED), "passed")
    done = passed.where("edge = ''").drop("edge", "part", "text", "next_text")
    everything = done.unionByName(written(_edges(passed.where("edge <> ''"), digits), "edges"))
    forms = everything.select("digest", "check_a", "check_b").union(everything.select("edited_digest", "edited_a", "edited_b"))
    ranked = collisions(everything.where("packed is not null").select("digest", "packed"), forms)
    named = _named(everything, ranked, "digest", "check_a", "check_b", "fingerprint")
    named = _named(named, ranked, "edited_digest", "edited_a", "edited_b", "edited_fingerprint")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


_JUDGED = "n_chars long, edited_sha256 string, digest string, check_a long, check_b long, edited_digest string, edited_a long, edited_b long, near_edited double, near_next double"
_DONE = f"doc_id long, {_JUDGED}, packed binary"
_PASSED = f"{_DONE}, edge string, part int, text string, next_text string"
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in map(str.split, schema.split(","))])


def _judged(text: str, successor: str, digits: int) -> tuple:
    """What ``_JUDGED`` names, of a text."""
    half = len(text) // 2
    edited = text[: len(text) - half] + successor[:half]
    own, changed, other = (canonical(t).encode() for t in (text, edited, successor))
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(own, digits), *checks(own), digest(changed, digits), *checks(changed), likeness(own, changed), likeness(own, other)


def _in_order(batches: Iterator[pa.RecordBatch], digits: int) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order; kind 0 marks an id and hash whose digest is repeated. The first text goes
    out as an edge for the range before, the last one as an edge that waits for the range after."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    marked, held, first = object(), None, True
    schema = _arrow(_PASSED)
    blank = (None,) * len(_JUDGED.split(","))

    def packed(text, flag):
        return _packed(canonical(text).encode()) if flag else None

    for b in batches:
        out = []
        for doc_id, hash_, text, kind in zip(*columns(b, "doc_id", "hash", "text", "kind"), strict=True):
            if kind == 0:
                marked = (doc_id, hash_)
                continue
            if first:
                out.append((None, *blank, None, "first", part, text, None))
                first = False
            if held is not None:
                out.append((held[0], *_judged(held[1], text, digits), packed(*held[1:]), "", part, None, None))
            held = (doc_id, text, marked == (doc_id, hash_))
        yield batch(schema, *(zip(*out, strict=True) if out else [[]] * len(schema)))
    if held is not None:
        yield batch(schema, *zip((held[0], *blank, packed(*held[1:]), "last", part, held[1], None)))


def _edges(edges: DataFrame, digits: int) -> DataFrame:
    """The last document of every range, judged against the first one of the next range with rows."""
    firsts = edges.where("edge = 'first'")
    parts = firsts.select("part")
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    next_part = parts.select("part", after.alias("next_part"))
    pairs = (
        edges.where("edge = 'last'")
        .drop("next_text")
        .join(next_part, "part")
        .join(firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")
    )
    schema = _arrow(_DONE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *_judged(t, s, digits), p) for i, t, s, p in zip(*columns(b, "doc_id", "text", "next_text", "packed"), strict=True)]
            yield batch(schema, *(zip(*out, strict=True) if out else [[]] * len(schema)))

    return arrow_map(pairs.select("doc_id", "text", "next_text", "packed"), run, _DONE)
