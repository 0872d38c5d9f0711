"""Near-duplicate texts by the likeness of their word shingles: candidates from the Golay keys of SimHash
fingerprints and from min-hash keys, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graphs import components
from .frames import arrow_map, batch, columns, in_slices, unused, written
from . import simhash
from .simhash import _LOWER
from .tokens import per_worker

WORDS = 5
#: Jaccard likeness of two texts' shingle sets from which on they are near-duplicates.
LIKENESS = 0.8
#: Keys of a text, and the least hashes that make one. A pair at ``LIKENESS`` shares none of them with
#: probability (1 - 0.8 ** 5) ** 32 = 3e-6, a more alike pair with less.
KEYS, ROWS = 32, 5
SEED = 42
_SHINGLES_AT_ONCE, _HASHES_AT_ONCE = 2048, 1 << 20
#: Pairs of one node that follow each other in a task, about.
PAIRS = 2000
#: Shingles of the texts that one row holds on either side when all pairs of a key are compared.
BLOCK = 500_000
#: Rows up to which a table may be broadcast to where sets are.
FEW_ROWS = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lowered, as for the fingerprints of op6."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None) -> np.ndarray:
    """Digests (two 64-bit columns) of the text's different runs of ``WORDS`` words, in ascending order; of the whole sequence where there are fewer.

    Runs are hashed some at a time, so that a long text takes 16 bytes for each besides its words."""
    words = words_of(text)
    if not words:
        return np.zeros((0, 2), np.uint64)
    runs = map(b" ".join, zip(*(islice(words, i, None) for i in range(WORDS)))) if len(words) >= WORDS else iter([b" ".join(words)])
    parts = []
    while some := b"".join(map(xxhash.xxh3_128_digest, islice(runs, _SHINGLES_AT_ONCE))):
        parts.append(np.frombuffer(some, np.uint64).reshape(-1, 2))
    whole = np.concatenate(parts)
    whole = whole[np.lexsort((whole[:, 1], whole[:, 0]))]
    return whole[np.concatenate([[True], (whole[1:] != whole[:-1]).any(1)])]


def hashes_of(text: str | None) -> np.ndarray:
    """The first 64 bits of each different shingle's digest, as ascending signed numbers: the set that texts are compared by."""
    return np.unique(shingles(text)[:, 0].view(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard likeness of two sets (ascending) is ``LIKENESS`` or more; two without a shingle are alike."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if 5 * len(few) < 4 * len(many):
        return False
    if not len(many):
        return True
    both = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few)
    return bool(5 * both >= 4 * (len(a) + len(b) - both))  # 0.8, without rounding


class Sketch:
    """Digest of a text's shingle set, its size, its min-hash keys and its SimHash fingerprint (as a signed number)."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.factor = (rng.integers(0, 1 << 63, KEYS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.mask = rng.integers(0, 1 << 63, KEYS * ROWS, np.uint64)[:, None]
        self.place = rng.integers(0, 1 << 63, (KEYS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(0, 1 << 63, KEYS, np.uint64)

    def __call__(self, text: str | None) -> tuple[bytes, int, np.ndarray, int]:
        whole = shingles(text)
        if not len(whole):
            return bytes(16), 0, np.zeros(0, np.int64), 0
        hashes = whole[:, 0].copy()
        least = np.full(KEYS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
        set_ = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _SHINGLES_AT_ONCE):
            set_ += np.unpackbits(hashes[at : at + _SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            mixed = hashes[None, at : at + _SHINGLES_AT_ONCE] ^ self.mask
            mixed *= self.factor
            np.minimum(least, mixed.min(1), out=least)
        mixed = (least >> np.uint64(7) ^ least).reshape(KEYS, ROWS) * self.place
        keys = (mixed ^ mixed >> np.uint64(29)).sum(1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ self.band
        fp = np.packbits(2 * set_ > len(hashes)).view(np.int64)
        return xxhash.xxh3_128_digest(whole.tobytes()), len(whole), keys.view(np.int64), int(fp[0])


class Classes:
    """Disjoint sets of nodes, joined as links are found."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, node: int) -> int:
        parent = self.parent
        parent.setdefault(node, node)
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.top(a), self.top(b)
        self.parent[a] = b
        return a != b


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(texts: DataFrame) -> DataFrame:
    """node and hashes of ``texts`` (node and text)."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def packed(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, sets)])
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, held = [], [], 0
        for b in in_slices(batches):
            for node, text in zip(*columns(b, "node", "text"), strict=True):
                nodes.append(node)
                sets.append(hashes_of(text))
                held += len(sets[-1])
                if held >= _HASHES_AT_ONCE:
                    yield packed(nodes, sets)
                    nodes, sets, held = [], [], 0
        if nodes:
            yield packed(nodes, sets)

    return written(arrow_map(texts, run, "node long, hashes array<long>"), "sets")


def _counted(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and merged with what it is joined to if it has many rows: Spark would size rows that an explode makes as those they come
    from, and a table of repeated values as its small files."""
    df = written(df, name)
    return df if df.count() <= FEW_ROWS else df.hint("merge")


def _rows(b: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The lists of a column, without a copy."""
    lists = b.column(name)
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    for i in range(len(lists)):
        yield flat[ends[i] : ends[i + 1]]


def _verified(pairs: DataFrame, sets: DataFrame, most: int = PAIRS) -> DataFrame:
    """Links that join what the alike pairs among ``pairs`` (a, b) join. ``sets`` has node and hashes.

    The pairs of one a follow each other in a task, after its set, which therefore moves and is held once; an a with more than ``most``
    pairs is dealt to several tasks. A pair whose ends a task has joined already is not looked at, so a task gives a forest of its nodes.
    """
    large = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > most).select("a", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    dealt = pairs.join(written(large, "large"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("slices", F.lit(1))).cast("int").alias("slice"))
    dealt = _counted(dealt, "dealt")
    of_a = dealt.select("a", "slice").distinct().join(sets, F.col("a") == F.col("node")).select("a", "slice", F.lit(0).alias("kind"), "node", "hashes")
    of_b = dealt.join(sets, F.col("b") == F.col("node")).select("a", "slice", F.lit(1).alias("kind"), "node", "hashes")
    rows = of_a.unionByName(of_b).repartition("a", "slice").sortWithinPartitions("a", "slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, own = Classes(), None
        for b in batches:
            kept = []
            for a, kind, node, hashes in zip(*columns(b, "a", "kind", "node"), _rows(b, "hashes"), strict=True):
                if not kind:
                    own = hashes.copy()
                elif classes.top(a) != classes.top(node) and alike(own, hashes):
                    classes.join(a, node)
                    kept.append((a, node))
            yield batch(_EDGES, *(zip(*kept, strict=True) if kept else [[], []]))

    return written(arrow_map(rows, run, "a long, b long"), "verified")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node and class for the members of those keys that have more than one class yet."""
    placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("class"))
    several = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    return written(placed.join(written(several, "several"), "key", "left_semi"), "open")


def _dealt(open_: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """key, i, j, node, class and left: the members of each key in blocks that meet in pairs.

    A key's largest class is settled in itself, so what is compared are the others, among themselves
    and with it. Blocks are numbered from those of the others on, and hold about ``block`` shingles each.
    """
    sized = written(open_.join(sizes, "node"), "sized")
    of_class = sized.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    of_key = of_class.groupBy("key").agg(F.max(F.struct("n", "class", "size")).alias("most"), F.sum("size").alias("all"))
    blocks = lambda size: F.ceil(size / block).cast("int")
    of_key = of_key.select("key", F.col("most.class").alias("settled"), blocks(F.col("all") - F.col("most.size")).alias("others"), blocks(F.col("most.size")).alias("settled_blocks"))
    each = sized.join(written(of_key, "keys"), "key").withColumn("other", F.col("class") != F.col("settled"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = each.withColumn("own", F.when(F.col("other"), deal(F.col("others"))).otherwise(F.col("others") + deal(F.col("settled_blocks"))))
    met = F.sequence(F.lit(0), F.when(F.col("other"), F.col("others") + F.col("settled_blocks")).otherwise(F.col("others")) - 1)
    each = each.withColumn("with", F.explode(met))
    return each.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "class", (F.col("own") <= F.col("with")).alias("left"))


def _forest(nodes: list[int], kinds: list[int], left: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what all alike pairs of different classes join: one of the left side with one of
    the right, or, where all are on the left, any two. No more come out than there are nodes."""
    order = np.argsort(np.array(left, bool), kind="stable")  # the right side first
    right = int((~np.array(left, bool)).sum())
    against = order[:right] if right else order
    vocabulary, place = np.unique(np.concatenate([sets[i] for i in against]), return_inverse=True)
    by_shingle = np.argsort(place, kind="stable")
    first = np.searchsorted(place[by_shingle], np.arange(len(vocabulary) + 1))
    sizes = np.array([len(s) for s in sets])
    holder = np.repeat(np.arange(len(against)), sizes[against])[by_shingle]
    classes = Classes()
    out = []
    for i in order[right:] if right else order:
        at = np.minimum(np.searchsorted(vocabulary, sets[i]), len(vocabulary) - 1)
        at = at[vocabulary[at] == sets[i]]
        n = first[at + 1] - first[at]
        both = np.bincount(holder[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(against))
        for j in against[5 * both >= 4 * (sizes[i] + sizes[against] - both)].tolist():
            if classes.join(kinds[i], kinds[j]):
                out.append((nodes[i], nodes[j]))
    return out


def _compared(open_: DataFrame, sizes: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (a, b) between classes of a key, found from the sets of their members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                members = b.column("members").slice(i, 1).flatten()
                node, kind, left = (members.field(n).to_pylist() for n in ("node", "class", "left"))
                lists = members.field("hashes")
                flat, ends = lists.flatten().to_numpy(), np.cumsum(np.asarray(lists.value_lengths()))
                found = _forest(node, kind, left, np.split(flat, ends[:-1]))
                yield batch(_EDGES, *(zip(*found, strict=True) if found else [[], []]))

    met = _counted(_dealt(open_, sizes, block), "met").join(sets, "node")
    rows = met.groupBy("key", "i", "j").agg(F.collect_list(F.struct("node", "class", "left", "hashes")).alias("members")).select("members")
    return written(arrow_map(rows, run, "a long, b long"), "compared")


def _near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that join all nodes whose fingerprints differ in at most ``simhash.BITS`` bits: a fingerprint's
    nodes with the least of them, and those with the least of a linked fingerprint's."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("a")), "least")
    same = nodes.join(least, "fp").where("node <> a").select("a", F.col("node").alias("b"))
    edges = written(simhash.links(least.select("fp")), "near").select(F.col("a").alias("fp"), F.col("b").alias("fp_b"))
    of_b = least.select(F.col("fp").alias("fp_b"), F.col("a").alias("b"))
    return same.unionByName(edges.join(least, "fp").join(of_b, "fp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def _near_sizes(a: str, b: str) -> Column:
    """Whether sets of these sizes can be alike."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def links(nodes: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose connected components are those of all alike pairs that share a key.

    ``nodes`` has node, size, fp and keys, ``texts`` node and text, each node once. Candidates are, first, the links of
    SimHash fingerprints that Golay keys find: pairs of nearly equal texts. A pair at ``LIKENESS`` differs in about 10
    bits, too many for these keys, so every text is also held against the least node of each of its
    min-hash keys. Then, in keys that still have several classes, texts of other classes are held against another node;
    that joins the bulk of a large class in a few pairs for each member. In keys that have
    several classes even then, every text outside the largest class is compared with all others where
    blocks of them meet, and what comes out of two blocks is a forest, never all pairs. Every link is verified.
    """
    posted = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.min(F.struct("node", "size")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = written(posted.join(written(shared, "shared").hint("merge"), "key").select("key", F.col("leader.node").alias("leader"), F.col("leader.size").alias("leader_size"), "node", "size"), "members")
    star = members.where((F.col("node") != F.col("leader")) & _near_sizes("size", "leader_size")).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    star = written(star.unionByName(_near_fingerprints(nodes)).distinct(), "star")
    # what can be compared with any shares a key or a near fingerprint; only these sets are made, and only they move from here on
    paired = members.select("node").unionByName(star.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets, sizes = _sets(texts.join(paired, "node", "left_semi")), nodes.select("node", "size")
    found = _verified(star, sets)
    open_ = _open(members, components(found))
    leaders = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("by"), "node", "class")).alias("leader"))
    again = open_.join(written(leaders, "leaders"), "key").where("class <> leader.class").select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()
    again = again.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("size_b")), "b").where(_near_sizes("size_a", "size_b")).select("a", "b")
    found = written(found.unionByName(_verified(written(again, "again"), sets)), "found")
    return found.unionByName(_compared(_open(members, components(found)), sizes, sets, block))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each class of alike texts stays, that of the least id, with all its columns.

    Texts of equal shingle sets are brought to one node before keys are compared. Null texts are empty
    and alike; null ids come after all others; documents are written once with row numbers, so that even
    rows equal in every column are told apart. A very long text is hashed some shingles at a time; what is held and compared
    of it are 8 bytes for each different shingle.
    """
    names = docs.columns
    digest, size, keys, fp, row = (unused(names, n) for n in ("digest", "size", "keys", "fp", "row"))
    schema = T.StructType([*docs.schema.fields, T.StructField(digest, T.BinaryType()), T.StructField(size, T.LongType()), T.StructField(keys, T.ArrayType(T.LongType())), T.StructField(fp, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = per_worker(Sketch)
        for b in in_slices(batches):
            found = [sketch(t) for t in b.column("text").to_pylist()]
            for name, values, kind in zip((digest, size, keys, fp), zip(*found, strict=True), (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True):
                b = b.append_column(name, pa.array(values, kind))
            yield b

    marked = written(arrow_map(docs, run, schema).withColumn(row, F.monotonically_increasing_id()), "marked")
    rows = marked.select(F.col(digest).alias("digest"), F.col(row).alias("row"), F.col(size).alias("size"), F.col(keys).alias("keys"), F.col(fp).alias("fp"), "doc_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    nodes = rows.groupBy("digest").agg(F.min("row").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.min(order).alias("first"))
    nodes = written(nodes.select("node", "size", "keys", "fp", "first"), "nodes")
    texts = marked.select(F.col(row).alias("node"), F.col("text"))
    roots = components(links(nodes, texts, block))
    stay = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("first")["row"].alias(row)).select(row)
    return marked.join(stay, row, "left_semi").select(*[F.col(f"`{n}`") for n in names])
