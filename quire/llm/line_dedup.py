"""Lines that many documents repeat, dropped by keep bitmaps, in DataFrame functions only.

Hashes of lines are partitioned by range and sorted by document and position, so that each key's lines stream by with the
document that keeps them first; what comes back to a document is a bitmap of its lines, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import ascii_lower, let
from .frames import unused, written

#: Code points of a key, and documents that hold it, from which on its lines are dropped.
LEAST_LENGTH, LEAST_DOCUMENTS = 40, 5
#: Lines of one key that stream together, about; a key with more is dealt to several slices, at the cost of a row each.
SLICE = 1000
_SPACE = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keys_of(text: Column, least: int = LEAST_LENGTH) -> Column:
    """(a, b, pos, first) of each line whose key has ``least`` code points: 128 bits of hash, and whether
    it is the text's first line of that key. Each step is an array of its own, so that no lambda computes a thing twice."""
    trimmed = F.transform(lines_of(text), lambda line, i: F.struct(F.trim(line, F.lit(_SPACE)).alias("key"), i.alias("pos")))
    long = F.filter(trimmed, lambda x: F.length(x["key"]) >= least)
    lowered = F.transform(long, lambda x: F.struct(ascii_lower(x["key"]).alias("key"), x["pos"].alias("pos")))
    hashed = F.transform(lowered, lambda x: F.struct(F.xxhash64(x["key"]).alias("a"), F.xxhash64(F.lit(1), x["key"]).alias("b"), x["pos"].alias("pos")))

    def marked(keys: Column) -> Column:
        same = lambda x, y: x["a"].eqNullSafe(y["a"]) & x["b"].eqNullSafe(y["b"])
        return F.transform(keys, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["pos"].alias("pos"), (~same(x, F.get(keys, i - 1))).alias("first")))

    return let(F.array_sort(hashed), marked)


def bitmap(positions: Column) -> Column:
    """The keep bitmap of a text that loses the lines at ``positions`` (ascending), as runs: the line numbers where
    keeping changes to dropping and back. Nothing is dropped where it is empty."""

    def runs(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i - 1) == x - 1, F.lit(False)))
        ends = F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i + 1) == x + 1, F.lit(False)))
        return F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e + 1)))

    return let(positions, runs)


def dropped_lines(keep: Column) -> Column:
    """The number of lines that a bitmap drops."""
    return F.aggregate(F.transform(keep, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps, joined again: a slice of lines for each kept run."""

    def kept(x: Column) -> Column:
        lines, flips = x["lines"], x["keep"]
        end = lambda i: F.coalesce(F.get(flips, 2 * i), F.size(lines))
        start = lambda i: F.coalesce(F.get(flips, 2 * i - 1), F.lit(0))
        runs = F.transform(F.sequence(F.lit(0), (F.size(flips) / 2).cast("int")), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i)))
        return F.array_join(F.flatten(runs), "\n")

    return F.when(F.size(keep) == 0, F.coalesce(text, F.lit(""))).otherwise(let(F.struct(lines_of(text).alias("lines"), keep.alias("keep")), kept))


def _bitmaps(marked: DataFrame, least_documents: int, slice_rows: int) -> DataFrame:
    """row and keep of the documents that lose a line. ``marked`` has row, doc_id and keys."""
    lines = marked.select("row", "doc_id", F.inline("keys"))
    repeated = lines.groupBy("a", "b").agg(F.sum(F.col("first").cast("long")).alias("documents"), F.count("*").alias("n"))
    repeated = repeated.where(F.col("documents") >= least_documents).select("a", "b", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    # written, so that the lines of a key that is everywhere can be split when they meet it
    met = lines.drop("first").join(written(repeated, "repeated"), ["a", "b"]).withColumn("slice", F.pmod(F.xxhash64("row"), "slices").cast("int"))
    # range bounds are sampled, so what they are taken from is written
    dealt = written(met, "met").repartitionByRange("a", "b", "slice")
    stream = Window.partitionBy("a", "b", "slice").orderBy(F.desc_nulls_last("doc_id"), "pos")
    streamed = written(dealt.withColumn("keeper", F.first("doc_id").over(stream)), "streamed")
    whole = streamed.where("slices = 1").select("row", "pos", "doc_id", "keeper")
    split = streamed.where("slices > 1")
    of_key = split.groupBy("a", "b", "slices").agg(F.max("keeper").alias("keeper"))
    of_slice = of_key.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "keeper")
    rest = split.drop("keeper").join(of_slice, ["a", "b", "slice"]).select("row", "pos", "doc_id", "keeper")
    lost = whole.unionByName(rest).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("row").agg(bitmap(F.sort_array(F.collect_list("pos"))).alias("keep"))


def _marked(docs: DataFrame, row: str, keys: str, least_length: int) -> DataFrame:
    """The documents with row numbers and the keys of their lines, written once."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(keys, keys_of(F.col("text"), least_length)), "marked")


def _found(marked: DataFrame, row: str, keys: str, least_documents: int, slice_rows: int) -> DataFrame:
    return _bitmaps(marked.select(F.col(row).alias("row"), "doc_id", F.col(keys).alias("keys")), least_documents, slice_rows)


_NOTHING = "cast(array() as array<int>)"


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, slice_rows: int = SLICE) -> DataFrame:
    """For each document doc_id, n_lines, n_dropped and keep (see ``bitmap``); no text moves.

    A line's key is the line without ASCII white space at its ends, A-Z lowered. Keys of ``least_length`` code points that
    ``least_documents`` documents hold lose all lines but those of the largest doc_id.

    Every row is a document, repeated rows too, so all rows of the largest id keep their lines. A null id is less than any other.
    A null or empty text is one empty line; an empty table gives no rows; columns other than doc_id and text are ignored. A text of any
    length is one array of its lines; keys of any frequency are dealt to tasks in slices of ``slice_rows`` lines.
    """
    marked = _marked(docs.select("doc_id", "text", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")), "row", "keys", least_length)
    keep = F.coalesce("keep", F.expr(_NOTHING))
    return marked.select("row", "doc_id", "n_lines").join(_found(marked, "row", "keys", least_documents, slice_rows), "row", "left").select("doc_id", "n_lines", dropped_lines(keep).alias("n_dropped"), keep.alias("keep"))


def drop_repeats(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, slice_rows: int = SLICE) -> DataFrame:
    """The documents, with all their columns, without the lines that ``keep_bitmaps`` drops, and with n_lines (before) and n_dropped.

    Rules and odd rows are those of ``keep_bitmaps``; a null text becomes empty. Columns that have the names n_lines or n_dropped give way to the new ones.
    """
    names = [n for n in docs.columns if n.lower() not in ("n_lines", "n_dropped")]
    row, keys, kept = (unused(docs.columns, n) for n in ("row", "keys", "keep"))
    marked = _marked(docs.select(*[F.col(f"`{n}`") for n in names]), row, keys, least_length)
    found = _found(marked, row, keys, least_documents, slice_rows).select(F.col("row").alias(row), F.col("keep").alias(kept))
    keep = F.coalesce(kept, F.expr(_NOTHING))
    columns = [kept_text(F.col("text"), keep).alias(n) if n.lower() == "text" else F.col(f"`{n}`") for n in names]
    return marked.drop(keys).join(found, row, "left").select(*columns, F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), dropped_lines(keep).alias("n_dropped"))
