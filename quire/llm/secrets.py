"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let
from .frames import unused, written

_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
_BETWEEN = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"
#: Kinds in their order. A run of a class matches as a whole, so a least length inside the
#: pattern drops exactly the runs that are too short; that isn't so for ``assign``, whose
#: matches are found first and dropped after.
ASSIGN, ACCESS, HEX, COPY = "assign", "access", "hex", "copy"
KINDS = (ASSIGN, ACCESS, HEX, COPY)
PATTERNS = {
    ASSIGN: f"{_KEYWORD}{_BETWEEN}{_VALUE}",
    ACCESS: "AKIA[A-Z0-9]{16,}",
    HEX: "[0-9a-f]{24,}",
    COPY: "[A-Za-z0-9+/_.=-]{16,}",
}
_ASSIGN_VALUE = f"^{_KEYWORD}{_BETWEEN}({_VALUE})"
LEAST_ASSIGNED = 6
#: A value under so many owners is an example that has been copied around.
COPIED_OWNERS = 3
#: What a live-looking value needs: characters, and different characters.
LIVE_LENGTH, LIVE_DIFFERENT = 16, 8
MASK = "[SECRET]"

#: Values of a run that are merged one by one; code points of a block of a text that is masked.
_RUN, _BLOCK = 1024, 4096
_SPAN = "array<struct<start:long,rank:int,end:long,value:string>>"


def _worth(text: Column, kind: str) -> Column:
    """A cheap test that every text with a candidate of the kind passes."""
    if kind == ASSIGN:
        separated = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
        return separated & F.rlike(text, F.lit(f"{_KEYWORD}{_BETWEEN}[A-Za-z0-9+/_.=-]"))
    if kind == ACCESS:
        return F.contains(text, F.lit("AKIA"))
    if kind == HEX:
        return F.rlike(text, F.lit("[0-9a-f]{24}"))
    # of 16 characters with a digit among them, 8 lie to one side of the digit
    return F.rlike(text, F.lit("[0-9][A-Za-z0-9+/_.=-]{8}|[A-Za-z0-9+/_.=-]{8}[0-9]"))


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Each of these longs merged with all before it; ``merge`` leaves nulls out.

    An array that grows by one is copied, so values are gone through in runs of ``_RUN``, then the runs' last values, and
    what comes before a run is merged into it at the end."""
    none = F.expr("cast(array() as array<bigint>)")
    last = lambda x: F.get(x, F.size(x) - 1)
    through = lambda x, of: F.aggregate(x, none, lambda so_far, v: F.concat(so_far, F.array(merge(last(so_far), of(v)))))
    runs = lambda x: F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / _RUN).cast("int")), lambda i: through(F.slice(x, i * _RUN + 1, _RUN), lambda v: v))
    joined = lambda r: let(through(r, last), lambda before: F.flatten(F.transform(r, lambda run, i: F.transform(run, lambda v: merge(F.get(before, i - 1), v)))))
    return let(values, lambda x: let(runs(x), joined))


def _sum(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind as (start, rank, end, value), in code points.

    The matches and the pieces between them alternate, so a match ends after the pieces and matches up to it.
    """
    pattern = PATTERNS[kind]
    value = (lambda m: F.regexp_extract(m, _ASSIGN_VALUE, 1)) if kind == ASSIGN else (lambda m: m)
    length = lambda c: F.length(c).cast("long")

    def spans(x: Column) -> Column:
        ends = _running(F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["matches"])), x["matches"], lambda p, m: length(p) + length(m)), _sum)
        placed = lambda e: F.transform(
            x["matches"], lambda m, i: F.struct((F.get(e, i) - length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.get(e, i).alias("end"), value(m).alias("value"))
        )
        return let(ends, placed)

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(_worth(text, kind), let(parts, spans)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def candidates(text: Column) -> list[Column]:
    """Columns assign, access, hex and copy: the spans of each kind. ``copy`` holds bare strings that
    could be a credential which is given with its keyword elsewhere."""
    assign = F.filter(_found(text, ASSIGN), lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    bare = F.filter(_found(text, COPY), lambda s: live_looking(s["value"]))
    return [assign.alias(ASSIGN), _found(text, ACCESS).alias(ACCESS), _found(text, HEX).alias(HEX), bare.alias(COPY)]


def live_looking(value: Column) -> Column:
    """Long, of letters and digits, and not of few characters over and over."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= LIVE_DIFFERENT)


def owner_of(repository: Column) -> Column:
    """The owner of a repository named owner/name; a name without a slash is its own owner."""
    return F.substring_index(repository, "/", 1)


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate's hash: docs, repositories and owners that have it, and its class.

    ``found`` has row, value, rank and repository for each candidate span. Rows are first brought to one
    for each hash and repository by partial aggregation, so a value that is everywhere is
    a row a task and repository. Bare strings count where a keyword or pattern has found the same value somewhere.

    Classes: ``example`` (at least ``COPIED_OWNERS`` owners), else ``live`` (looks like a
    credential), else ``weak``.
    """
    hashed = found.withColumn("hash", F.sha2("value", 256))
    live = live_looking(F.col("value"))
    each = hashed.groupBy("hash", "repository").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("rank") < KINDS.index(COPY), 1).otherwise(0)).alias("based"), F.max(live.cast("int")).alias("live")
    )
    owner = owner_of(F.coalesce("repository", F.lit("")))
    by_owner = each.groupBy("hash", owner.alias("owner")).agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.max("based").alias("based"), F.max("live").alias("live"))
    total = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"), F.max("based").alias("based"), F.max("live").alias("live"))
    kind = F.when(F.col("owners") >= COPIED_OWNERS, "example").when(F.col("live") == 1, "live").otherwise("weak")
    return total.where("based = 1").select("hash", "owners", "repositories", "occurrences", kind.alias("class"))


def _text_of(spans: Column) -> Column:
    named = lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, named), ",")


def _ordered(*spans: Column) -> Column:
    """By start, then kind; spans of one kind never start together."""
    return F.array_sort(F.concat(*spans))


def _scanned(docs: DataFrame, extra: list[Column]) -> DataFrame:
    """row, repository, the four span columns, and ``extra``, for every document; without texts."""
    repository = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"), repository.alias("repository"), *candidates(_text(docs)), *extra)


def _classified(scanned: DataFrame) -> DataFrame:
    """row, spans: every candidate span with its class, of the rows that have any; a bare string
    stays where its value is owner-specific and is not inside a span of another kind."""
    spans = F.concat(ASSIGN, ACCESS, HEX, COPY)
    each = scanned.where(F.size(spans) > 0).select("row", "repository", F.explode(spans).alias("span"))
    each = each.select("row", "repository", F.col("span.start").alias("start"), F.col("span.rank").alias("rank"), F.col("span.end").alias("end"), F.col("span.value").alias("value"))
    # written, so that the rows of a value that is everywhere can be split when they meet it
    known = written(ownership(each), "known")
    judged = each.withColumn("hash", F.sha2("value", 256)).join(known, "hash")
    judged = judged.where((F.col("rank") < KINDS.index(COPY)) | (F.col("class") == "live"))
    return judged.select("row", F.struct("start", "rank", "end", "class", "owners", "hash").alias("span")).groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _added(spans: Column) -> Column:
    """Bare strings that overlap no span of another kind. In order of start, a string overlaps one that begins no later
    if the furthest end of those so far is beyond its start, and one that begins later if the next start is before its end."""
    copy = KINDS.index(COPY)

    def alone(s: Column) -> Column:
        none = F.lit(None).cast("long")
        furthest = _running(F.transform(s, lambda x: F.when(x["rank"] < copy, x["end"]).otherwise(none)), F.greatest)
        following = F.reverse(_running(F.transform(F.reverse(s), lambda x: F.when(x["rank"] < copy, x["start"]).otherwise(none)), F.least))
        apart = lambda x, i, e: (x["rank"] == copy) & F.coalesce(F.get(e["furthest"], i) <= x["start"], F.lit(True)) & F.coalesce(F.get(e["following"], i) >= x["end"], F.lit(True))
        return let(F.struct(furthest.alias("furthest"), following.alias("following")), lambda e: F.filter(s, lambda x, i: apart(x, i, e)))

    return let(F.array_sort(spans), alone)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example and found (the spans with class, owners and value hash).

    Base spans are those of the three patterns. Every value found is counted over the corpus
    by the repositories (``source``) and owners that have it: a value of many owners is a
    copied example, one that few have and that looks like a credential is live. A bare
    string elsewhere whose value is live is added as kind ``copy``.

    A null text is empty; a null source is an owner of its own; null ids and repeated rows are
    kept; an empty table gives no rows; columns other than doc_id, text and source are ignored. A text with n spans is taken
    in runs, so that neither it nor its array of spans is copied for each of them.
    """
    scanned = written(_scanned(docs, [F.col("doc_id")]), "scanned")
    spans = _classified(scanned)
    base = _ordered(F.col(ASSIGN), F.col(ACCESS), F.col(HEX))
    none = F.expr("cast(array() as array<struct<start:long,rank:int,end:long,class:string,owners:long,hash:string>>)")
    rows = scanned.join(spans, "row", "left").withColumn("found", F.coalesce("spans", none)).withColumn("base", base)
    based = F.filter("found", lambda s: s["rank"] < KINDS.index(COPY))
    rows = rows.withColumn("found", F.array_sort(F.concat(based, _added(F.col("found")))))
    count = lambda name: F.size(F.filter("found", lambda s: s["class"] == name)).cast("long")
    return rows.select(
        "doc_id",
        F.size(ASSIGN).cast("long").alias("n_assign"),
        F.size(ACCESS).cast("long").alias("n_access"),
        F.size(HEX).cast("long").alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.col("found")).alias("spans"),
        count("live").alias("n_live"),
        count("example").alias("n_example"),
        "found",
    )


def redact(docs: DataFrame, weak: bool = False) -> DataFrame:
    """The documents with every live-looking secret replaced by ``MASK``; copied examples stay, and
    weak values do unless ``weak``, which masks every span of the three patterns but copied examples. ``n_chars``, if there, is brought up to date; other columns are kept.

    Documents with candidates are written once with row numbers, so that a row's spans find it again. A null text
    stays null; null ids, repeated rows and columns of any name are kept; an empty table gives no rows.
    """
    names = docs.columns
    row = unused([*names, "row", "repository", *KINDS, "spans"], "_row")
    own, changed_text = unused([*names, row], "_spans"), unused([*names, row], "_text")
    some = reduce(or_, [_worth(_text(docs), kind) for kind in KINDS])
    marked = written(docs.where(some).withColumn(row, F.monotonically_increasing_id()), "marked")
    scanned = marked.select(F.col(row).alias("row"), (F.col("source").cast("string") if "source" in names else F.lit(None).cast("string")).alias("repository"), *candidates(_text(marked)))
    masked_classes = ["live", "weak"] if weak else ["live"]  # a bare string is never weak
    live = _classified(written(scanned, "scanned"))
    live = live.select(F.col("row").alias(row), F.filter(F.concat(F.filter("spans", lambda s: s["rank"] < KINDS.index(COPY)), _added(F.col("spans"))), lambda s: s["class"].isin(masked_classes)).alias(own))
    joined = marked.join(live.where(F.size(own) > 0), row, "left")
    hit = F.col(own).isNotNull()
    masked = joined.withColumn(changed_text, _masked(F.col("text"), F.array_sort(own)))
    changed = {"text": F.when(hit, F.col(changed_text)).otherwise(F.col("text"))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(hit, F.length(changed_text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    out = masked.select(*[changed.get(n, F.col(f"`{n}`")).alias(n) for n in names])
    return docs.where(~some).unionByName(out)


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from one code point to another, out of its blocks of ``_BLOCK``: it is never gone through from its beginning."""
    first, last = (start / _BLOCK).cast("int"), (end / _BLOCK).cast("int")
    at = lambda x: (x % _BLOCK + 1).cast("int")
    nothing = F.lit("")
    inside = F.substr(F.coalesce(F.get(blocks, first), nothing), at(start), (end - start).cast("int"))
    across = F.concat(F.substr(F.coalesce(F.get(blocks, first), nothing), at(start)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substr(F.coalesce(F.get(blocks, last), nothing), F.lit(1), (end % _BLOCK).cast("int")))
    return F.when(first == last, inside).otherwise(across)


def _masked(text: Column, spans: Column) -> Column:
    """The text with the union of the spans replaced; spans are in order of their start, null where there are none."""

    def pieces(x: Column) -> Column:
        # a span that begins within those before it belongs to their mask
        before = lambda i: F.coalesce(F.get(x["ends"], i - 1), F.lit(0).cast("long"))
        each = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(_between(x["blocks"], before(i), s["start"]), F.lit(MASK))).otherwise(""))
        return F.concat(F.array_join(each, ""), _between(x["blocks"], before(F.size(x["spans"])), x["n"]))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(spans.isNotNull(), let(F.struct(spans.alias("spans"), blocks.alias("blocks"), ends.alias("ends"), F.length(text).cast("long").alias("n")), pieces))
