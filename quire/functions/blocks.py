"""Pages in blocks, each judged by its words, its links and its neighbours, with JVM functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pages import decoded

#: Elements that begin or end a block, and those whose blocks are never content.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|tr|ul"
REGIONS = "aside|footer|nav"
#: What goes before a page is cut.
HIDDEN = ("(?s)<!--.*?-->", "(?is)<script.*?</script>", "(?is)<style.*?</style>", r"(?is)<head(\s[^>]*)?>.*?</head>")
#: Fixed values, published with the shallow text features: a block's own and the preceding block's greatest share
#: of words in links, and the words of the block, the following and the preceding one that are few.
LINKED, LINKED_BEFORE, FEW, FEW_AFTER, FEW_BEFORE, FEW_AFTER_LINKS, NEXT_AFTER_LINKS = 1 / 3, 5 / 9, 16, 15, 4, 40, 17


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, "(?s)<[^>]*>", " ")), "[ \\t\\r\\n]+", " "))


def _n_words(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long")


def _cut(html: Column) -> Column:
    """The page's pieces between block elements, each with whether a region holds it. A region ends
    where it is closed, where another begins, or with the page."""
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, " ")
    marked = F.regexp_replace(html, rf"(?i)(<({REGIONS})(\s[^>]*)?>)", "\u0002$1")
    marked = F.regexp_replace(marked, rf"(?i)(</({REGIONS})\s*>)", "$1\u0002")
    segments = F.split(marked, "\u0002")
    pieces = lambda s: F.split(s, rf"(?i)</?({BLOCKS})(\s[^>]*)?/?>")
    return F.flatten(F.transform(segments, lambda s: F.transform(pieces(s), lambda p: F.struct(p.alias("html"), F.rlike(s, F.lit(rf"(?i)^<({REGIONS})[\s>]")).alias("region")))))


def _measured(piece: Column) -> Column:
    links = F.regexp_extract_all(piece["html"], F.lit(r"(?is)<a(\s[^>]*)?>(.*?)</a>"), F.lit(2))
    linked = F.aggregate(links, F.lit(0).cast("long"), lambda n, a: n + _n_words(_plain(a)))
    text = _plain(piece["html"])
    return F.struct(text.alias("text"), piece["region"].alias("region"), linked.alias("linked"))


def _judged(block: Column, before: Column, after: Column) -> Column:
    share, words = lambda b: F.coalesce(b["share"], F.lit(0.0)), lambda b: F.coalesce(b["words"], F.lit(0))
    lonely = (words(block) <= FEW) & (words(after) <= FEW_AFTER) & (words(before) <= FEW_BEFORE)
    after_links = (words(block) <= FEW_AFTER_LINKS) & (words(after) <= NEXT_AFTER_LINKS)
    furniture = F.when(share(before) <= LINKED_BEFORE, lonely).otherwise(after_links)
    return ~block["region"] & (share(block) <= LINKED) & ~furniture


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``key`` and ``blocks``, a page's blocks that have text, in order: ``text words share region content``.

    ``share`` is that of the words in links closed within the block; ``content`` is false in navigation, footers and
    asides, and where links prevail or a short block stands among short ones or after links. A page that is null
    or has no text has no blocks. Linear in a page's length, one row in and one out, no shuffle.
    """
    cut = pages.select(F.col(key), F.coalesce(_cut(F.col(html)), F.array().cast("array<struct<html:string,region:boolean>>")).alias("_pieces"))
    measured = cut.select(key, F.filter(F.transform("_pieces", _measured), lambda b: b["text"] != "").alias("_measured"))
    counted = lambda b: F.struct(b["text"], _n_words(b["text"]).alias("words"), (b["linked"] / _n_words(b["text"])).alias("share"), b["region"])
    shared = measured.select(key, F.transform("_measured", counted).alias("_blocks"))
    of = F.col("_blocks")
    # Neighbours are zipped in, not looked up: a filter that is pushed down would repeat the whole cut at every look.
    beside = F.zip_with(F.concat(F.array(F.lit(None)), of), F.slice(of, 2, F.greatest(F.size(of), F.lit(1))), lambda p, n: F.struct(p.alias("before"), n.alias("after")))
    judged = lambda b, p: F.struct(b["text"], b["words"], b["share"], b["region"], _judged(b, p["before"], p["after"]).alias("content"))
    return shared.select(key, F.filter(F.zip_with(of, beside, lambda b, p: F.when(b.isNotNull(), judged(b, p))), lambda b: b.isNotNull()).alias("blocks"))
