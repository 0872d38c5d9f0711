"""Columns read out of raw HTML with JVM regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The named entities decoded here. The ampersand comes last, so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&amp;": "&"}


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def language(html: Column) -> Column:
    return F.lower(F.regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def link_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit("(?i)<a[ >]")).cast("long")


def decoded(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), text)


def visible_text(html: Column) -> Column:
    """The text of a page or fragment. Comments, scripts and styles go before tags, as a script
    may hold text that looks like a tag; what is left has its white space folded."""
    for pattern in ("(?s)<!--.*?-->", "(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(decoded(html), "[ \\t\\r\\n]+", " "))


def article(html: Column) -> Column:
    """The inner HTML of the first article element, scripts and comments removed; else empty."""
    for pattern in ("(?s)<!--.*?-->", "(?is)<script.*?</script>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.regexp_extract(html, "(?is)<article[^>]*>(.*?)</article>", 1)
