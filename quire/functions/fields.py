"""Typed values found in running text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that Java's and RE2's regular expressions read alike.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "card": r"\b[0-9]{13,16}\b",
    "phone": r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b",
    "token": r"""token = "[0-9a-f]{40}\"""",
    "licence": r"(?i)(?:released|licensed) under (?:the )?[A-Za-z0-9.-]+",
}


#: What every text with a value of the kind holds; cheaper to look for than the pattern.
_HOLDS = {"email": ["@"], "ipv4": ["."], "token": ['token = "'], "licence": [" under "]}
#: The kinds whose values are masked, in this order.
MASKED = ("email", "token", "ipv4", "card", "phone")


def may_hold(text: Column, kind: str) -> Column:
    """False only for texts without a value of the kind."""
    if kind in _HOLDS:
        return reduce(and_, [F.contains(text, F.lit(x)) for x in _HOLDS[kind]])
    return F.rlike(text, F.lit("[0-9]{3}"))


def masked(text: Column, kinds: tuple[str, ...] = MASKED) -> Column:
    """The text with every value of the kinds replaced by the kind's name in brackets."""
    for kind in kinds:
        text = F.when(may_hold(text, kind), F.regexp_replace(text, PATTERNS[kind], f"[{kind.upper()}]")).otherwise(text)
    return text


def find(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    may = may_hold(text, kind)
    return F.when(may, found).when(~may, F.array().cast("array<string>"))  # null for a null text


def holds(text: Column, kind: str) -> Column:
    """Whether the text has a value of the kind."""
    return may_hold(text, kind) & F.rlike(text, F.lit(PATTERNS[kind]))


def is_valid(kind: str, value: Column) -> Column:
    """Luhn for card numbers, octets up to 255 for addresses; other kinds are valid as found."""
    if kind == "card":
        return F.call_function("luhn_check", value)
    if kind == "ipv4":
        return F.forall(F.split(value, "\\."), lambda part: part.cast("int") <= 255)
    return F.lit(True)
