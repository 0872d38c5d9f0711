"""Character references of HTML, decoded in one pass."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference by decimal or hexadecimal number, or by name; the semicolon may be missing.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACEMENT = "�"
_LAST = 0x10FFFF


def _c1(n: int) -> str:
    """What a number of the C1 controls stands for: the character of that byte in the Windows code page, where it has one."""
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def _character(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def _numbered(n: Column) -> Column:
    c1 = F.array(*[F.lit(_c1(i)) for i in range(0x80, 0xA0)])
    dropped = n.between(0x1, 0x8) | (n == 0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    return (
        F.when((n == 0) | (n > _LAST) | n.between(0xD800, 0xDFFF), F.lit(_REPLACEMENT))
        .when(n.between(0x80, 0x9F), F.get(c1, n - 0x80))
        .when(dropped, F.lit(""))
        .otherwise(_character(n))
    )


def _number(digits: Column, base: int, longest: int) -> Column:
    """The number, or one beyond all characters where it has more digits than any of them."""
    plain = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(plain) > longest, F.lit(_LAST + 1)).when(plain == "", F.lit(0)).otherwise(F.conv(plain, base, 10).cast("int"))


def _decoded(reference: Column) -> Column:
    """What a reference stands for; one that is no name, nor begins with one that needs no semicolon, stays."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    body = F.substr(reference, F.lit(2))
    digits = lambda at: F.rtrim(F.substr(reference, F.lit(at)), F.lit(";"))
    whole = F.try_element_at(names, body)
    # names without a semicolon have two to six letters
    begun = F.filter(F.transform(F.sequence(F.lit(6), F.lit(2)), lambda n: F.left(body, n)), lambda s: (F.length(s) < F.length(body)) & F.try_element_at(names, s).isNotNull())
    prefix = F.get(begun, 0)
    named = F.coalesce(whole, F.concat(F.try_element_at(names, prefix), F.substr(body, F.length(prefix) + 1)), reference)
    return F.when(reference.rlike("^&#[0-9]"), _numbered(_number(digits(3), 10, 7))).when(reference.rlike("^&#[xX]"), _numbered(_number(digits(4), 16, 6))).otherwise(named)


def _replaced(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """The text with all that the pattern finds replaced, once: what a reference leaves is not read again."""
    pieces, references = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    decoded = F.concat(F.transform(references, replacement), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, decoded, lambda p, d: F.concat(p, d)), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def unescaped(text: Column) -> Column:
    """The text with every character reference replaced, by the rules of HTML 5."""
    return _replaced(text, REFERENCE, _decoded)


def unescaped_names(text: Column, *names: str) -> Column:
    """The text with the references of these names replaced where they end in a semicolon; all else stays as it is."""
    values = F.create_map(*[F.lit(x) for name in names for x in (f"&{name};", html5[f"{name};"])])
    return _replaced(text, f"&(?:{'|'.join(names)});", lambda r: F.element_at(values, r))
