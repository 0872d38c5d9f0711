from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import fill_middle
from quire.llm.fill_middle import runs_of

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def units(text: str, width: int | None) -> list[str]:
    if width is None:
        return UNIT.findall(text)
    one = rf"[\x20\x09-\x0D]*[^\x20\x09-\x0D]{{1,{width}}}|[\x20\x09-\x0D]+"
    return re.findall(one, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\x1c\xa0é🎉", max_size=60), st.sampled_from([None, 1, 2, 5]), st.integers(1, 9))
def test_cuts_are_where_the_pattern_has_them(text, width, at_once):
    before = fill_middle._AT_ONCE
    fill_middle._AT_ONCE = at_once
    try:
        runs = runs_of(text, width)
    finally:
        fill_middle._AT_ONCE = before
    found = units(text, width)
    assert runs.units[-1] == len(found)
    assert [runs.cut(u) for u in range(len(found) + 1)] == [len("".join(found[:u])) for u in range(len(found) + 1)]


def plain(doc_id, text):
    """The contract, by the pattern."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    found = UNIT.findall(text)
    a, b = sorted((h1 % (len(found) + 1), h2 % (len(found) + 1)))
    p, m, s = ("".join(x) for x in (found[:a], found[a:b], found[b:]))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return doc_id, len(found), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(found), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(found), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    odd = [None, "", " ", "\n\n", "x", "  x", "x  ", "<P> in it", "a < P > b", "<<S", "é 🎉\xa0z q", "word " * 5000, "x" * 30_000, "<P", "S><"]
    return [(i, t) for i, t in enumerate(odd * 8)] + [(None, "a text without an id"), (None, None), (3, "twice"), (3, "twice")]


def test_against_the_pattern(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = fill_middle.transform(docs)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted((plain(*r) for r in texts), key=repr)
    forms = {r[0] for r in out.select("form").collect()}
    assert forms == {"plain", "psm", "spm"}


def test_outputs_can_be_taken_apart(spark, texts, small):
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    numbered = docs.withColumn("doc_id", F.monotonically_increasing_id())
    back = fill_middle.transform(numbered, width=3).select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("back"))
    assert back.join(numbered, "doc_id").where("back <> coalesce(text, '')").count() == 0


def test_odd_rows(spark, odd, empty):
    assert fill_middle.transform(empty).count() == 0
    found = {(r["doc_id"], r["output"]) for r in fill_middle.transform(odd.withColumn("n", F.lit("clash")).withColumn("form", F.lit("clash"))).collect()}
    assert (5, "") in found and (3, "") in found and fill_middle.transform(odd).count() == odd.count()
