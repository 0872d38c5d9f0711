"""Masks, measures and repeated lines on hand-made documents."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import fields
from quire.plans import measures

TEXTS = [
    "Write to a.b@example.com or 10.0.0.1, card 4111111111111111, call 555-123-4567.",
    f'token = "{"ab12" * 10}" and token = "short"',
    "", None, "nothing to see", "x@y.co" * 3, "1.2.3.4.5 192.168.0.1", "é@ü.de 12345678901234567", "the the of\nand\n\nand\n!!!",
]


def _masked(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", fields.masked(F.col("text")).alias("m"))
    return [r.m for r in rows.orderBy("i").collect()]


def test_masks(spark):
    once = _masked(spark, TEXTS)
    assert once[0] == "Write to [EMAIL] or [IPV4], card [CARD], call [PHONE]."
    assert once[1] == '[TOKEN] and token = "short"' and once[2:5] == ["", None, "nothing to see"]
    assert _masked(spark, once) == once
    for text in once:
        assert not any(re.search(fields.PATTERNS[k], text or "") for k in fields.MASKED)


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab@.1 23-\n=\"token", max_size=60), min_size=1, max_size=20))
def test_a_cheap_test_loses_nothing(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for kind, pattern in fields.PATTERNS.items():
        full = df.select("i", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("x"), fields.find(F.col("text"), kind).alias("y"), fields.holds(F.col("text"), kind).alias("h"))
        assert all(r.x == r.y and r.h == bool(r.x) for r in full.collect())


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in measures._measures(docs, "doc_id").collect()}
    assert (found[8].n_words, found[8].word_length, found[8].stop_words) == (5, round(14 / 5, 6), 1.0)
    assert (found[8].repeated_lines, found[8].symbols) == (0.25, round(3 / 23, 6))
    assert found[2].symbols is None and found[2].word_length is None and found[3].symbols is None


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    header = "a header of more than twenty characters"
    rows = [(1, f"{header}\none\n{header}"), (2, f"two\n{header}"), (3, header), (4, "short\nshort"), (5, None), (None, header)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_repeated_lines(spark, lines):
    assert [(r.documents, r.occurrences) for r in measures.repeated_lines(spark, lines).collect()] == [(4, 5)]
    assert {r.doc_id for r in measures.self_repeating_documents(spark, lines).collect()} == {1, 4}
