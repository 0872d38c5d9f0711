from __future__ import annotations

import random

import pytest

from quire.llm import decontaminate


@pytest.mark.parametrize("length", [58, 64, 75, 100])
def test_a_partial_quote_is_found_at_every_offset(spark, length):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    item = " ".join(word() for _ in range(45))
    quotes = [item[i : i + length].strip() for i in range(len(item) - length + 1)]
    quotes = [x for x in quotes if len(x) >= 58]
    rows = [(i, f"{word()} {word()} {word()}. {x}. {word()} {word()} {word()}") for i, x in enumerate(quotes)]
    rows += [(-1, " ".join(word() for _ in range(40))), (-2, item[:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.keep_clean(docs, benchmark).collect()} == {-1, -2}
    assert {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()} == set(range(len(quotes)))
