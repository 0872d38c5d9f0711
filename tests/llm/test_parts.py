"""Long texts, long benchmark texts, ids that are null or repeated, and several passes."""

from __future__ import annotations

import random

from quire.llm import decontaminate

WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "rt", "st", "l")]


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_parts_give_the_hits_of_the_whole():
    rng = random.Random(3)
    items = [(i, _prose(rng, n)) for i, n in enumerate((12, 20, 60, 400))] + [(9, "cat sat on")]
    texts = []
    for _ in range(6):
        pieces = [_prose(rng, 150)]
        for _, item in rng.choices(items[:-1], k=8):
            at = rng.randrange(max(1, len(item) - 70))
            quote = list(item[at : at + 90])
            for _ in range(rng.randint(0, 4)):
                quote[rng.randrange(len(quote))] = rng.choice("aeiou")
            pieces += ["".join(quote), _prose(rng, rng.randint(5, 90))]
        texts.append(" ".join(pieces) + " cat sat onward, concat sat on")
    whole = decontaminate.Index(items, quotes=True)
    for at_once, piece in ((700, 10_000), (1000, 300), (10_000, 250)):
        cut = decontaminate.Index(items, quotes=True, piece=piece, at_once=at_once)
        key = lambda w: (w.item, w.codes.tobytes(), w.edits, w.least)
        assert sorted(map(key, cut.windows)) == sorted(map(key, whole.windows))
        for text in texts:
            hits = set(decontaminate.hits(text, cut))
            assert hits == set(decontaminate.hits(text, whole)) and hits
            assert not any(h[0] == 9 for h in hits)
    assert [h[0] for h in decontaminate.hits("x " * 300_000 + "a cat sat on it" + " y" * 300_000, whole)] == [9]


def test_no_short_text_inside_a_word_at_a_cut():
    index = decontaminate.Index([(1, "cat sat on")], quotes=True)
    for n in range(decontaminate.AT_ONCE - 30, decontaminate.AT_ONCE + 30):
        assert decontaminate.hits("x" * (n - 1) + " cat sat onward" + " z" * 9, index) == []
    assert len(decontaminate.hits("x" * (decontaminate.AT_ONCE - 6) + " cat sat on", index)) == 1


def test_documents_of_one_id_stay_apart(spark):
    text = "Which of the following planets, in order, has the largest number of known moons orbiting it today and why?"
    rows = [(None, "ab " + text), (None, "nothing"), (None, "abcdef " + text), (7, text), (7, text), (7, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, text), (0, text), (None, text)], "item_id long, text string")
    found = sorted(decontaminate.contaminated(docs, benchmark).collect(), key=repr)
    assert len(found) == 8 and {r.item_id for r in found} == {0, None}
    assert sorted((r.doc_id or 0, r.start, r.end) for r in found if r.item_id == 0) == [(0, 3, 2 + len(text)), (0, 7, 6 + len(text)), (7, 0, len(text) - 1), (7, 0, len(text) - 1)]
    kept = decontaminate.keep_clean(docs, benchmark).collect()
    assert sorted(r.text for r in kept) == ["none", "nothing"]


def test_passes_give_what_one_gives(spark, small):
    docs, benchmark = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    one = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    assert one == sorted(map(tuple, decontaminate.contaminated(docs, benchmark, most=3000).collect()))
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, benchmark, most=3000).collect()) == sorted({r.doc_id for r in docs.collect()} - {x[0] for x in one})
