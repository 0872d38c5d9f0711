from __future__ import annotations

import random

from quire.llm import language_id


def _language(seed):
    """Words of syllables that only this language has, nearly."""
    rng = random.Random(seed)
    letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def test_more_than_a_hundred_languages(spark):
    own = {f"l{i:03}": _language(i) for i in range(120)}
    rows = [(i, text(150), name) for i, (name, text) in enumerate(own.items())]
    model = language_id.fit(spark.createDataFrame([*rows, *rows[:90]], "doc_id long, text string, lang string"))
    assert model.languages == sorted(own)
    found = language_id.judge([text(80) for text in own.values()], model)
    assert [x[0] for x in found] == list(own)


def test_a_text_in_five_languages(spark):
    own = {name: _language(name) for name in "abcdefg"}
    model = language_id.fit(spark.createDataFrame([(i, text(300), name) for i, (name, text) in enumerate(own.items())], "doc_id long, text string, lang string"))
    found = language_id.judge([" ".join(own[x](200) for x in some) for some in ("abcde", "bdfg", "a")] + [""], model)
    assert [set(x[2]) for x in found] == [set("abcde"), set("bdfg"), {"a"}, set()]
    assert all(abs(s - 0.2) < 0.03 for s in found[0][3]) and all(abs(s - 0.25) < 0.03 for s in found[1][3])


def test_a_single_empty_text(spark):
    model = language_id.fit(spark.createDataFrame([(0, "some words", "en")], "doc_id long, text string, lang string"))
    assert language_id.judge([""], model)[0][0] == language_id.UNKNOWN
