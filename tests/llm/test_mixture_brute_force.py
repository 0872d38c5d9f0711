"""The mixture inference against plain Python, and texts that are scored in slices."""

from __future__ import annotations

import math
import random
import resource

import numpy as np
import pytest

from quire.llm import language_id
from quire.llm.frames import table

from .test_many_languages import _language


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, _language(i)(400), f"l{i}") for i in range(5)]
    return language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def _cell(*codes):
    """The cell of a context of two characters, or of a character after it."""
    wrap = lambda x: x & (2**64 - 1)
    two, one = codes[:2]
    context = wrap(one * 0x9E3779B97F4A7C15) ^ wrap(two * 0xC2B2AE3D27D4EB4F)
    mixed = context if len(codes) == 2 else context ^ wrap(codes[2] * 0x165667B19E3779F9)
    return wrap(mixed * 0xD6E8FEB86659FD93) >> 48


def _word_likelihoods(text, model):
    """Of each word: its log-likelihood under every language, letter by letter."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = []
    for w in words:
        score = [0.0] * len(model.languages)
        two = one = 0
        for c in [*map(ord, w), 0]:
            for k in range(len(score)):
                score[k] += float(model.trigrams[_cell(two, one, c), k]) - float(model.bigrams[_cell(two, one), k])
            two, one = one, c
        out.append(score)
    return out


def _em(words, languages):
    """Shares of the languages by EM from equal ones, and the log-likelihood of the round before the last."""
    shares = {k: 1 / len(languages) for k in languages}
    for _ in range(language_id.ROUNDS):
        new = dict.fromkeys(languages, 0.0)
        likelihood = 0.0
        for score in words:
            top = max(score)
            p = {k: shares[k] * math.exp(max(score[k] - top, -60)) for k in languages}
            total = sum(p.values())
            likelihood += math.log(total)
            for k in languages:
                new[k] += p[k] / total / len(words)
        shares = new
    return shares, likelihood


def _by_hand(text, model):
    words = _word_likelihoods(text, model)
    everything = range(len(model.languages))
    full, _ = _em(words, everything)
    order = sorted(everything, key=lambda k: (-full[k], k))
    penalty = language_id.PENALTY * math.log(max(2, len(words)))
    alone = [sum(max(s[k] - max(s), -60) for s in words) for k in everything]
    best = (max(alone), {max(everything, key=lambda k: (alone[k], -k)): 1.0})
    for size in range(2, len(model.languages) + 1):
        shares, likelihood = _em(words, order[:size])
        best = max(best, (likelihood - (size - 1) * penalty, shares), key=lambda x: x[0])
    return {model.languages[k]: s for k, s in best[1].items()}


def test_shares_and_sets_against_plain_python(model):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        texts.append(" ".join(_language(rng.randrange(5))(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))))
    texts += ["a", "Zz 9 zz", texts[0].upper(), "ß İ ſ"]
    for text, found in zip(texts, language_id.judge(texts, model), strict=True):
        expected = _by_hand(text, model)
        assert set(found[2]) == {k for k, s in expected.items() if s > 0}
        assert all(abs(expected[k] - s) < 1e-4 for k, s in zip(found[2], found[3], strict=True))
        assert abs(found[1] - max(expected.values())) < 1e-4


def test_slices_give_what_the_whole_gives(model):
    rng = random.Random(12)
    for _ in range(10):
        text = " ".join(_language(rng.randrange(5))(rng.randint(20, 60)) for _ in range(3)) + "  --x" + "q" * 90
        whole = language_id.judge([text], model)[0]
        for most in (7, 50, 333):
            part = language_id.judge([text], model, most)[0]
            assert part[0] == whole[0] and part[2] == whole[2]
            assert np.allclose(part[3], whole[3], atol=1e-6) and abs(part[4] - whole[4]) < 1e-6


def test_lone_empty_and_very_long_texts(model):
    for alone in ([""], [None], ["!? 12"]):
        assert language_id.judge(alone, model) == [(language_id.UNKNOWN, 0.0, [], [], None)]
    text = _language(2)(150_000)
    assert len(text) > language_id.CHARACTERS
    found = language_id.judge([text, "", text, None, text], model)
    assert [x[0] for x in found] == ["l2", "und", "l2", "und", "l2"]


def test_memory_does_not_follow_the_longest_text(model):
    text = _language(1)(200_000) * 15
    assert len(text) > 20_000_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert language_id.judge([text], model)[0][0] == "l1"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB; the text itself is copied a few times


def test_equal_shares_go_to_the_first_in_the_alphabet(spark):
    rows = [(1, "aaa bbb", "yy"), (2, "aaa bbb", "xx"), (3, None, "zz"), (4, "ccc", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["xx", "yy"] and language_id.judge(["aaa"], model)[0][:3] == ("xx", 1.0, ["xx"])


def test_repeated_rows_and_clashing_names(spark, small):
    docs = table(spark, small, "documents").limit(40)
    model = language_id.fit(docs)
    twice = docs.unionByName(docs).selectExpr("*", "1 as score", "'x' as lang_pred", "2 as surprise")
    found = language_id.predict(twice, model)
    assert found.count() == 80 and found.distinct().count() == 40
