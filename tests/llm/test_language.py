from __future__ import annotations

import zlib

from quire.llm import language_id, lm_score, queries
from quire.llm.frames import table


def test_held_out_accuracy(spark, small):
    langs = {r.doc_id: r.lang for r in table(spark, small.replace("0.001", "0.01"), "documents").collect()}
    rows = queries.op1_em_language_mixture(spark, small.replace("0.001", "0.01")).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.45
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


ENGLISH = "the people of the town went down to the river and looked at the boats that were there "
GERMAN = "die leute aus der stadt gingen an den fluss und sahen sich dort die schiffe an die da waren "


def test_mixtures(spark):
    rows = [(i, t * 3, x) for i, (t, x) in enumerate([(ENGLISH, "en"), (GERMAN, "de")] * 8)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    english, german, both, mostly = language_id.judge([ENGLISH, GERMAN, (ENGLISH + GERMAN) * 4, (ENGLISH * 3 + GERMAN) * 4], model)
    assert english[:3] == ("en", 1.0, ["en"]) and german[:3] == ("de", 1.0, ["de"])
    assert set(both[2]) == {"de", "en"} and abs(both[1] - 0.5) < 0.1
    assert mostly[0] == "en" and abs(mostly[1] - 0.75) < 0.1


def test_odd_rows(odd, empty):
    model = language_id.fit(odd)
    found = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 5, 8))
    assert found[9].lang_pred == "en" and language_id.predict(odd, model).count() == 11
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_separators_inside_texts(spark):
    rows = [(1, ENGLISH * 3, "en"), (2, GERMAN * 3, "de")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    plain = language_id.judge([ENGLISH, GERMAN, "", ENGLISH], model)
    assert language_id.judge([ENGLISH.replace(" ", "\0"), GERMAN, "\0\0", "\0" + ENGLISH], model) == plain


def test_lower_loss_for_the_target(spark):
    rows = [(i, (ENGLISH if i % 2 else GERMAN) * 2) for i in range(40)] + [(None, ENGLISH), (50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(1, 30, 2)] + [(None,), (1,)], "doc_id long")
    found = {r.doc_id: r for r in lm_score.score(docs, target).collect()}
    assert len(found) == 43
    assert all((found[i].score < 0) == bool(i % 2) for i in range(40))
    assert found[None].score < 0 and found[50].n_tokens == found[51].n_tokens == 0 and found[50].score is None
    assert lm_score.score(docs.where("false"), target).count() == 0
    assert all(r.score is None or abs(r.score) < 20 for r in lm_score.score(docs, target.where("false")).collect())


def test_counts_are_of_all_tokens(spark, small):
    docs = table(spark, small, "documents").selectExpr("text", "doc_id % 3 = 0 as in_target")
    counted = lm_score.counts(docs).where(f"cell < {lm_score.IDS}").groupBy().sum("target", "background").collect()[0]
    tokens = queries.op2_prefix_token_counts(spark, small).selectExpr("doc_id % 3 = 0 as t", "n_tokens").groupBy("t").sum("n_tokens").collect()
    assert {True: counted[0], False: counted[1]} == {r[0]: r[1] for r in tokens}


def test_losses_by_hand(spark):
    docs = spark.createDataFrame([("the the cat", True), ("the dog", False)], "text string, in_target boolean")
    t = lm_score.counts(docs).toPandas()
    models = lm_score.Models(*(t[c].to_numpy() for c in ("cell", "target", "background")))
    target, background = models.losses(lm_score._ids("the the cat", lm_score.ByteIds()))
    assert target.mean() < background.mean() and (target > 0).all()


def test_held_out_by_hand(odd):
    for r in odd.select("doc_id", queries.held_out().alias("held")).collect():
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
