"""What the tables lack: nulls, empty and odd texts, ties, late rows; and properties."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import fields, pages, text, vectors
from quire.operators.joins import asof, within
from quire.operators.ranking import top_per_group


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).collect()[0][0]


def test_pages(spark):
    html = '<html LANG="EN"><title> A &amp;lt; B </title><script>var p = "</p><title>no</title>";</script><!-- <a> --><article><p>One<p>two &copy;<style>p{}</style></article><a href=x>l</a>'
    assert _one(spark, pages.title, html) == "A &amp;lt; B"
    assert _one(spark, lambda c: pages.decoded(pages.title(c)), html) == "A &lt; B"
    assert _one(spark, pages.language, html) == "en" and _one(spark, pages.link_count, html) == 2
    assert _one(spark, lambda c: pages.visible_text(pages.article(c)), html) == "One two ©"
    for f in (pages.title, pages.visible_text, pages.article):
        assert _one(spark, f, "") == "" and _one(spark, f, None) is None
    assert _one(spark, pages.host, "HTTPS://Ex.org:80/a") == "ex.org"


def test_words_and_grams(spark):
    assert _one(spark, text.words, "L'Été, 2 fois") == ["l", "été", "fois"] and _one(spark, text.words, None) is None
    assert _one(spark, lambda c: text.char_ngrams(c, 3), "ab") == [] and _one(spark, lambda c: text.char_ngrams(c, 2), "é🎉a") == ["é🎉", "🎉a"]
    assert _one(spark, lambda c: text.shingles(text.words(c), 2), "a b c") == ["a b", "b c"] and _one(spark, lambda c: text.shingles(text.words(c), 2), "a") == []
    assert _one(spark, text.delimiter_rows, "a|b\nx | y | z\n|||") == ["x | y | z", "|||"]


def test_fields(spark):
    t = "mail a.b@c.example.com, ip 10.0.0.1 and 999.1.1.1, card 4539578763621486"
    assert _one(spark, lambda c: fields.find(c, "email"), t) == ["a.b@c.example.com"]
    assert _one(spark, lambda c: F.transform(fields.find(c, "ipv4"), lambda v: fields.is_valid("ipv4", v)), t) == [True, False]
    assert _one(spark, lambda c: fields.is_valid("card", fields.find(c, "card")[0]), t) is True
    assert _one(spark, lambda c: fields.find(c, "email"), None) is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [tuple(r) for r in df.select(vectors.norm(F.col("a")), vectors.cosine(F.col("a"), F.col("b"))).collect()] == [(5.0, 0.96), (0.0, None)]


def test_top_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, None), ("b", 4, None)], "g string, id long, v double")
    found = top_per_group(df, ["g"], [F.desc_nulls_last("v"), F.asc("id")], 2)
    assert sorted((r.g, r.id) for r in found.collect()) == [("a", 1), ("a", 2), ("b", 4)]


AT = dt.datetime(2024, 1, 1)
_times = st.lists(st.tuples(st.integers(1, 2), st.integers(0, 40)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_times, _times)
def test_time_joins_against_brute_force(spark, lefts, rights):
    rows = lambda xs: [(i, k, AT + dt.timedelta(minutes=m)) for i, (k, m) in enumerate(xs)]
    a = spark.createDataFrame(rows(lefts), "id long, k long, t timestamp_ntz")
    b = spark.createDataFrame(rows(rights), "rid long, k long, rt timestamp_ntz")
    found = {r.id: r.rt for r in asof(a, b, "k", "t", "rt", ["rt"]).collect()}
    for i, k, t in rows(lefts):
        assert found[i] == max((rt for _, rk, rt in rows(rights) if rk == k and rt <= t), default=None)
    pairs = sorted((r.id, r.rid) for r in within(a, b, "k", "t", "rt", 600).collect())
    assert pairs == sorted((i, j) for i, k, t in rows(lefts) for j, rk, rt in rows(rights) if k == rk and t <= rt <= t + dt.timedelta(minutes=10))


def test_references_as_the_standard_library_has_them(spark):
    import html
    import random
    from html.entities import html5

    from quire.functions.entities import unescaped

    rng = random.Random(2)
    names = list(html5)
    texts = [None, "", "no reference", "&", "&&amp;amp;", "&amp;lt;", "&notit; &notin; &not", "&copyright &copy &COPY;", "&#", "&#;", "&#x;", "&#xZ;", "&unknown;", "a &b; c", "&#0;&#13;&#128;&#x9f;&#x81;&#xD800;&#x110000;&#99999999999999999999;&#00000065;&#x1F600;&#8364", "&#1;&#11;&#xFDD0;&#xFFFE;&#x1FFFF;&#10;x", "&" + "a" * 50 + ";", "&ampé;"]
    texts += ["".join(rng.choice(["&", "#", "x", ";", "12", "41", "amp", "lt", " ", "é", "q", *rng.choices(names, k=3)]) for _ in range(rng.randint(1, 15))) for _ in range(300)]
    texts += [f"<{'&' + n}>" for n in names]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = {r.id: r.u for r in df.select("id", unescaped(F.col("t")).alias("u")).collect()}
    wrong = [(t, found[i], html.unescape(t)) for i, t in enumerate(texts) if found[i] != (None if t is None else html.unescape(t))]
    assert not wrong, wrong[:5]


def test_references_cut_off_stay(spark, tmp_path):
    from quire.plans import pages

    from .oracle import compare, connection

    html = ["<p>a &amp; b &quot;c&quot; &middot; &copy; x</p>", "<p>a &amp</p>", "&copy2024 &quo", "&amp;quot; &amp;amp;", "&lt;p&gt; &#65; &Amp;", "&&amp;&", "", None, "🎉&amp;é"]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    query, sql = pages.QUERIES["unescaped_pages"]
    assert compare(query(spark, str(tmp_path)), sql, connection(str(tmp_path))) == ""


def test_grams_and_shingles_of_long_texts_take_time_in_proportion(spark, tmp_path):
    """Odd texts against the SQL, and one of 40,000 words, for which work by the square of the length would take many minutes."""
    import time

    from quire.plans import text

    from .oracle import compare, connection

    rows = [None, "", "abcd", "abcde", "a🎉b🎉🎉\n🎉c", "one two three four", "one two three four five", "é🎉 one Two\tthree, four five one two three four five", " ".join(f"{'abcdefgh'[i % 8]}{'xyz'[i % 3]}{'klmno'[i % 5]}" for i in range(40_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    con = connection(str(tmp_path))
    for name in ("char_ngram_counts", "shingle_counts"):
        query, sql = text.QUERIES[name]
        found = query(spark, str(tmp_path))
        began = time.time()
        found.collect()
        assert time.time() - began < 20, name
        assert compare(found, sql, con) == "", name
