from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from quire.llm import queries, secrets
from quire.llm.frames import table

from .conftest import KEY

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]
    count = lambda k: sum(x[2] == k for x in found)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


def _compare(found, texts):
    for r in found:
        expected = _base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == expected[:4], (r, expected)
        assert [s for s in r.spans.split(",") if s and not s.startswith("copy")] == expected[4]


def test_all_documents(spark, small):
    small = small.replace("0.001", "0.01")  # the smallest table has no secret
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    found = queries.op8_secret_ownership(spark, small).collect()
    assert len(found) == len(texts) and sum(r.n_assign for r in found)
    _compare(found, texts)


TEXTS = [
    f'token=token:abcdefgh Password : "{KEY}"', f"aPi_KeY='{KEY.upper()}' AKIA AKIA{'A1' * 8} AKIA{'B2' * 7}", "0123456789abcdef01234567" * 2, "secret=secret=secret=abcdef",
    f"é🎉é passwd:🎉 passwd:aé passwd = abcdef token{'=' * 8}", f"x{KEY}y {KEY}\n{KEY}", "tokentoken=tokentoken tſoken=abcdefgh", "password" * 3, "", None, "API_KEY: " + "k" * 5000, "token='a' secret:\"bcdefghijk\"",
]


def test_hard_texts(spark, empty):
    rows = [(i, t, "en", f"o{i}/r", 0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, empty.schema)
    found = secrets.scan(docs).collect()
    assert len(found) == len(TEXTS)
    _compare(found, dict(enumerate(TEXTS)))
    assert secrets.scan(empty).count() == 0


def test_odd_rows(odd):
    from .conftest import ROWS

    found = secrets.scan(odd).collect()
    assert len(found) == len(ROWS)
    _compare(found, {r[0]: r[1] for r in ROWS})


def test_ownership_and_masks(spark, empty):
    own, example, bare = "Zx9" + "q7Lm2Vt8" * 3, "Ex4" + "mple5K8s" * 3, "P0a" + "wxYz19Qm" * 3
    rows = [(i, f"see token={example} end", "en", f"owner{i}/r", 40) for i in range(5)]
    rows += [(10, f"password = '{own}' ok", "en", "me/one", 5), (11, f"é🎉 {own}; {bare} tail", "en", "me/two", 5), (12, "token=short1 but dull", "en", "z/z", 7), (13, "nothing here", "en", None, 12)]
    docs = spark.createDataFrame(rows, empty.schema)
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert all((found[i].n_example, found[i].n_live) == (1, 0) for i in range(5))
    assert (found[10].n_live, found[11].n_live) == (1, 1) and found[11].spans == f"copy:3:{3 + len(own)}"
    assert (found[12].n_assign, found[12].n_live, found[13].spans) == (1, 0, "")
    kept = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert len(kept) == len(rows) and all(kept[i].text == rows[i][1] for i in range(5))
    assert kept[10].text == f"{secrets.MASK}' ok" and kept[11].text == f"é🎉 {secrets.MASK}; {bare} tail"
    assert kept[11].n_chars == len(kept[11].text) and kept[12].text == rows[7][1] and kept[12].n_chars == 7


def test_redact_keeps_columns(odd, empty):
    out = secrets.redact(odd)
    assert out.dtypes == odd.dtypes and out.count() == odd.count()
    assert {r.text for r in out.collect() if r.doc_id == 4} == {f"🎉 {secrets.MASK} {secrets.MASK}"}
    assert secrets.redact(empty).count() == 0


def test_redact_keeps_columns_of_its_own_names(spark):
    rows = [(1, f"token = {KEY}", "mine", "s1", "r1"), (2, "plain", "other", "s2", "r2"), (None, None, None, "s3", "r3"), (1, f"token = {KEY}", "mine", "s1", "r1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _spans string, _row string")
    kept = sorted(map(tuple, secrets.redact(docs, weak=True).collect()), key=repr)
    assert kept == sorted(((i, t and t.replace(f"token = {KEY}", secrets.MASK), *more) for i, t, *more in rows), key=repr)


def test_ownership_against_plain_counts(spark, empty):
    """A value that a third of all rows have, some of few repositories, some of one owner's many."""
    everywhere, pair, weak = "Q1w2" * 2 + "E3r4T5y6", "Aa1Bb2Cc3Dd4Ee5F", "abcdefg"
    rows = []
    for i in range(600):
        text = f"see token={everywhere} there" if i % 3 == 0 else f"secret: '{pair}'" if i % 100 == 1 else f"x {pair} {weak}" if i % 50 == 2 else "passwd=" + weak if i % 7 == 0 else "nothing"
        rows.append((i, text, "en", None if i % 90 == 0 else f"owner{i % 100 // 60}/r{i % 100}", 0))
    docs = spark.createDataFrame(rows, empty.schema)
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    spans = {}
    for i, text, _, source, _ in rows:
        for m in ASSIGN.finditer(text):
            spans.setdefault(m[2], []).append(source)
        if f"x {pair}" in text:
            spans.setdefault(pair, []).append(source)
    for i, text, *_ in rows:
        for s in found[i].found:
            value = text[s.start : s.end].split("=")[-1].split("'")[-1] if s.rank == 0 else text[s.start : s.end]
            owners = {(x or "").split("/")[0] for x in spans[value]}
            assert s.owners == len(owners) and s.hash == hashlib.sha256(value.encode()).hexdigest()
            assert s["class"] == ("example" if len(owners) >= secrets.COPIED_OWNERS else "weak" if value == weak else "live")
    classes = {s["class"] for r in found.values() for s in r.found}
    assert classes == {"example", "live", "weak"} and any("copy" in r.spans for r in found.values())


def test_no_python_in_the_plan(spark, small):
    docs = table(spark, small, "documents")
    for out in (secrets.redact(docs), secrets.scan(docs), secrets.ownership(docs.selectExpr("doc_id as row", "text as value", "1 as rank", "source as repository"))):
        assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def test_a_text_of_many_spans(spark):
    """A megabyte with 32000 assignments, some within each other's masks: as fast as a text of its length should be."""
    import time

    value = lambda i: f"a1b2c3d4e5f6{i:08d}zz"
    text = "".join(f"é x{i}\npassword = {value(i)}\n" if i % 2 else f"token={value(i % 64)} " for i in range(32_000))
    docs = spark.createDataFrame([(1, text, "a/x"), (2, f"bare {value(1)} here", "a/x"), (3, None, None)], "doc_id long, text string, source string")
    start = time.time()
    rows = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert time.time() - start < 60
    found = [(m.start(), m.end()) for m in re.finditer(r"(password|token)\x20*=\x20*[A-Za-z0-9+/_.=-]+", text)]
    assert rows[1]["n_assign"] == len(found) == 32_000
    assert [(s["start"], s["end"]) for s in rows[1]["found"] if s["rank"] == 0] == found
    assert masked[1] == re.sub(r"(password|token)\x20*=\x20*[A-Za-z0-9+/_.=-]+", "[SECRET]", text)
    assert masked[2] == "bare [SECRET] here" and masked[3] is None


def test_strings_beside_and_inside_other_spans(spark):
    """What overlaps a base span adds nothing, wherever it begins; what touches one does."""
    span = lambda start, rank, end: (start, rank, end)
    spans = [span(0, 0, 10), span(10, 3, 20), span(19, 3, 30), span(25, 2, 40), span(40, 3, 50), span(60, 3, 90), span(70, 1, 75), span(80, 3, 85), span(90, 3, 95)]
    df = spark.createDataFrame([(spans,)], "spans array<struct<start:long,rank:int,end:long>>")
    added = df.select(secrets._added(F.col("spans")).alias("added")).collect()[0].added
    based = [s for s in spans if s[1] < 3]
    assert [tuple(s) for s in added] == [s for s in spans if s[1] == 3 and not any(b[0] < s[2] and s[0] < b[2] for b in based)]
