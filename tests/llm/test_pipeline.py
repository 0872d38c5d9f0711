from __future__ import annotations

import corpus_pipeline
from quire.llm.frames import table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    counts, schema = [docs.count()], docs.dtypes
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.dtypes == schema
        docs = docs.cache()
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] > 0.7 * counts[0]
    assert docs.where("text rlike '[0-9a-f]{40}'").count() == 0
    final = {r.doc_id: r.text for r in docs.collect()}
    found = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in found} == set(final)


def test_odd_rows(spark, odd, empty, small):
    for source in (odd, empty):
        docs = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, small)
            assert docs.columns == source.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert packed.count() == 0 or source is odd


ENGLISH = "the people of the town went down to the river and looked at the boats that were there "
GERMAN = "die leute aus der stadt gingen an den fluss und sahen sich dort die schiffe an die da waren "
SPANISH = "la gente del pueblo bajo hasta el rio y miro los barcos que estaban alli desde hace tiempo "


def test_language_stage(spark, empty):
    """A text in three languages stays, one in none goes; the test texts have no label, so nothing is learned from them."""
    known = [(100 + i, t * 3, x, None, 0) for i, (t, x) in enumerate([(ENGLISH, "en"), (GERMAN, "de"), (SPANISH, "es")] * 6)]
    mixed = (ENGLISH + GERMAN + SPANISH) * 2  # no language has half
    rows = [(1, mixed, None, None, 0), (1, mixed, None, None, 0), (2, "qzxv jkwq xxqz vvkq zzxj " * 9, None, None, 0), (3, "12 34 !!", None, None, 0), (4, None, None, None, 0), (None, ENGLISH, None, None, 0), (5, "", None, None, 0)]
    docs = spark.createDataFrame([*known, *rows], empty.schema).selectExpr("*", "'mine' as surprise", "doc_id as row")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    found = kept.where("doc_id < 100 or doc_id is null").collect()
    assert sorted((r.doc_id or 0, r.surprise) for r in found) == [(0, "mine"), (1, "mine"), (1, "mine")]
    assert kept.where("doc_id >= 100").count() == len(known)
    unlabelled = docs.withColumn("lang", docs["source"])  # null everywhere
    assert corpus_pipeline.language(spark, unlabelled, "").where("doc_id < 100").count() == 3  # only texts without a letter go


def test_later_stages_on_repeated_and_null_rows(spark, odd, small):
    """Every stage but packing returns the columns it was given, whatever their names."""
    twice = odd.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, twice, small)
        assert out.dtypes == twice.dtypes and out.count() <= twice.count(), name
    assert corpus_pipeline.near_duplicates(spark, twice, small).count() == corpus_pipeline.near_duplicates(spark, odd, small).count()
    assert corpus_pipeline.secret_scan(spark, twice, small).count() == twice.count()
