from __future__ import annotations

import corpus_pipeline
from quire.llm import secrets


def test_the_stage_masks_all_but_copied_examples(spark, empty):
    texts = ["password = hunter22 ok", f"see AKIA{'ABCDEFGH' * 2} ok", f"sum {'1234567890' * 3} ok", f"token={'a1' * 150}bcdefghijk ok", "hunter22 alone"]
    rows = [(i, t, "en", f"o{i}/r", len(t)) for i, t in enumerate(texts)]
    rows += [(i, "token=example9 ok", "en", f"o{i}/r", 17) for i in range(10, 15)]
    found = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, spark.createDataFrame(rows, empty.schema), "").collect()}
    mask = secrets.MASK
    assert [found[i].text for i in range(5)] == [f"{mask} ok", f"see {mask} ok", f"sum {mask} ok", f"{mask} ok", "hunter22 alone"]
    assert all(found[i].text == "token=example9 ok" for i in range(10, 15)) and found[0].n_chars == len(found[0].text)


def test_all_of_a_long_value_is_looked_at(spark):
    from pyspark.sql import functions as F

    values = spark.createDataFrame([("a1" * 150 + "bcdefghijk",)], "v string")
    assert values.select(secrets.live_looking(F.col("v"))).collect()[0][0]
