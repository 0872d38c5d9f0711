"""What the token files' workers hold at once, and that plain texts split as a whole have the library's ids."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import frames, token_files, tokens
from quire.llm.frames import shared_folder


def test_rows_come_in_small_batches(spark, monkeypatch):
    """A file of many rows goes to Python and back a few hundred rows at a time; the session's settings hold again after it."""
    most = getattr(token_files, "BATCH_ROWS", 500)

    def watched(df, f, schema):
        def few(batches):
            for b in batches:
                assert b.num_rows <= most, b.num_rows
                yield b

        return frames.arrow_map(df, lambda batches: f(few(batches)), schema)

    monkeypatch.setattr(token_files, "arrow_map", watched)
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.orc.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    path, rows = f"{shared_folder(spark)}/batches", 3 * most + 7
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    token_files.write_token_files(docs, path, files=1)
    found = token_files.positions(spark, path)
    assert [spark.conf.get(n) for n in names] == before
    got = found.orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(rows))
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(rows)]


def test_a_worker_remembers_pieces_not_words():
    ids = tokens.WordIds()
    parts = [f"{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    for a in parts:
        ids(" ".join(f'{a}-{b}-{c},"' for b in parts for c in parts[:30]))
    assert sum(len(v) for v in vars(ids).values() if isinstance(v, dict)) < 1000


def test_plain_texts_equal_the_librarys():
    library, ids = Tokenizer.from_file(tokens.vocabulary(tokens.WORD_VOCABULARY)), tokens.WordIds()
    rng = random.Random(7)
    letters = [chr(c) for c in range(0xA1, 0x130)] + ["'s", "'LL", "don't", "the", "ING", "12", "=", "\t", "\r\n", "<|endoftext|>", "<|endo"] + [" "] * 40
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}." for c in range(0x20, 0x140)]
    for t in texts:
        assert np.frombuffer(ids(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, t
