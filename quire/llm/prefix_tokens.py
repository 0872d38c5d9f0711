"""Token counts at every prefix of a text, by prefix dynamic programming over byte-level BPE."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import arrow_map, batch, columns
from .tokens import BYTE_SPLIT, BYTE_VOCABULARY, SPACE, ByChunk, Remembered, byte_letters, per_worker, vocabulary

LIMIT = 1024
#: Bytes after which the state of a piece is kept for others that begin alike; how many are kept.
STEM, MOST_STEMS = 6, 200_000
#: Pairs of tokens whose merging is remembered; ends of pieces whose tokens are.
MOST_PAIRS, MOST_ENDS = 1_000_000, 500_000
_FRESH = ([0], [""], "")

_CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
_RUN = regex.compile(f"[{SPACE}]{{2}}")
_SPACES = regex.compile(f"[{SPACE}]+")


class PrefixCounter:
    """Exact token counts of every prefix of a chunk of text.

    The last token of a prefix's encoding is the one vocabulary entry ending there that
    stays apart from the last token before it when the two are encoded together, so
    counts[i] = counts[i - length] + 1 needs only shorter prefixes.
    """

    def __init__(self, name: str = BYTE_VOCABULARY):
        with open(vocabulary(name), encoding="utf-8") as f:
            file = json.load(f)
        from tokenizers import Tokenizer

        #: The library's merges, on bytes written as letters.
        self.merge = Tokenizer.from_file(vocabulary(name)).model.tokenize
        self.letters = byte_letters()
        known = {*self.letters.values(), *file["model"]["vocab"]}
        #: Every beginning of a token, and whether it is one.
        self.begins = {t[:i]: t[:i] in known for t in known for i in range(1, len(t) + 1)}
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.apart: dict[tuple[str, str], bool] = {}
        self.stems: dict[str, tuple] = {}
        self.ends: dict[str, tuple] = {}

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the tokens a and b, side by side, are what they are merged to together."""
        if len(self.apart) > MOST_PAIRS:
            self.apart.clear()
        found = [t.value for t in self.merge(a + b)] == ([a, b] if a else [b])
        self.apart[a, b] = found
        return found

    def tokens_at(self, end: str) -> tuple[str, tuple[str, ...]]:
        """The longest part at the end of ``end`` that begins a token, and the tokens at its end, longest first."""
        if len(self.ends) > MOST_ENDS:
            self.ends.clear()
        begun = next(end[i:] for i in range(len(end)) if end[i:] in self.begins)
        found = begun, tuple(begun[i:] for i in range(len(begun)) if self.begins.get(begun[i:]))
        self.ends[end] = found
        return found

    def of_bytes(self, piece: str) -> list[int]:
        """Counts at the byte prefixes 1 to n of a piece that the pre-tokenizer leaves whole, its
        bytes written as letters."""
        counts, last, begun = self.stems.get(piece[:STEM], _FRESH)
        counts, last, apart, ends = counts[:], last[:], self.apart, self.ends
        for end in range(len(counts), len(piece) + 1):
            at = begun + piece[end - 1]
            begun, tokens = ends.get(at) or self.tokens_at(at)
            for token in tokens:
                start = end - len(token)
                known = apart.get((last[start], token))
                if known or known is None and self.stay_apart(last[start], token):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise AssertionError(f"no token ends at byte {end} of {piece!r}")
            if end == STEM and len(self.stems) < MOST_STEMS:
                self.stems[piece[:STEM]] = counts[:], last[:], begun
        return counts[1:]

    def of_piece(self, piece: str) -> list[int]:
        """Counts at the code point prefixes of such a piece."""
        data = piece.encode()
        counts = self.of_bytes(data.decode("latin-1").translate(self.letters))
        if len(data) == len(piece):
            return counts
        return [counts[end - 1] for end in accumulate(len(c.encode()) for c in piece)]

    def of_segment(self, text: str) -> list[int]:
        """Counts at the prefixes of a text without special tokens."""
        out: list[int] = []
        base, before, previous = 0, 0, ""
        for piece in BYTE_SPLIT.findall(text):
            counts = [base + c for c in self.of_piece(piece)]
            whole = counts[-1]
            if previous and _SPACES.match(piece) and _SPACES.fullmatch(previous):
                # a prefix that ends here ends in one run of white space
                counts[0] = before + self.of_piece(previous + piece[0])[-1]
            if piece in _CONTRACTIONS:
                quote = base + self.of_piece("'")[0]
                for i in range(1, len(piece)):
                    counts[i - 1] = quote + (self.of_piece(piece[1:i])[-1] if i > 1 else 0)
            out += counts
            before, base, previous = base, whole, piece
        return out

    def of_chunk(self, text: str) -> list[int]:
        """Counts at the prefixes of a text in which special tokens are recognised."""
        out: list[int] = []
        base = at = 0
        for m in self.special.finditer(text):
            plain = m.start() - at
            counts = self.of_segment(text[at : m.end() - 1])  # until it is complete it is ordinary text
            out += [base + c for c in counts]
            base += (counts[plain - 1] if plain else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + c for c in self.of_segment(text[at:])]


def _steps(counts: list[int]) -> bytes:
    return array("h", map(sub, counts, [0, *counts])).tobytes()


class PrefixDeltas(ByChunk):
    """The steps between the counts at a text's prefixes, as signed 16-bit numbers."""

    def __init__(self, name: str = BYTE_VOCABULARY):
        counter = PrefixCounter(name)
        pieces = Remembered(lambda piece: _steps(counter.of_piece(piece)))

        def make(chunk: str) -> bytes:
            # where no prefix of the chunk is split in another way than the chunk, its pieces' steps follow one another
            if "'" in chunk or _RUN.search(chunk) or counter.special.search(chunk):
                return _steps(counter.of_chunk(chunk))
            return b"".join(map(pieces.__getitem__, BYTE_SPLIT.findall(chunk)))

        super().__init__(make)


def counts_of(deltas: bytes) -> np.ndarray:
    """Token count at every prefix, from 0 characters to all."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(deltas, np.int16), dtype=np.int64)])


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_of(deltas) <= budget)[-1]) if budget >= 0 else 0


def prefix_table(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_chars, n_tokens and ``deltas``, from which ``counts_of`` gives the token
    count at every prefix (code points) of the whole text without encoding it again.

    A null text counts as empty: 0 tokens and no deltas. A null doc_id stays null, repeated
    rows are repeated, an empty table gives no rows, other columns are ignored. The strings
    of special tokens count as the library's default takes them: one token each.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("deltas", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas_of = per_worker(PrefixDeltas, vocabulary)
        for b in batches:
            ids, texts = columns(b, "doc_id", "text")
            texts = [t or "" for t in texts]
            deltas = list(map(deltas_of, texts))
            yield batch(schema, ids, [len(t.encode()) for t in texts], list(map(len, texts)), list(map(_total, deltas)), deltas)

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_chars long, n_tokens long, deltas binary")


def truncations(table: DataFrame, budgets: list[int]) -> DataFrame:
    """For each row of a prefix table and each budget: doc_id, budget, n_chars (the longest prefix
    that fits) and n_tokens (its count)."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "budget", "n_chars", "n_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, deltas in zip(*columns(b, "doc_id", "deltas"), strict=True):
                counts = counts_of(deltas)
                for budget in budgets:
                    fit = longest_within(deltas, budget)
                    rows.append((doc_id, budget, fit, int(counts[fit])))
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 4))

    return arrow_map(table.select("doc_id", "deltas"), run, "doc_id long, budget long, n_chars long, n_tokens long")


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (the longest prefix of at most ``limit``
    tokens), answered from each text's prefix counts where they are made, so that these
    need not leave the worker. Nulls and other cases as in ``prefix_table``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas_of = per_worker(PrefixDeltas, vocabulary)
        for b in batches:
            rows = []
            for doc_id, text in zip(*columns(b, "doc_id", "text"), strict=True):
                deltas = deltas_of(text or "")
                n = _total(deltas)
                fit = len(deltas) // 2 if n <= limit else longest_within(deltas, limit)
                rows.append((doc_id, len((text or "").encode()), n, n > limit, fit))
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 5))

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def _total(deltas: bytes) -> int:
    return int(np.frombuffer(deltas, np.int16).sum(dtype=np.int64))
