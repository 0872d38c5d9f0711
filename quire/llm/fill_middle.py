"""Fill-in-the-middle forms of texts, cut between units that run-length encoded character classes count."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import arrow_map, batch, columns, in_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 42
#: Of a hundred texts those that take a form, and of a hundred of these those with the suffix first.
FORMED, SUFFIX_FIRST = 50, 80
#: Code points of a text that are classified at once, and texts of a batch that are in memory together.
_AT_ONCE, _TEXTS = 1 << 20, 200


class Runs(NamedTuple):
    """Maximal runs of white space (code points 9 to 13 and 32) and of all else, in turn."""

    starts: np.ndarray  #: code point where each run starts; last the text's length
    units: np.ndarray  #: units that end before each run; last the text's units
    width: int | None

    def cut(self, units: int) -> int:
        """The code point after so many units: so many widths into the run that completes the last of them."""
        if not units:
            return 0
        run = int(np.searchsorted(self.units, units)) - 1
        if units == self.units[run + 1]:
            return int(self.starts[run + 1])
        return int(self.starts[run]) + (units - int(self.units[run])) * self.width


def runs_of(text: str, width: int | None = None) -> Runs:
    """The runs of a text. A run that isn't white space is a unit, or one for each ``width`` of its characters; white
    space belongs to the unit that follows it, and is a unit where it ends the text."""
    flips, kinds = [], []
    for at in range(0, len(text), _AT_ONCE):
        points = np.frombuffer(text[at : at + _AT_ONCE].encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (points == 32) | ((points >= 9) & (points <= 13))
        if kinds and space[0] != kinds[-1]:
            flips.append([at])
        flips.append(np.flatnonzero(space[1:] != space[:-1]) + (at + 1))
        kinds += [space[0], space[-1]]
    if not kinds:
        return Runs(np.zeros(1, np.int64), np.zeros(1, np.int64), width)
    starts = np.concatenate([[0], *flips, [len(text)]]).astype(np.int64)
    lengths = np.diff(starts)
    units = np.ones(len(lengths), np.int64) if width is None else -(-lengths // width)
    units[0 if kinds[0] else 1 :: 2] = 0
    if kinds[-1]:
        units[-1] = 1
    return Runs(starts, np.concatenate([[0], np.cumsum(units)]), width)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that the seed and the id fix; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def arranged(text: str, doc_id: int | None, width: int | None = None, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle, and the output."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    runs = runs_of(text, width)
    n = int(runs.units[-1])
    if not text or h3 % 100 >= FORMED or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    a, b = (runs.cut(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, width: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every whole text.

    Cuts fall between units (``runs_of``), at places that ``seed`` and doc_id fix. A text that holds one of the three marks
    stays plain, so a formed output can always be taken apart (``restored``).

    A null or empty text is plain, with no unit; a null id is drawn for as no digits; repeated rows come out alike; an empty table gives
    no rows; other columns are ignored. A long text takes 16 bytes for each of its runs, and is classified piece by piece.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, _TEXTS):
            ids, texts = columns(b, "doc_id", "text")
            found = [arranged(t or "", i, width, seed) for i, t in zip(ids, texts, strict=True)]
            yield batch(schema, ids, *map(list, zip(*found, strict=True)))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made of, from it and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    joined = lambda *order: F.concat(*[F.get(parts, i) for i in order])
    return F.when(form == PSM, joined(1, 3, 2)).when(form == SPM, joined(2, 3, 1)).otherwise(output)
