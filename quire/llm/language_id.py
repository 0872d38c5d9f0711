"""Language identification as mixture inference: EM over words, language sets by penalised likelihood."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_map, batch, columns

UNKNOWN = "und"
#: Labelled documents of each language that the models are fitted on, about; all where there are fewer.
SAMPLE = 3000
#: Hashed cells of the trigram and bigram tables: with the languages, the bound of the model.
CELLS = 1 << 16
#: Pseudo-count of every trigram under every language.
SMOOTHING = 0.02
ROUNDS = 12
#: A further language must raise the log-likelihood by this times the logarithm of the words.
PENALTY = 3.0
#: Characters that are scored at once; a longer text is scored alone, in slices.
CHARACTERS = 250_000
#: Numbers (events by languages) that are held at once; with many languages fewer characters are scored at once.
NUMBERS = 16_000_000


@dataclass
class Model:
    languages: list[str]
    trigrams: np.ndarray  # CELLS x languages, log(count + smoothing)
    bigrams: np.ndarray  # CELLS x languages, log of the context's total


_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000))
    return _LETTERS[0][codes]


def _cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells, bigram cells and places of the events in lower-case code points, and which events begin a word.

    A word is a run of letters; its events are its letters and its end, each given the two
    characters before it within the word.
    """
    letter = _is_letter(codes)
    own = np.where(letter, codes, 0).astype(np.uint64)
    one, two = np.zeros_like(own), np.zeros_like(own)
    one[1:] = own[:-1]
    two[1:] = np.where(one[1:] > 0, one[:-1], 0)
    event = np.flatnonzero(letter | (one > 0))
    own, one, two = own[event], one[event], two[event]
    context = one * np.uint64(0x9E3779B97F4A7C15) ^ two * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = (context * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    triple = ((context ^ own * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    return triple.astype(np.int64), pair.astype(np.int64), event, one == 0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _events(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells, bigram cells, the events at which words start, and each word's text."""
    lowered = [t.lower() for t in texts]
    triple, pair, event, first = _cells(_codes("\0".join(lowered) + "\0"))
    ends = np.cumsum([len(t) + 1 for t in lowered]) - 1
    starts = np.flatnonzero(first)
    return triple, pair, starts, np.searchsorted(ends, event[starts])


def _slices(text: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trigram cells, bigram cells and the events at which words start, of ``most`` characters of a text
    after another. A slice that begins within a word has no start at its first event."""
    lowered = text.lower() + "\0"
    for at in range(0, len(lowered), most):
        before = min(2, at)  # what the first events are given
        triple, pair, event, first = _cells(_codes(lowered[at - before : at + most]))
        own = event >= before
        yield triple[own], pair[own], np.flatnonzero(first[own])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Models of the languages of ``labelled`` (doc_id, text, lang; null languages are left out).

    Of each language about ``sample`` documents are read, chosen by a hash of id and text, and their
    whole texts counted where they are. What reaches the driver is a count for each used cell and
    language, at most 2 x CELLS numbers a language; the number of languages has no bound.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros((CELLS, 0), np.float32))
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, sample / sizes[lang])) for lang in languages], "lang string, share double")
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    number = {lang: i for i, lang in enumerate(languages)}
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = columns(b, "text", "lang")
            own: dict[str, list[str]] = {}
            for text, lang in zip(texts, langs, strict=True):
                own.setdefault(lang, []).append(text)
            for lang, some in own.items():
                for part in _parts(some):
                    for found in [_events(part)] if len(part) > 1 else _slices(part[0], CHARACTERS):
                        for i, cells in enumerate(found[:2]):
                            used, n = np.unique(cells, return_counts=True)
                            yield batch(schema, used + (2 * number[lang] + i) * CELLS, n)

    sampled = labelled.join(F.broadcast(shares), "lang").where(drawn).select("doc_id", "text", "lang")
    counted = arrow_map(sampled, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
    tables = [np.full((CELLS, len(languages)), np.log(less), np.float32) for less in (SMOOTHING, SMOOTHING * 64)]
    for i, less in enumerate((SMOOTHING, SMOOTHING * 64)):
        own = cell // CELLS % 2 == i
        tables[i][cell[own] % CELLS, cell[own] // CELLS // 2] = np.log(n[own] + less)
    return Model(languages, *tables)


def _parts(texts: list[str], most: int = CHARACTERS) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _expectation(p: np.ndarray, times: np.ndarray, shares: np.ndarray, text_of: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One EM round: new shares, and the log-likelihood under the old ones (up to a constant)."""
    weighted = p * shares[text_of]
    total = weighted.sum(1)
    likelihood = np.add.reduceat(times * np.log(total), starts)
    weighted *= (times / total)[:, None]
    return np.add.reduceat(weighted, starts, axis=0) / n[:, None], likelihood


def _word_scores(triple: np.ndarray, pair: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Log-likelihood of each word under each language; the events are gone through in blocks of words."""
    out = np.empty((len(starts), len(model.languages)))
    most, done = max(1, NUMBERS // len(model.languages)), 0
    while done < len(starts):
        to = max(done + 1, int(np.searchsorted(starts, starts[done] + most)))
        some = slice(starts[done], starts[to] if to < len(starts) else None)
        out[done:to] = np.add.reduceat(model.trigrams[triple[some]] - model.bigrams[pair[some]], starts[done:to] - starts[done], axis=0)
        done = to
    return out


def _long_scores(text: str, model: Model, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores of the different words of a text, how often each occurs, and the text's events. Words are scored in
    slices, so what is held grows with the different words alone."""
    scores, times = np.zeros((0, len(model.languages))), np.zeros(0)
    open_, events = np.zeros((0, len(model.languages))), 0
    for triple, pair, starts in _slices(text, most):
        if not len(triple):
            continue
        events += len(triple)
        continued = not len(starts) or starts[0] > 0
        own = _word_scores(triple, pair, np.append(0, starts) if continued else starts, model)
        if continued:
            own[0] += open_[0]
        else:
            own = np.concatenate([open_, own])
        open_ = own[-1:]
        scores, at = np.unique(np.concatenate([scores, own[:-1]]), axis=0, return_inverse=True)
        times = np.bincount(at.ravel(), np.append(times, np.ones(len(own) - 1)), len(scores))
    return np.concatenate([scores, open_]), np.append(times, np.ones(len(open_))), events


def mixtures(texts: list[str], model: Model, most: int = CHARACTERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language shares of each text under its best language set, its number of words, and its surprise: the
    negative log-likelihood of an event (a letter or a word's end) under those shares, in nats."""
    n_lang = len(model.languages)
    shares, words, surprise = np.zeros((len(texts), n_lang)), np.zeros(len(texts), np.int64), np.zeros(len(texts))
    if not texts or not n_lang:
        return shares, words, surprise
    if len(texts) == 1 and len(texts[0]) > most:
        score, times, events = _long_scores(texts[0], model, most)
        text_of_word = np.zeros(len(score), np.int64)
        events = np.array([events])
    else:
        triple, pair, starts, text_of_word = _events(texts)
        score = _word_scores(triple, pair, starts, model) if len(starts) else np.zeros((0, n_lang))
        times = np.ones(len(starts))
        events = np.bincount(text_of_word, np.diff(starts, append=len(triple)), len(texts))
    if not len(score):
        return shares, words, surprise
    present, first = np.unique(text_of_word, return_index=True)
    n = np.add.reduceat(times, first)
    text_of = np.searchsorted(present, text_of_word)
    highest = score.max(1)
    score -= highest[:, None]
    p = np.exp(np.maximum(score, -60.0))
    best = np.full((len(present), n_lang), 1.0 / n_lang)
    for _ in range(ROUNDS):
        best, full = _expectation(p, times, best, text_of, first, n)
    order = np.argsort(-best, axis=1, kind="stable")
    singles = np.add.reduceat(times[:, None] * np.maximum(score, -60.0), first, axis=0)
    alone = singles.argmax(1)
    chosen = np.zeros_like(best)
    chosen[np.arange(len(present)), alone] = 1.0
    value = singles.max(1)
    likely = value.copy()
    penalty = PENALTY * np.log(np.maximum(n, 2))
    # no set can beat the likelihood of all languages, so most texts are settled here
    open_ = np.flatnonzero((full - penalty > value) & (n > 1))
    for size in range(2, n_lang + 1):
        # a set of this size pays its penalty out of what all languages gain, so this is the end for most
        open_ = open_[full[open_] - (size - 1) * penalty[open_] > value[open_]]
        if not len(open_):
            break
        rows = np.isin(text_of, open_)
        sub_text = np.searchsorted(open_, text_of[rows])
        sub_first = np.flatnonzero(np.diff(sub_text, prepend=-1))
        now = np.zeros((len(open_), n_lang))
        np.put_along_axis(now, order[open_, :size], 1.0 / size, axis=1)
        for _ in range(ROUNDS):
            now, likelihood = _expectation(p[rows], times[rows], now, sub_text, sub_first, n[open_])
        gain = likelihood - (size - 1) * penalty[open_]
        better = gain > value[open_]
        value[open_[better]] = gain[better]
        likely[open_[better]] = likelihood[better]
        chosen[open_[better]] = now[better]
    shares[present] = chosen
    words[present] = n
    surprise[present] = -(likely + np.add.reduceat(times * highest, first)) / events[present]
    return shares, words, surprise


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the predicted language's share), languages (those of the chosen set),
    shares and surprise of every whole text.

    The prediction reads the text alone. A text without a letter, empty or null, and any text
    where nothing was learned, is ``und`` with score 0. Null ids and repeated rows are
    kept; equal shares go to the language first in the alphabet; other columns are ignored. A text
    of more than ``CHARACTERS`` is scored in slices, and what is held of it is a row for each different word.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())), ("surprise", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = columns(b, "doc_id", "text")
            yield batch(schema, ids, *zip(*judge(texts, model), strict=True)) if ids else batch(schema, [], [], [], [], [], [])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>, surprise double")


def judge(texts: list[str | None], model: Model, most: int = CHARACTERS) -> list[tuple[str, float, list[str], list[float], float | None]]:
    """lang_pred, score, languages, shares and surprise (null without a word) of each text."""
    out = []
    most = min(most, max(1, 8 * NUMBERS // max(1, len(model.languages))))
    for part in _parts([t or "" for t in texts], most):
        for s, n, surprise in zip(*mixtures(part, model, most), strict=True):
            if not n or not len(s):
                out.append((UNKNOWN, 0.0, [], [], None))
                continue
            held = [int(i) for i in np.argsort(-s, kind="stable") if s[i] > 0]
            top = min(held, key=lambda i: (-s[i], model.languages[i]))
            out.append((model.languages[top], min(1.0, float(s[top])), [model.languages[i] for i in held], [float(s[i]) for i in held], float(surprise)))
    return out
