"""Cross-entropy difference: what a target and a background n-gram model lose on each token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import arrow_map, batch, columns, written
from .tokens import BYTE_VOCABULARY, ByteIds, per_worker

#: Ids of the shared vocabulary (the tokenizer's).
IDS = 1 << 16
#: The most frequent bigrams, which workers hold; all others are joined to the documents that have them.
HOT = 1 << 19
#: Pseudo-count of the uniform distribution in a unigram, and of the unigram in a bigram.
UNIFORM = 1.0
BACK_OFF = 4.0
#: Tokens whose bigrams a worker counts before it hands the counts on.
COUNTED_AT_ONCE = 4_000_000
#: Target ids that are sent to every executor; with more, the texts are dealt by id and merged with them.
BROADCAST_IDS = 2_000_000
#: Tokens that are scored at once.
AT_ONCE = 500_000
#: First token of every text, as the context of the second.
BEGIN = 0


def _ids(text: str | None, ids_of) -> np.ndarray:
    return np.frombuffer(ids_of(text or ""), np.uint32).astype(np.int64) % IDS


def _cells(ids: np.ndarray) -> np.ndarray:
    """The bigram of each token with the one before it, one number for each pair."""
    return np.concatenate([[BEGIN], ids[:-1]]).astype(np.int64) * IDS + ids


def tokenized(docs: DataFrame, *keep: str, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """The columns ``keep`` (longs and booleans) and ``ids``: the text's token ids, two bytes each. Written, so that every text is encoded once."""
    docs = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(ByteIds, vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # keeps the ids of a batch small
                some = b.slice(at, 1000)
                ids = pa.array([_ids(t, ids_of).astype(np.uint16).tobytes() for t in some.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], ids], names=[*keep, "ids"])

    fields = [f for f in docs.schema.fields if f.name != "text"]
    return written(arrow_map(docs, run, T.StructType([*fields, T.StructField("ids", T.BinaryType())])), "tokens")


def _slices(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in slices of about ``AT_ONCE`` tokens: their rows, all their bigrams, and where each row's end."""
    sizes = pc.binary_length(b.column("ids")).to_numpy(zero_copy_only=False) // 2
    ends = np.cumsum(sizes)
    done = 0
    while done < len(sizes):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, "right")))
        some = b.slice(done, to - done)
        own = np.cumsum(sizes[done:to])
        ids = np.frombuffer(b"".join(some.column("ids").to_pylist()), np.uint16).astype(np.int64)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.append(0, own[:-1])[sizes[done:to] > 0]] = BEGIN
        yield some, before * IDS + ids, own
        done = to


def counts(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """cell, target and background: token counts over all of ``docs`` (text, in_target)."""
    return _counted(tokenized(docs, "in_target", vocabulary=vocabulary))


def _counted(tokens: DataFrame) -> DataFrame:
    """The counts of ``tokens`` (ids, in_target).

    Cells are unigrams (0 to IDS), contexts (IDS to 2 x IDS) and bigrams (from 2 x IDS on), each pair with a
    cell of its own. They are counted where a document is read; a task hands on a row for each cell
    that a few million of its tokens have, and the rows are summed by cell.
    """
    schema = pa.schema([("cell", pa.int64()), ("target", pa.int64()), ("background", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        size = 0

        def summed() -> pa.RecordBatch:
            found = []
            for k in (True, False):
                pairs, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held[k]]), return_counts=True)
                single = [np.bincount(x, n, IDS).astype(np.int64) for x in (pairs % IDS, pairs // IDS)]
                used = [np.flatnonzero(x) for x in single]
                found.append((np.concatenate([used[0], IDS + used[1], 2 * IDS + pairs]), np.concatenate([single[0][used[0]], single[1][used[1]], n])))
            used = np.union1d(found[0][0], found[1][0])
            both = np.zeros((2, len(used)), np.int64)
            for n, (cells, count) in zip(both, found, strict=True):
                n[np.searchsorted(used, cells)] = count
            return batch(schema, used, *both)

        for b in batches:
            for some, pairs, ends in _slices(b):
                of_target = np.repeat(np.array(some.column("in_target").to_pylist(), bool), np.diff(ends, prepend=0))
                for k in (True, False):
                    held[k].append(pairs[of_target == k])
                size += len(pairs)
                if size >= COUNTED_AT_ONCE:
                    yield summed()
                    held, size = {True: [], False: []}, 0
        yield summed()

    found = arrow_map(tokens.select("ids", "in_target"), run, "cell long, target long, background long")
    return found.groupBy("cell").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


class Slots:
    """Numbers of bigrams by open addressing: a bigram is looked up in a gather or two, many at once."""

    def __init__(self, pairs: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(pairs)).bit_length()))
        self.key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.number = np.zeros(len(self.key), np.int32)
        waiting, slot = np.arange(len(pairs)), self._first(pairs)
        while len(waiting):
            free = self.key[slot] < 0
            self.key[slot[free]] = pairs[waiting[free]]  # of several that want a slot the last gets it
            placed = self.key[slot] == pairs[waiting]
            self.number[slot[placed]] = waiting[placed]
            waiting, slot = waiting[~placed], (slot[~placed] + 1) % len(self.key)

    def _first(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each bigram, -1 for those that aren't held."""
        slot = self._first(pairs)
        key = self.key[slot]
        out = np.where(key == pairs, self.number[slot], -1)
        open_ = np.flatnonzero((key != pairs) & (key >= 0))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) % len(self.key)
            key = self.key[slot]
            hit = key == pairs[open_]
            out[open_[hit]] = self.number[slot[hit]]
            more = ~hit & (key >= 0)
            open_, slot = open_[more], slot[more]
        return out


class Models:
    """Two interpolated bigram models over one vocabulary, smoothed alike.

    The background counts are scaled to the target's number of tokens, so that the same
    pseudo-counts weigh alike in both.
    """

    def __init__(self, cell: np.ndarray, target: np.ndarray, background: np.ndarray):
        """``cell`` has all unigrams and contexts, and those bigrams that the models hold."""
        self.unigram, self.context, self.bigram = [], [], []
        tokens = [max(1.0, float(n[cell < IDS].sum())) for n in (target, background)]
        self.scales = [1.0, tokens[0] / tokens[1]]
        pair = cell >= 2 * IDS
        self.pairs = cell[pair] - 2 * IDS
        self.slots = Slots(self.pairs)
        for n, scale in zip((target, background), self.scales, strict=True):
            full = np.zeros(2 * IDS)
            full[cell[~pair]] = n[~pair] * scale
            total = full[:IDS].sum()
            self.unigram.append((full[:IDS] + UNIFORM / IDS * 1000) / (total + UNIFORM * 1000))
            self.context.append(full[IDS:] + BACK_OFF)
        #: what each bigram held loses under either model
        self.bigram = [self.loss(i, self.pairs, n[pair] * self.scales[i]) for i, n in enumerate((target, background))]

    def loss(self, model: int, pairs: np.ndarray, bigram: np.ndarray | float) -> np.ndarray:
        """Negative log probability under the target (0) or background (1), given the pairs' counts, scaled."""
        return -np.log((bigram + BACK_OFF * self.unigram[model][pairs % IDS]) / self.context[model][pairs // IDS])

    def losses(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative log probability of each token under the target and the background, for models that hold
        every bigram of the corpus; others have count 0."""
        pairs = _cells(ids)
        at = self.slots.find(pairs)
        out = []
        for i in (0, 1):
            loss = self.loss(i, pairs, 0.0)
            loss[at >= 0] = self.bigram[i][at[at >= 0]]
            out.append(loss)
        return tuple(out)


def in_target(docs: DataFrame, target_ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, text and in_target of every document: whether its doc_id is among ``target_ids``; null ids never are.

    The ids are counted first. Up to ``most`` (16 bytes each, or so) they are broadcast and no text moves; with more,
    they are written and both sides are merged by id, so that Spark can split the rows that have no id.
    """
    ids = target_ids.select(F.col("doc_id").alias("target_id")).where("target_id is not null").distinct()
    hint = "broadcast" if ids.limit(most + 1).count() <= most else "merge"
    ids = written(ids, "target") if hint == "merge" else ids
    marked = docs.select("doc_id", "text").join(ids.withColumn("in_target", F.lit(True)).hint(hint), F.col("doc_id") == F.col("target_id"), "left")
    return marked.select("doc_id", "text", F.coalesce("in_target", F.lit(False)).alias("in_target"))


def _most_frequent(pairs: DataFrame, most: int) -> DataFrame:
    """Of the counted pairs the most frequent, ``most`` at the most: those from the least count on, in steps of a sixteenth of a
    doubling, that no more than so many reach. The numbers of pairs by step are about a thousand rows; no pair is sorted."""
    step = F.floor(F.log2(F.col("target") + F.col("background")) * 16)
    least = None
    for at, n in sorted(pairs.groupBy(step.alias("step")).count().collect(), reverse=True):
        most -= n
        if most < 0:
            break
        least = at
    return pairs.where(F.lit(False) if least is None else step >= least)


def score(docs: DataFrame, target_ids: DataFrame, vocabulary: str = BYTE_VOCABULARY, hot: int = HOT, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every whole text.

    The target model is fitted on the documents whose doc_id is in ``target_ids``, the
    background model on all others; both count every token of theirs. The losses are means
    over a text's tokens (nats); the score is target less background, lower for texts more like
    the target. The table of bigram counts is exact and grows with the corpus. Unigrams, contexts and the
    ``HOT`` most frequent bigrams are broadcast; a document's other bigrams, each once with its number, are joined to the table.

    A null or empty text has 0 tokens and null losses and score. A null doc_id is never in the
    target; repeated rows count as often as they occur; an empty target or table makes
    models of the pseudo-counts alone; other columns are ignored.
    """
    tokens = tokenized(in_target(docs, target_ids, broadcast_ids), "doc_id", "in_target", vocabulary=vocabulary)
    counted = written(_counted(tokens), "counts")
    single = counted.where(F.col("cell") < 2 * IDS)
    pairs = counted.where(F.col("cell") >= 2 * IDS)
    most = _most_frequent(pairs, hot)
    table = pa.concat_tables([single.toArrow(), most.toArrow()])
    models = Models(*(table.column(n).to_numpy() for n in ("cell", "target", "background")))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_sum", pa.float64()), ("background_sum", pa.float64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            for some, pairs, ends in _slices(b):
                at = models.slots.find(pairs)
                known = at >= 0
                sums = [np.diff(np.append(0.0, np.cumsum(np.where(known, loss[at], 0.0) if len(loss) else np.zeros(len(at))))[np.append(0, ends)]) for loss in models.bigram]
                # a row's other bigrams, each once
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[~known]
                other, times = np.unique((row << 32) | pairs[~known], return_counts=True)
                bounds = pa.array(np.searchsorted(other >> 32, np.arange(len(ends) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (other & 0xFFFFFFFF, times)]
                yield batch(schema, some.column("doc_id"), np.diff(ends, prepend=0), *sums, *lists)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            own = b.column("cell").to_numpy() - 2 * IDS
            losses = [models.loss(i, own, b.column(n).to_numpy() * models.scales[i]) for i, n in enumerate(("target", "background"))]
            yield batch(_RARE, own, *losses)

    found = arrow_map(tokens.select("doc_id", "ids"), run, "doc_id long, n_tokens long, target_sum double, background_sum double, pairs array<long>, times array<long>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "found")
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    kept = each.join(arrow_map(pairs, rare, "pair long, target_loss double, background_loss double").hint("merge"), "pair")
    rest = kept.groupBy("row").agg(F.sum(F.col("times") * F.col("target_loss")).alias("target_rest"), F.sum(F.col("times") * F.col("background_loss")).alias("background_rest"))
    mean = lambda name: (F.col(f"{name}_sum") + F.coalesce(f"{name}_rest", F.lit(0.0))) / F.nullif(F.col("n_tokens"), F.lit(0))
    out = found.join(rest.hint("merge"), "row", "left").select("doc_id", "n_tokens", mean("target").alias("target_loss"), mean("background").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


_RARE = pa.schema([("pair", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])
