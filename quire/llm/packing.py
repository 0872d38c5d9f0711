"""Packing: token windows of nearly equal size by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .differencing import difference
from .frames import arrow_map, batch, columns
from .tokens import BYTE_VOCABULARY, ByteIds, per_worker

CAPACITY = 2048
#: Windows that are balanced against each other at once.
BLOCK = 256
#: The longest of the small pieces that even out the windows.
FINE = 256
END = (1).to_bytes(4, "little")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` tokens; a row for each piece.

    A document's ids end with id 1. What fills whole sequences is cut off from its start; the
    rest goes as two pieces, a large and a small one, into a block, and each block is
    split by multiway differencing into ceil(total / capacity) nearly equal windows. What
    a window has above the capacity is cut off and goes where there is room: as documents may be cut, the count of windows
    need not rise where it is exceeded. Every partition packs what it reads, so nothing is
    shuffled, no block is larger than ``block`` windows, and a task that is run again
    on the same rows gives the same rows. Sequence ids are unique over all partitions.

    A null or empty text has one token, the end id. A null doc_id stays null. Repeated rows
    are packed as often as they occur. An empty table gives no rows. Columns other than
    doc_id and text are neither read nor returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(ByteIds, vocabulary)
        packer = _Packer(capacity, block, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        for b in batches:
            for doc_id, text in zip(*columns(b, "doc_id", "text"), strict=True):
                packer.add(doc_id, ids_of(text or "") + END)
                if packer.waiting >= block * capacity:
                    packer.settle()
                if len(packer.rows) >= 20_000:
                    yield packer.taken()
        packer.settle()
        yield packer.taken()

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)


class _Packer:
    def __init__(self, capacity: int, block: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.rows: list[tuple] = []
        self.pieces: list[tuple] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.capacity
        for start in range(0, whole, self.capacity):
            self.rows.append((*_piece(doc_id, ids, start, self.capacity, n), self.sequence, 0))
            self.sequence += 1
        if whole < n:
            fine = min(n - whole - 1, _fine(ids))
            for start, end in ((whole, n - fine), (n - fine, n)):
                if start < end:
                    self.pieces.append((doc_id, ids, start, end - start, n))
            self.waiting += n - whole

    def settle(self) -> None:
        """Give every waiting piece its window and offset."""
        sizes = [p[3] for p in self.pieces]
        for members in _levelled(sizes, difference(sizes, -(-sum(sizes) // self.capacity)), self.capacity) if sizes else []:
            offset = 0
            for i, skip, length in members:
                doc_id, ids, start, _, n = self.pieces[i]
                self.rows.append((*_piece(doc_id, ids, start + skip, length, n), self.sequence, offset))
                offset += length
            self.sequence += 1
        self.pieces, self.waiting = [], 0

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return batch(_ARROW, *(zip(*rows, strict=True) if rows else [[]] * len(_ARROW)))


def _levelled(sizes: list[int], found: list[tuple[int, list[int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """(item, start in the item, length) for each window, none above ``capacity``.

    A window's excess is cut from its largest items' ends, and the parts fill the lightest windows.
    The windows must have room for all items together.
    """
    out, cut = [], []
    for total, items in found:
        excess, members = total - capacity, []
        for i in sorted(items, key=lambda i: -sizes[i]):
            off = min(max(0, excess), sizes[i])
            excess -= off
            if off:
                cut.append((i, sizes[i] - off, off))
            if off < sizes[i]:
                members.append((i, 0, sizes[i] - off))
        out.append(members)
    room = sorted((sum(m[2] for m in members), w) for w, members in enumerate(out))
    at = 0
    for i, start, length in sorted(cut, key=lambda c: -c[2]):
        while length:
            used, w = room[at]
            part = min(length, capacity - used)
            if part:
                out[w].append((i, start, part))
                room[at] = (used + part, w)
            start, length = start + part, length - part
            at += used + part == capacity
    return [members for members in out if members]


def _fine(ids: bytes) -> int:
    """Length of a document's small piece: 1 to FINE, with as many below 16 as above."""
    share = zlib.crc32(ids) / 2**32
    return int(FINE**share)


def _piece(doc_id: int | None, ids: bytes, start: int, length: int, n: int) -> tuple:
    return doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n
