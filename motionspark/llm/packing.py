"""Operator 1: bounded-space online packing of documents into fixed-length token sequences.

Each input partition keeps a fixed number of open windows. What is left of a document after its full windows goes to the
window it fits best (least room left over). When none fits, the fullest window takes a cut of it, is emitted, and the
rest opens a new window. At the end a partition merges its open windows into full ones; the partial one that stays is
merged with those of other partitions, and the last tail of such a merge is cut into lengths that are powers of two,
which need no padding. Texts are never shuffled: only the partial windows are (under one window a partition).

Edge cases: a null or empty text is a document of the end id alone; a null doc_id is kept as null; repeated rows are
packed as often as they come (each counts its own ``start`` from 0); an empty table gives no rows; other columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import Rows, materialise, small_batches
from motionspark.llm.tokens import encoder

#: Input partitions whose partial windows are merged together.
MERGE_PARTITIONS = 256
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("input_partition", pa.int64()), ("partial", pa.bool_()),
    ]
)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, input_partition long, partial boolean"


class Window:
    """An open sequence: pieces (doc_id, start, doc_tokens, ids) and the tokens they hold."""

    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces, self.used = [], 0

    def put(self, doc_id, start, total, ids) -> None:
        self.pieces.append((doc_id, start, total, ids))
        self.used += len(ids) // 4


class Packer:
    """Packs documents one by one; ``emit(window)`` gets every finished window."""

    def __init__(self, length: int, windows: int, emit):
        self.length, self.most, self.emit = length, windows, emit
        self.open: list[Window] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, self.length * 4
        at = 0
        while len(ids) - at >= step:
            full = Window()
            full.put(doc_id, at // 4, total, ids[at : at + step])
            self.emit(full)
            at += step
        rest = (len(ids) - at) // 4
        if not rest:
            return
        fits = [w for w in self.open if self.length - w.used >= rest]
        if fits:
            best = max(fits, key=lambda w: w.used)
        elif len(self.open) < self.most:
            best = Window()
            self.open.append(best)
        else:
            fullest = max(self.open, key=lambda w: w.used)
            cut = (self.length - fullest.used) * 4
            fullest.put(doc_id, at // 4, total, ids[at : at + cut])
            self._close(fullest)
            at += cut
            best = Window()
            self.open.append(best)
        best.put(doc_id, at // 4, total, ids[at:])
        if best.used == self.length:
            self._close(best)

    def _close(self, window: Window) -> None:
        self.open.remove(window)
        self.emit(window)

    def merge(self) -> Window | None:
        """Joins the open windows into full ones, fullest first; returns the partial one that stays."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w.used) for p in w.pieces]
        self.open = []
        return joined(pieces, self.length, self.emit)


def joined(pieces, length: int, emit) -> Window | None:
    window = Window()
    for doc_id, start, total, ids in pieces:
        while ids:
            cut = (length - window.used) * 4
            window.put(doc_id, start, total, ids[:cut])
            start, ids = start + len(ids[:cut]) // 4, ids[cut:]
            if window.used == length:
                emit(window)
                window = Window()
    return window if window.used else None


def tail(window: Window, emit) -> None:
    """Cuts a partial window into windows whose lengths are powers of two, the longest first."""
    pieces, left = window.pieces, window.used
    while left:
        size = 1 << (left.bit_length() - 1)
        done: list[Window] = []
        rest = joined(pieces, size, done.append) if left > size else None
        if not done:
            done, rest = [Window()], None
            for p in pieces:
                done[0].put(*p)
        emit(done[0])
        pieces = [p for w in done[1:] for p in w.pieces] + (rest.pieces if rest else [])
        left -= size


def rows_of(window: Window, sequence: int, partition: int, partial: bool):
    offset = 0
    for doc_id, start, total, ids in window.pieces:
        yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids, partition, partial
        offset += len(ids) // 4


def pack(docs: DataFrame, vocab: str, blanks: str = "dropped", end_id: int = 1, length: int = 2048, windows: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (binary,
    little-endian unsigned 32-bit). The pieces are written once to the shared folder; columns that are not asked for
    later are not read again."""
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc, partition = encoder(vocab, blanks), TaskContext.get().partitionId()
        ready, sequence, rows = [], [partition << 32], Rows(PIECES)
        packer = Packer(length, windows, ready.append)

        def flush(partial=False):
            for window in ready:
                for row in rows_of(window, sequence[0], partition, partial):
                    if rows.add(*row, size=len(row[7])):
                        yield rows.take()
                sequence[0] += 1
            ready.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, enc.encode(text.as_py() or "") + end)
                if ready:
                    yield from flush()
        last = packer.merge()
        yield from flush()
        if last:
            ready.append(last)
            yield from flush(partial=True)
        if rows.columns[0]:
            yield rows.take()

    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
    pieces = materialise(first, "packed")

    def merge(key, table):
        group, rows, ready = key[0].as_py(), Rows(PIECES), []
        held = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        last = joined([(r["doc_id"], r["start"], r["doc_tokens"], r["ids"]) for r in held], length, ready.append)
        if last:
            tail(last, ready.append)
        for n, window in enumerate(ready):
            for row in rows_of(window, (1 << 62) + (group << 32) + n, -1, False):
                rows.add(*row)
        return pa.Table.from_batches([rows.take()], PIECES)

    group = F.floor(F.col("input_partition") / MERGE_PARTITIONS).cast("long")
    merged = pieces.filter("partial").groupBy(group.alias("merge_group")).applyInArrow(merge, SCHEMA)
    return pieces.filter("not partial").unionByName(merged).drop("input_partition", "partial")
