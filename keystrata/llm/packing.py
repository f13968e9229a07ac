"""Packing of documents into training sequences: bounded-space online best fit.

A task holds a fixed number of open windows.  A document's tokens fill whole sequences first;
what is left goes into the open window that it fits best.  If it fits into none, the fullest
window is filled up with the head of the piece (if the gap is worth a piece) and emitted.  At
its end a task pours its open windows together, so that one stays at most; those leftovers
of all tasks are merged by best fit, in blocks of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, exchange, textcore
from .scratch import Scratch

LENGTH, OPEN, LEAST_PIECE, BLOCK = 1024, 48, 8, 256
END_ID = 0

_PIECE = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Open windows of one task.  A piece is ``(doc, start, ids, doc_tokens)``."""

    def __init__(self, base: int, length: int, open_windows: int, least_piece: int):
        self.length, self.limit, self.least = length, open_windows, least_piece
        self.next_id = base
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.length:
            self._emit([self.length, [(doc, at, ids[at : at + self.length], n)]])
            at += self.length
        while at < n:
            need = n - at
            best = fullest = None
            for window in self.open:
                gap = self.length - window[0]
                if gap >= need and (best is None or window[0] > best[0]):
                    best = window
                if fullest is None or window[0] > fullest[0]:
                    fullest = window
            if best is None and len(self.open) < self.limit:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[1].append((doc, at, ids[at:], n))
                best[0] += need
                if best[0] == self.length:
                    self._close(best)
                return
            gap = self.length - fullest[0]
            if gap >= self.least:
                fullest[1].append((doc, at, ids[at : at + gap], n))
                fullest[0] += gap
                at += gap
            self._close(fullest)

    def _close(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self._emit(window)

    def _emit(self, window: list, closed: bool = True) -> None:
        at = 0
        for doc, start, ids, total in window[1]:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.next_id, at, closed))
            at += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Pour the open windows together; the last one may stay unfilled."""
        pool = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        window: list = [0, []]
        for doc, start, ids, total in pool:
            at = 0
            while at < len(ids):
                part = ids[at : at + self.length - window[0]]
                window[1].append((doc, start + at, part, total))
                window[0] += len(part)
                at += len(part)
                if window[0] == self.length:
                    self._emit(window)
                    window = [0, []]
        if window[0]:
            self._emit(window, closed=False)
        self.open = []

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 8
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        self.rows = [] if not self.rows else self.rows
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*_NAMES, "closed"]
        )
        self.rows = []
        return out


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    length: int = LENGTH,
    open_windows: int = OPEN,
    least_piece: int = LEAST_PIECE,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its token ids and then ``END_ID``; null text counts as empty, so that such a
    document is the single end token.  Documents are cut where that avoids padding; each id is
    in exactly one piece.  Repeated rows are packed each for itself.
    """
    path = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.Pieces(bpe.encoder(path))
        packer = Packer(next(exchange.sender_ids()) << 16, length, open_windows, least_piece)
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            ids_of = batch.column("doc_id").to_pylist()
            for a, b in textcore.slices(texts):
                ids, at = coder.encode(*textcore.raw(texts.slice(a, b - a)))
                flat = np.insert(ids.astype("<u4"), at[1:], END_ID)
                at = at + np.arange(len(at))
                for d, lo, hi in zip(ids_of[a:b], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    packer.add(d, flat[lo:hi])
                for w in packer.open:  # else a few ids keep the whole slice in memory
                    w[1] = [(d, s, i.copy() if i.base is not None else i, n) for d, s, i, n in w[1]]
                yield packer.take()
        packer.finish()
        yield packer.take()

    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(docs.select("doc_id", "text").mapInArrow(run, f"{_PIECE}, closed boolean"), "pieces")
    leftovers = pieces.where("NOT closed").withColumn("block", F.shiftright("sequence_id", 40) / BLOCK)
    merged = (
        leftovers.withColumn("block", F.col("block").cast("long"))
        .groupBy("block")
        .applyInArrow(lambda t: merge_leftovers(t, length), _PIECE)
    )
    return pieces.where("closed").drop("closed").unionByName(merged)


def merge_leftovers(table: pa.Table, length: int) -> pa.Table:
    """Put whole unfilled windows together, the largest first, each where it fits best."""
    used: dict[int, int] = {}
    for s, n in zip(table["sequence_id"].to_pylist(), table["length"].to_pylist(), strict=True):
        used[s] = used.get(s, 0) + n
    bins: list[list[int]] = []  # [filled, sequence id]
    moved: dict[int, tuple[int, int]] = {}
    for s in sorted(used, key=lambda s: (-used[s], s)):
        fits = [b for b in bins if b[0] + used[s] <= length]
        if fits:
            best = max(fits)
        else:
            best = [0, s]
            bins.append(best)
        moved[s] = (best[1], best[0])
        best[0] += used[s]
    old = table["sequence_id"].to_pylist()
    offsets = [moved[s][1] + o for s, o in zip(old, table["offset"].to_pylist(), strict=True)]
    out = table.select(_NAMES)
    out = out.set_column(5, "sequence_id", pa.array([moved[s][0] for s in old], pa.int64()))
    return out.set_column(6, "offset", pa.array(offsets, pa.int64()))
