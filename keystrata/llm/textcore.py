"""Vectorised text primitives shared by the text operators.

Everything here runs inside an executor on one slice of an Arrow string column: the bytes
of all texts of the slice are looked at together with numpy, so that no Python loop runs
per word.  A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``; those are
single bytes in UTF-8 and never part of a longer character, so cutting bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; bounds the memory of a Python worker.
SLICE_BYTES = 1_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEP = (0xBF58476D1CE4E5B9, 0xA24BAED4963EE407)
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_TABLE = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(m)) for m in _MULT]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept for the largest n asked for so far)."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _STEP[which] | 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            done = 1
            while done < size:
                more = min(done, size - done)
                p[done : done + more] = p[:more] * np.uint64(pow(b, done, 1 << 64))
                done += more
            out.append(p)
        have = _POWERS[which] = (out[0], out[1])
    return have


@dataclass
class Words:
    """The words of a slice: byte spans, 64-bit hashes and, per document, first word and count."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def left_in_doc(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(self.first[-1])


def as_strings(column) -> pa.Array:
    """One array of strings without nulls (null counts as empty) and without an offset."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    return column


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about ``limit`` bytes; a longer text stands alone."""
    offsets = text_offsets(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffer = column.buffers()[1]
    if buffer is None or buffer.size == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (and the last ends)."""
    offsets = text_offsets(column)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = False, which: int = 0) -> Words:
    """Words of every text with a hash; ``which`` picks one of two independent hash functions."""
    data, at = raw(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    if lower:
        data = _LOWER[data]
    ink = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1:n]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1, which)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[which][data] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start])
    return Words(data, at, start, end, h, np.searchsorted(start, at))


def windows(w: Words, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and hash of every run of ``k`` consecutive words of one document."""
    n = len(w.hash)
    at = np.flatnonzero(w.left_in_doc() >= k) if n else np.zeros(0, np.int64)
    return at, window_hash(w.hash, at, k, which)


def window_hash(h: np.ndarray, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the ``k`` word hashes from each position ``at`` on (by prefix sums, whatever ``k``)."""
    n = len(h)
    power, inverse = _powers(n + 1, which)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=total[1:])
    return mix((total[at + k] - total[at]) * inverse[at] + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
