"""Byte-level BPE: a fast exact encoder, and encoding with content-defined chunk reuse.

The encoder uses that a single pre-token is encoded the same wherever it stands, and that the
pre-tokenisation always begins a token at a space before a visible character (*safe cut*).
Texts are cut at all safe cuts, distinct pieces are encoded once per worker, and ids are
gathered by piece.

:func:`encode_decode` reuses larger units.  A rolling hash over the last bytes defines chunk
ends, so shared passages fall into the same chunks wherever they stand.  A chunk that was met
before by the worker, in whatever document, is not encoded again.  Tokens may span a chunk's
ends, so each join is repaired: the text around it is encoded anew between a cut in either
chunk, and the window grows cut by cut until its ends fall on token boundaries of both chunks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textcore
from .scratch import reach

#: Distinct pieces, and bytes of distinct chunks, that a worker remembers.
PIECES = 400_000
CHUNK_BYTES = 24_000_000
#: Chunk ends: one byte in so many on average, judged by the bytes before it.
CHUNK_MEAN, CHUNK_LEAST, ROLL = 1024, 64, 48
#: Letters, digits, and so on, as the vocabulary's pre-tokeniser splits them (fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_symbol() -> dict[str, int]:
    """Vocabulary files write each byte as a visible character: itself, or the next from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """A vocabulary file, and the ids of single pieces by it."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        byte = _byte_of_symbol()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t.encode() not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in [*ranks.items(), *self.special.items()]:
            self.bytes[i] = t
        self.length = np.array([len(t) for t in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.kind = np.uint16 if size <= 65536 else np.uint32
        self._plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode_piece(self, piece: bytes) -> list[int]:
        out, at = [], 0
        while True:
            found = min(((i, s) for s in self.special if (i := piece.find(s, at)) >= 0), default=None)
            if found is None:
                return out + self._plain.encode_ordinary(piece[at:].decode())
            out += self._plain.encode_ordinary(piece[at : found[0]].decode())
            out.append(self.special[found[1]])
            at = found[0] + len(found[1])

    def encode_joined(self, pieces: np.ndarray) -> np.ndarray:
        """Ids of pieces without special tokens that all open with a safe cut, in one go."""
        return np.array(self._plain.encode_ordinary(pieces.tobytes().decode()), self.kind)


class Pieces:
    """Ids of many texts at once, equal to those of the tokenizers library for the same file.

    Remembers the ids of up to ``limit`` distinct pieces.
    """

    def __init__(self, coder: Encoder, limit: int = PIECES):
        self.coder, self.limit = coder, limit
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.binary())
        self._first, self._count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids = np.zeros(0, self.coder.kind)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Remember the ids of distinct new pieces; returns the number that each has from now on.

        Those that open with a safe cut are encoded in one text and told apart again by their
        lengths; the others, such as the first of a text, one by one.
        """
        coder = self.coder
        data, at = textcore.raw(pieces)
        padded = np.append(data, [0, 0])
        safe = (np.diff(at) > 1) & (padded[at[:-1]] == 32) & _VISIBLE[padded[at[:-1] + 1]]
        if any(data.tobytes().find(s) >= 0 for s in coder.special):
            safe &= np.array([not any(s in p for s in coder.special) for p in pieces.to_pylist()], bool)
        chosen = pieces.filter(pa.array(safe))
        joined, sizes = textcore.raw(chosen)
        ids = coder.encode_joined(joined)
        stops = np.searchsorted(np.cumsum(coder.length[ids]), sizes[1:]) + 1
        rest = pieces.filter(pa.array(~safe))
        more = [coder.encode_piece(p) for p in rest.to_pylist()]
        counts = np.concatenate((np.diff(stops, prepend=0), [len(x) for x in more])).astype(np.int64)
        flat = np.array([i for x in more for i in x], coder.kind)
        number = np.empty(len(pieces), np.int64)
        base = len(self._known)
        number[safe] = base + np.arange(len(chosen))
        number[~safe] = base + len(chosen) + np.arange(len(rest))
        self._known = pa.concat_arrays([self._known, chosen, rest])
        self._first = np.concatenate((self._first, len(self._ids) + np.cumsum(counts) - counts))
        self._count = np.concatenate((self._count, counts))
        self._ids = np.concatenate((self._ids, ids, flat))
        return number

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[at[i]:at[i + 1]]`` one after the other, and where each text's begin."""
        begin = np.zeros(len(data) + 1, bool)
        begin[safe_cuts(data)] = True
        begin[at] = True
        begin[len(data)] = False
        begins = np.flatnonzero(begin)
        if len(begins) == 0:
            return np.zeros(0, self.coder.kind), np.zeros(len(at), np.int64)
        offsets = np.append(begins, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = pieces.dictionary
        if len(self._known) > self.limit:
            self._forget()
        place = pc.index_in(distinct, value_set=self._known)
        number = place.fill_null(-1).to_numpy().astype(np.int64)
        if place.null_count:
            number[number < 0] = self._learn(distinct.filter(place.is_null()))
        which = number[pieces.indices.to_numpy()]
        count = self._count[which]
        total = np.concatenate(([0], np.cumsum(count)))
        shift = np.repeat(self._first[which] - total[:-1], count)
        ids = self._ids[np.arange(total[-1]) + shift]
        return ids, total[np.searchsorted(begins, at)]


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Where a space stands before a byte that surely begins a visible character.

    Bytes that may begin other white space (U+0085, U+00A0, U+1680, U+2000 and on, U+3000) and
    control characters are left out; that only makes pieces longer.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[:-1] == 32) & _VISIBLE[data[1:]])


_VISIBLE = np.ones(256, bool)
_VISIBLE[:33] = False
_VISIBLE[[127, 0xC2, 0xE1, 0xE2, 0xE3]] = False


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary; the path names a file that every executor has."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_GEAR = textcore.mix(np.arange(1001, 1257, dtype=np.uint64))


def chunk_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Chunk ends of every text by a rolling hash of ``ROLL`` bytes, text ends included.

    A chunk ends where the bytes before hash to the wanted pattern, never inside a character.
    """
    n = len(data)
    power, inverse = textcore._powers(n + 1, 0)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_GEAR[data] * power[:n], out=total[1:])
    if n <= ROLL:
        return np.unique(at[1:])
    roll = (total[ROLL:n] - total[: n - ROLL]) * inverse[: n - ROLL]
    place = np.flatnonzero(roll >> np.uint64(40) < np.uint64((1 << 24) // CHUNK_MEAN)) + ROLL
    place = place[data[place] & 0xC0 != 0x80]
    begin = at[np.searchsorted(at, place, side="right") - 1]
    place = place[place - begin >= ROLL]
    kept, last = [], -CHUNK_LEAST
    for p in place.tolist():
        if p - last >= CHUNK_LEAST:
            kept.append(p)
            last = p
    return np.unique(np.concatenate((np.array(kept, np.int64), at[1:])))


_NONE = np.zeros(0, np.uint16)


class ChunkCoder:
    """Encodes texts by chunks and keeps the ids of chunks that it has met."""

    def __init__(self, coder: Encoder):
        self.coder = coder
        self.whole, self.joins = Pieces(coder), Pieces(coder, PIECES // 8)
        self.met: dict[bytes, tuple[np.ndarray, int, int]] = {}
        self.size = 0
        self.reused = self.seen = 0

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The ids of every text."""
        ends = chunk_ends(data, at)
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        keep = ends > begins
        begins, ends = begins[keep], ends[keep]
        raw = data.tobytes()
        chunks = [raw[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        self._meet(chunks)
        first = np.searchsorted(begins, at)
        parts = [self.met[c] for c in chunks]
        out: list[list[np.ndarray]] = [[] for _ in range(len(at) - 1)]
        gaps: list[bytes] = []
        slots: list[tuple[int, int]] = []
        for d in range(len(at) - 1):
            self._join(chunks, parts, first[d], first[d + 1], d, out, gaps, slots)
        if gaps:
            sizes = np.concatenate(([0], np.cumsum([len(g) for g in gaps])))
            ids, cut = self.joins.encode(np.frombuffer(b"".join(gaps), np.uint8), sizes)
            for (d, i), a, b in zip(slots, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out[d][i] = ids[a:b]
        self._trim()
        return [np.concatenate(x) if x else np.zeros(0, self.coder.kind) for x in out]

    def _meet(self, chunks: list[bytes]) -> None:
        new = list(dict.fromkeys(c for c in chunks if c not in self.met))
        self.seen += len(chunks)
        self.reused += len(chunks) - len(new)
        if not new:
            return
        sizes = np.concatenate(([0], np.cumsum([len(c) for c in new])))
        data = np.frombuffer(b"".join(new), np.uint8)
        ids, cut = self.whole.encode(data, sizes)
        token_end = np.cumsum(self.coder.length[ids])
        safe = safe_cuts(data)
        ended = np.searchsorted(token_end, safe, side="right")  # tokens up to each cut
        agrees = token_end[ended - 1] == safe if len(safe) else np.zeros(0, bool)
        agrees |= safe == 0
        safe, ended = safe[agrees], ended[agrees]
        low, high = np.searchsorted(safe, sizes[:-1]), np.searchsorted(safe, sizes[1:])
        for c, at, lo, hi in zip(new, sizes[:-1].tolist(), low.tolist(), high.tolist(), strict=True):
            if hi > lo:
                self.met[c] = (ids[ended[lo] : ended[hi - 1]].copy(), int(safe[lo]) - at, int(safe[hi - 1]) - at)
            else:
                self.met[c] = (_NONE, -1, -1)
            self.size += len(c) * 2 + 200

    def _join(self, chunks, parts, lo, hi, d, out, gaps, slots) -> None:
        """Settled ids of each chunk, and between them the texts to encode anew.

        What a chunk keeps lies between its first and its last cut at which its own token
        boundaries agree with those that any context gives.  A chunk without such a cut joins
        the window, which so grows on both sides until there is agreement.
        """
        pending: list[bytes] = []
        for c in range(lo, hi):
            ids, begin, end = parts[c]
            if begin < 0:
                pending.append(chunks[c])
                continue
            pending.append(chunks[c][:begin])
            self._gap(pending, d, out, gaps, slots)
            out[d].append(ids)
            pending = [chunks[c][end:]]
        self._gap(pending, d, out, gaps, slots)

    @staticmethod
    def _gap(pending, d, out, gaps, slots) -> None:
        text = b"".join(pending)
        if text:
            slots.append((d, len(out[d])))
            gaps.append(text)
            out[d].append(_NONE)

    def _trim(self) -> None:
        if self.size > CHUNK_BYTES:
            for c in list(self.met)[: len(self.met) // 2]:
                self.size -= len(c) * 2 + 200
                del self.met[c]


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        chunks = ChunkCoder(coder)
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            for a, b in textcore.slices(texts):
                count, ids_sha, text_sha = [], [], []
                for ids in chunks.encode(*textcore.raw(texts.slice(a, b - a))):
                    listed = ids.tolist()
                    count.append(len(listed))
                    ids_sha.append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, listed)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decode(coder, listed).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(count, pa.int64()),
                        pa.array(ids_sha, pa.string()),
                        pa.array(text_sha, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def decode(coder: Encoder, ids: list[int]) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(coder.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document the number of its tokens and digests of its ids and of the decoded text.

    Null counts as the empty text, which has no tokens.  Other columns of ``docs`` are ignored;
    a null ``doc_id`` stays null; repeated rows give repeated results.  No shuffle.
    """
    reach(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _digests(vocabulary or default_vocabulary()),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def encode_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` for every document."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkCoder(encoder(path))
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            for a, b in textcore.slices(texts):
                ids = [x.astype(np.int32) for x in chunks.encode(*textcore.raw(texts.slice(a, b - a)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    reach(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give null."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [None if x is None else decode(coder, x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    reach(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
