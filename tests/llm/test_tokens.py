"""BPE and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import table, texts

from keystrata.llm import bpe, packing, textcore


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_odd_texts_and_small_chunks(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_MEAN", 8)
    monkeypatch.setattr(bpe, "CHUNK_LEAST", 4)
    monkeypatch.setattr(bpe, "ROLL", 6)
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "word", "é", "ß", " ", " ", "　", "1", "23", "'s", "'ll", ".", "!", "<|endoftext|>"]
    parts += ["中", "文", "\u0085", "\x1c", "\x00", "😀", "​", "«", "the ", " of", " the theme"]
    vocabulary = bpe.Encoder(bpe.default_vocabulary())
    whole, chunks = bpe.Pieces(vocabulary, 500), bpe.ChunkCoder(vocabulary)
    chunks.whole.limit = chunks.joins.limit = 500
    for _ in range(250):
        group = ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(3)]
        data = textcore.raw(pa.array(group))
        ids, at = whole.encode(*data)
        by_chunk = chunks.encode(*data)
        for i, text in enumerate(group):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[at[i] : at[i + 1]].tolist() == want == by_chunk[i].tolist()
            assert bpe.decode(vocabulary, want) == library.decode(want, skip_special_tokens=False)
    assert chunks.reused > 0


def test_digests_and_round_trip(spark, library):
    rows = list(enumerate(texts()))
    docs = table(spark, rows)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want
    back = bpe.decode_ids(bpe.encode_texts(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in rows}
    assert bpe.encode_decode(table(spark, [(None, "x"), (1, "y"), (1, "y")])).count() == 3
    assert bpe.encode_decode(table(spark, [])).count() == 0


@pytest.mark.parametrize("windows", [1, 4, 48])
def test_every_id_lies_in_one_piece(spark, library, windows):
    rows = list(enumerate(texts()))
    pieces = packing.pack(table(spark, rows), open_windows=windows, length=256).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    sequences = {}
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length > 0 and p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        seen[p.doc_id][p.start : p.start + p.length] += 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all((x == 1).all() for x in seen.values())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    full = sum(map(len, ids.values()))
    assert len(sequences) * 256 - full <= 0.03 * full + 2 * 256


def test_packing_of_nothing_and_of_repeated_rows(spark):
    assert packing.pack(table(spark, [])).count() == 0
    pieces = packing.pack(table(spark, [(1, None), (1, None), (2, "a b")])).collect()
    assert sorted((p.doc_id, p.length) for p in pieces) == [(1, 1), (1, 1), (2, 3)]


def test_leftovers_are_put_together():
    rows = [(1, 0, n, 0, n, s, 0) for s, n in enumerate([600, 500, 400, 300, 200, 24])]
    kinds = dict(zip(packing._NAMES, zip(*rows)))
    out = packing.merge_leftovers(pa.table({k: pa.array(v, pa.int64()) for k, v in kinds.items()}), 1024).to_pylist()
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(used) == 2 and sorted(sum(n for _, n in v) for v in used.values()) == [1000, 1024]
