import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, lower, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import exchange, textcore


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.sampled_from([1, 2**10, 2**40]))
def test_rice_codes_round_trip(values, scale):
    keys = np.unique(np.array([v // scale for v in values], np.uint64))
    assert (exchange.rice_decode(exchange.rice_encode(keys)) == keys).all()


def test_words_are_those_of_the_pattern():
    rows = [t or "" for t in texts()]
    w = textcore.words(pa.array(rows), lower=True)
    want = [[x.encode() for x in WORD.findall(lower(t))] for t in rows]
    data = w.data.tobytes()
    got = [[data[a:b] for a, b in zip(w.start[f:g], w.end[f:g])] for f, g in zip(w.first[:-1], w.first[1:])]
    assert got == want
    by_hash = {}
    for word, h in zip((x for d in got for x in d), w.hash.tolist()):
        assert by_hash.setdefault(h, word) == word
    assert len(by_hash) == len({x for d in got for x in d})


def test_windows_hash_content_not_place():
    w = textcore.words(pa.array(["a b c d e f", "z a b c d e f", "a b c d e g"]))
    at, h = textcore.windows(w, 5)
    assert len(at) == 2 + 3 + 2 and h[0] == h[3] and h[1] == h[4] and h[0] == h[5] and h[1] != h[6]


def test_slices_cover_all_rows():
    column = pa.array(["x" * n for n in (5, 0, 100, 3, 3, 3, 50)])
    found = list(textcore.slices(column, 10))
    assert [i for a, b in found for i in range(a, b)] == list(range(7)) and len(found) > 2


def test_duplicates_across_senders(spark):
    keys = {0: [1, 5, 2**63], 1: [5, 9], 2: [2**63, 2**64 - 1], 3: []}
    rows = []
    for sender, own in keys.items():
        for r in exchange.messages(sender, 3, np.array(own, np.uint64), {}).to_pylist():
            rows.append((sender, r["owner"], bytearray(r["keys"])))
    df = spark.createDataFrame(rows, "sender long, owner int, keys binary")
    again = set()
    for r in exchange.duplicates(df).collect():
        own = next(x[2] for x in rows if x[:2] == (r.sender, r.owner))
        decoded = exchange.rice_decode(bytes(own))
        again |= {(r.sender, int(k)) for k, b in zip(decoded, exchange.bits(bytes(r.dup), len(decoded))) if b}
    assert again == {(0, 5), (1, 5), (0, 2**63), (2, 2**63)}


def test_repeats_within_a_sender():
    batch = exchange.messages(7, 2, np.array([3, 9, 3], np.uint64), {"doc": np.array([10, 11, 12], "<i8")})
    found = exchange.repeated(pa.Table.from_batches([batch]), pa.table({"owner": pa.array([], pa.int32()), "dup": pa.array([], pa.binary())}), {"doc": "<i8"})
    assert found["key"].tolist() == [3, 3] and sorted(found["doc"].tolist()) == [10, 12]


@pytest.mark.parametrize("n", [1, 2, 5, 64])
def test_deal_covers_the_key_space(n):
    keys = np.array([0, 1, 2**32, 2**63, 2**64 - 1], np.uint64)
    cuts = exchange.deal(keys, n)
    assert cuts[0] == 0 and cuts[-1] == 5 and (np.diff(cuts) >= 0).all() and len(cuts) == n + 1
