"""Golomb-coded exchange of hashed keys.

A *sender* is one bounded batch of a task.  It sorts its distinct 64-bit keys, deals them to
*owners* by range and sends each owner one message: the Rice-coded gaps between its keys.
An owner sees every key of its range once per sender, however often the sender has it, so a
key that a third of all rows share costs one entry per sender.  It answers each message with a
bitmap that says which of the keys other senders have as well.

Messages lie in a table that has been written before, so that the answers refer to what is
stored and not to what a repeated task might compute.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Distinct keys after which a task closes a sender and begins another.
SENDER_KEYS = 1_500_000
_SPAN = 1 << 64


def rice_encode(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64 keys as: count (4 bytes), k (1), first key (8), unary bits, k-bit rests."""
    n = len(keys)
    if n == 0:
        return b""
    gaps = np.diff(keys) - np.uint64(1)
    mean = float(gaps.astype(np.float64).mean()) if n > 1 else 0.0
    k = min(62, max(0, int(np.log2(mean * 0.69)))) if mean > 1.5 else 0
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(high.sum()) + n - 1, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 0
    head = n.to_bytes(4, "little") + bytes([k]) + int(keys[0]).to_bytes(8, "little")
    return head + len(unary).to_bytes(4, "little") + np.packbits(unary).tobytes() + _pack(gaps, k)


def rice_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k = int.from_bytes(code[:4], "little"), code[4]
    first, bits = int.from_bytes(code[5:13], "little"), int.from_bytes(code[13:17], "little")
    to = 17 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(code, np.uint8, to - 17, 17), count=bits)
    stops = np.flatnonzero(unary == 0)
    high = np.diff(stops, prepend=-1) - 1
    gaps = (high.astype(np.uint64) << np.uint64(k)) + _unpack(code[to:], n - 1, k)
    out = np.empty(n, np.uint64)
    out[0] = first
    np.cumsum(gaps + np.uint64(1), out=out[1:])
    out[1:] += np.uint64(first)
    return out


def _pack(values: np.ndarray, k: int) -> bytes:
    if k == 0 or len(values) == 0:
        return b""
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8 values ends on a whole byte
        bits = np.unpackbits(values[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(np.packbits(bits[:, 64 - k :].reshape(-1)).tobytes())
    return b"".join(out)


def _unpack(code: bytes, n: int, k: int) -> np.ndarray:
    if k == 0 or n == 0:
        return np.zeros(n, np.uint64)
    data, out = np.frombuffer(code, np.uint8), np.empty(n, np.uint64)
    for at in range(0, n, 1 << 16):
        m = min(1 << 16, n - at)
        bits = np.unpackbits(data[at * k // 8 : (at * k + m * k + 7) // 8], count=m * k).reshape(m, k)
        wide = np.zeros((m, 64), np.uint8)
        wide[:, 64 - k :] = bits
        out[at : at + m] = np.packbits(wide, axis=1).view(">u8").reshape(-1)
    return out


def deal(keys: np.ndarray, n_owners: int) -> np.ndarray:
    """For sorted keys, where each owner's range begins (and the last ends)."""
    edges = np.array([i * _SPAN // n_owners for i in range(1, n_owners)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def duplicates(messages: DataFrame) -> DataFrame:
    """Answers to ``(sender, owner, keys)`` messages: ``(sender, owner, dup)``.

    Bit i of ``dup`` (most significant first, as ``numpy.packbits`` has it) tells whether
    another sender has the i-th key of the message too.
    """

    def answer(table: pa.Table) -> pa.Table:
        decoded = [rice_decode(x) for x in table["keys"].to_pylist()]
        sizes = np.array([len(x) for x in decoded], np.int64)
        every = np.concatenate(decoded)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(every), bool)
        twice[:-1] |= same
        twice[1:] |= same
        flags = np.zeros(len(every), bool)
        flags[order] = twice
        ends = np.cumsum(sizes)
        bits = [np.packbits(flags[e - s : e]).tobytes() for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.table({"sender": table["sender"], "owner": table["owner"], "dup": pa.array(bits, pa.binary())})

    return (
        messages.select("sender", "owner", "keys")
        .groupBy("owner")
        .applyInArrow(answer, "sender long, owner int, dup binary")
    )


def with_answers(stored: DataFrame) -> DataFrame:
    """The stored messages, each beside its answer."""
    return stored.join(duplicates(stored), ["sender", "owner"])


def bits(dup: bytes | None, n: int) -> np.ndarray:
    if dup is None:
        return np.zeros(n, bool)
    return np.unpackbits(np.frombuffer(dup, np.uint8), count=n).astype(bool)


def sender_ids() -> Iterator[int]:
    """Ids that no other task of the job gives out."""
    from pyspark import TaskContext

    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 24
    while True:
        yield at
        at += 1


MESSAGE = "sender long, owner int, n int, m int, keys binary, fresh binary"


def messages(sender: int, n_owners: int, keys: np.ndarray, payload: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The rows of one sender: per owner the coded distinct keys and what lies behind them.

    The ``m`` occurrences stand in the order of their ``n`` distinct keys; ``fresh`` has one bit for
    each, set where another key begins.  Every payload array becomes a binary column.
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    payload = {name: values[order] for name, values in payload.items()}
    cuts = deal(keys, n_owners)
    columns: dict[str, list] = {name: [] for name in ("owner", "n", "m", "keys", "fresh", *payload)}
    for owner in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[owner], cuts[owner + 1]
        own = keys[a:b]
        fresh = np.ones(b - a, bool)
        fresh[1:] = own[1:] != own[:-1]
        columns["owner"].append(owner)
        columns["n"].append(int(fresh.sum()))
        columns["m"].append(int(b - a))
        columns["keys"].append(rice_encode(own[fresh]))
        columns["fresh"].append(np.packbits(fresh).tobytes())
        for name, values in payload.items():
            columns[name].append(values[a:b].tobytes())
    n = len(columns["owner"])
    arrays = [pa.array([sender] * n, pa.int64())]
    for name, values in columns.items():
        arrays.append(pa.array(values, pa.int32() if name in ("owner", "n", "m") else pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["sender", *columns])


def repeated(stored: pa.Table, answers: pa.Table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """Of one sender's messages, the occurrences whose key is also elsewhere: ``key`` and payload."""
    stored = stored.filter(pc.greater_equal(stored["owner"], 0))
    reply = dict(zip(answers["owner"].to_pylist(), answers["dup"].to_pylist(), strict=True))
    found: dict[str, list[np.ndarray]] = {name: [] for name in ("key", *kinds)}
    columns = {name: stored[name].to_pylist() for name in ("owner", "n", "m", "keys", "fresh", *kinds)}
    for i, owner in enumerate(columns["owner"]):
        rank = np.cumsum(bits(columns["fresh"][i], columns["m"][i])) - 1
        again = bits(reply.get(owner), columns["n"][i]) | (np.bincount(rank, minlength=columns["n"][i]) > 1)
        hit = again[rank]
        if not hit.any():
            continue
        found["key"].append(rice_decode(columns["keys"][i])[rank[hit]])
        for name, kind in kinds.items():
            found[name].append(np.frombuffer(columns[name][i], kind)[hit])
    return {
        name: np.concatenate(v) if v else np.zeros(0, np.uint64 if name == "key" else kinds[name])
        for name, v in found.items()
    }


def settle(stored: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows, answers)`` for every sender; both are bounded by what a sender holds.

    Rows are its messages, and rows of its own with an ``owner`` below 0 that owners do not see.
    """
    answers = duplicates(stored.where("owner >= 0"))
    return stored.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(run, schema)
