"""Substring dedup: level-wise doubling of repeated windows.

The ladder of lengths ends at the wanted window and halves (rounding up) below it.  At the
lowest rung only content-selected windows are looked at: the ones with the smallest hash among
all that one wanted window spans.  Equal wanted windows select equal ones at equal places, so
nothing is lost, at a fraction of the positions.  A rung's windows that occur twice or more are
extended to the next length; those that occur once drop out.  The ladder ends at the wanted
length or when no candidate survives.

Counting is done by the hash exchange, with keys of 64 bits at each rung.  The last rung hashes
words by another function than the rungs below, so what is removed has agreed in two independent hashes.

A row is known by its ``doc_id`` and the hash of its text, so that positions of one text are never
applied to another with the same id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, textcore
from .scratch import Scratch, owners, rows_with

WINDOW = 35


def ladder(window: int, least: int = 12) -> list[int]:
    """Lengths from the lowest rung up: each is at most twice the one before."""
    out = [window]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding(values: np.ndarray, k: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over every ``k`` consecutive values (by doubling; log2(k) passes)."""
    have, width = values, 1
    while width * 2 <= k:
        have = pick(have[:-width], have[width:])
        width *= 2
    rest = k - width
    return pick(have[:-rest], have[rest:]) if rest else have


def selected(w: textcore.Words, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``length``-word windows, smallest hash per wanted window, and which are selected.

    The first array has an entry per word (the largest value where no window fits), the second
    one per wanted window start (0 where none fits).
    """
    n = len(w.hash)
    top = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at, h = textcore.windows(w, length)
    top[at] = np.minimum(h, np.uint64(np.iinfo(np.uint64).max - 1))
    span = window - length + 1
    least = np.zeros(n, np.uint64)
    if n >= span:
        least[: n - span + 1] = sliding(top, span)
    least[w.left_in_doc() < window] = 0
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least))
    wanted = sliding(padded, span, np.maximum) if n else least  # the largest minimum of all windows around
    return top, least, (wanted == top) & (wanted > 0)


class _Batch:
    """Keys with document and position, handed on as messages when there are enough."""

    def __init__(self, n_owners: int):
        self.ids, self.n_owners = exchange.sender_ids(), n_owners
        self._clear()

    def _clear(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.n_docs = 0

    def add(self, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        """``doc`` is the place of a key's document in ``ids`` and ``hashes``."""
        busy, place = np.unique(doc, return_inverse=True)
        self.held.append((keys, (self.n_docs + place).astype("<u4"), pos.astype("<u4")))
        self.docs.append((ids[busy], hashes[busy]))
        self.size += len(keys)
        self.n_docs += len(busy)

    def take(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        """A listing of the sender's documents (owner -1), and its messages."""
        if self.size < least:
            return
        sender = next(self.ids)
        ids, hashes = (np.concatenate(x).astype("<i8").tobytes() for x in zip(*self.docs, strict=True))
        columns = {"sender": pa.array([sender], pa.int64()), "owner": pa.array([-1], pa.int32()), "docs": pa.array([ids]), "hashes": pa.array([hashes])}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        keys, doc, pos = (np.concatenate(x) for x in zip(*self.held, strict=True))
        yield exchange.messages(sender, self.n_owners, keys, {"doc": doc, "pos": pos})
        self._clear()


_MESSAGE = f"{exchange.MESSAGE}, doc binary, pos binary, docs binary, hashes binary"
_KINDS = {"doc": "<u4", "pos": "<u4"}


def _as(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with the columns that it lacks as nulls."""
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays(
        [batch.column(f.name) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema
    )


def _schema(extra: list[tuple[str, pa.DataType]]) -> pa.Schema:
    base = [("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("m", pa.int32())]
    base += [(x, pa.binary()) for x in ("keys", "fresh", "doc", "pos", "docs", "hashes")]
    return pa.schema(base + extra)


_LOW = _schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())])
_NEXT = _schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("text", pa.string())])


def _lowest(window: int, length: int, n_owners: int):
    """Messages of the lowest rung, and the ledger: words and digest of each document as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batch(n_owners)
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            ids, keys = batch.column("doc_id"), batch.column("key").to_numpy(zero_copy_only=False)
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            for a, b in textcore.slices(texts):
                part = texts.slice(a, b - a)
                w = textcore.words(part)
                top, _, chosen = selected(w, window, length)
                at = np.flatnonzero(chosen)
                doc = w.doc_of_word()[at]
                out.add(top[at], doc, at - w.first[doc], keys[a:b], hashes[a:b])
                sha = [hashlib.sha256(b" ".join(x.encode().split())).hexdigest() for x in part.to_pylist()]
                ledger = pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(hashes[a:b]), pa.array(w.count, pa.int64()), pa.array(sha)],
                    names=["doc_id", "hash", "n_words", "sha"],
                )
                yield _as(ledger, _LOW)
                for rows in out.take(exchange.SENDER_KEYS):
                    yield _as(rows, _LOW)
        for rows in out.take():
            yield _as(rows, _LOW)

    return run


def _survivors(stored: pa.Table, answers: pa.Table) -> pa.Table:
    """Per document of a sender the sorted starts of its repeated windows."""
    found = exchange.repeated(stored, answers, _KINDS)
    listing = stored.filter(pc.less(stored["owner"], 0))
    ids, hashes = (np.frombuffer(listing[c].to_pylist()[0], "<i8") for c in ("docs", "hashes"))
    order = np.lexsort((found["pos"], found["doc"]))
    doc, pos = found["doc"][order], found["pos"][order]
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(doc))[: len(begin)]
    starts = [pos[a:b].astype("<u4").tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    own = doc[begin]
    return pa.table({"doc_id": pa.array(ids[own]), "hash": pa.array(hashes[own]), "starts": pa.array(starts, pa.binary())})


def _extend(window: int, low: int, length: int, n_owners: int, lowest: bool):
    """Messages of the next rung for the documents with survivors, and their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batch(n_owners)
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            starts = batch.column("starts").to_pylist()
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "hash"))
            for a, b in textcore.slices(texts):
                part = texts.slice(a, b - a)
                w = textcore.words(part)
                alive = np.zeros(len(w.hash), bool)
                for d, lists in enumerate(starts[a:b]):
                    for x in lists:
                        alive[w.first[d] + np.frombuffer(x, "<u4")] = True
                if lowest:
                    top, least, _ = selected(w, window, low)
                    live = np.where(alive, top, np.iinfo(np.uint64).max)
                    span = window - low + 1
                    near = np.zeros(len(w.hash), np.uint64)
                    if len(near) >= span:
                        near[: len(near) - span + 1] = sliding(live, span)
                    inside = (near == least) & (least > 0)  # starts of wanted windows that may be repeated
                else:
                    inside = alive & np.append(alive[length - low :], np.zeros(length - low, bool))[: len(alive)]
                if lowest and length < window:
                    spread = np.zeros(len(alive) + 1, np.int64)
                    at = np.flatnonzero(inside)
                    np.add.at(spread, at, 1)
                    np.add.at(spread, np.minimum(at + window - length + 1, len(alive)), -1)
                    inside = np.cumsum(spread[:-1]) > 0
                at = np.flatnonzero(inside & (w.left_in_doc() >= length))
                doc = w.doc_of_word()[at]
                other = textcore.words(part, which=1).hash if length == window else w.hash
                keys = textcore.window_hash(other, at, length, int(length == window))
                out.add(keys, doc, at - w.first[doc], ids[a:b], hashes[a:b])
                busy = np.bincount(doc, minlength=b - a) > 0
                kept = pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b]), pa.array(hashes[a:b]), part.cast(pa.string())], names=["doc_id", "hash", "text"]
                ).filter(pa.array(busy))
                yield _as(kept, _NEXT)
                for rows in out.take(exchange.SENDER_KEYS):
                    yield _as(rows, _NEXT)
        for rows in out.take():
            yield _as(rows, _NEXT)

    return run


def _cut(window: int, with_text: bool):
    """What is left of each document when the words below repeated windows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, spans = [], [], []
            for text, lists in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                found = text.encode().split()
                edge = np.zeros(len(found) + 1, np.int64)
                for x in lists:
                    at = np.frombuffer(x, "<u4")
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([x for x, g in zip(found, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                spans.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "hash", "n_removed", "sha_kept", "kept_text"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A word goes if some ``window``-word run over it also starts anywhere else in the table.
    Null texts have no words.  Rows that repeat an id are judged by their own texts; rows that
    repeat an id and text count as occurrences of their own.  Rows without a ``doc_id`` count as
    occurrences too but are returned whole.  An empty table gives an empty result.  With
    ``with_text``, ``kept_text`` has the kept words joined by one space for documents that lost
    some (null: nothing was removed).
    """
    spark = docs.sparkSession
    scratch, n_owners = Scratch(spark, "substring"), owners(spark, docs.select("text"))
    no_id = F.lit(-1).cast("long")  # rows without id are told apart by the hashes of their texts
    source = docs.select("doc_id", F.coalesce("doc_id", no_id).alias("key"), F.xxhash64("text").alias("hash"), "text")
    rungs = ladder(window)
    low = scratch.keep(
        source.mapInArrow(_lowest(window, rungs[0], n_owners), f"{_MESSAGE}, doc_id long, hash long, n_words long, sha string"), "rung0"
    )
    ledger = low.where("sender IS NULL").select("doc_id", "hash", "n_words", "sha")
    messages, texts = low.where("sender IS NOT NULL"), source.select(F.col("key").alias("doc_id"), "hash", "text")
    for i, length in enumerate(rungs):
        alive = exchange.settle(
            messages.select("sender", "owner", "n", "m", "keys", "fresh", "doc", "pos", "docs", "hashes"),
            _survivors,
            "doc_id long, hash long, starts binary",
        )
        alive = alive.groupBy("doc_id", "hash").agg(F.collect_list("starts").alias("starts"))
        alive = scratch.keep(alive, f"alive{i}")
        if length == window:
            break
        step = _extend(window, length, rungs[i + 1], n_owners, i == 0)
        found = rows_with(texts, alive, "doc_id", "hash").mapInArrow(step, f"{_MESSAGE}, doc_id long, hash long, text string")
        found = scratch.keep(found, f"rung{i + 1}")
        scratch.drop(*([f"rung{i}"] if i else []), f"alive{i}")
        messages, texts = found.where("sender IS NOT NULL"), found.where("sender IS NULL").select("doc_id", "hash", "text")
    changed = texts.join(alive, ["doc_id", "hash"]).mapInArrow(
        _cut(window, with_text), "doc_id long, hash long, n_removed long, sha_kept string, kept_text string"
    )
    changed = changed.dropDuplicates(["doc_id", "hash"])  # rows that repeat an id and text
    if not with_text:
        changed = changed.drop("kept_text")
    return ledger.join(changed, ["doc_id", "hash"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha_kept", "sha").alias("kept_sha256"),
        *(["kept_text"] if with_text else []),
    )
