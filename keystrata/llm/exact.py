"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Every document gets a 64-bit fingerprint of its normalised text.  Each sender stores its
   fingerprints sorted, dealt by range and Rice-coded, beside the ledger of its documents.
2. Owners answer with duplicate bitmaps (:mod:`.exchange`).
3. Only the suspects - documents whose fingerprint is not the only one - have their texts
   shuffled.  Grouping by (fingerprint, normalised text) compares whole texts byte by byte, and
   its map-side step leaves one row per task for a text that a third of all rows share.

Empty and null texts are equal to each other and to texts of white space alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange, textcore
from .scratch import Scratch, owners, rows_with

#: Code points that do not count when texts are compared.
IGNORED = b" \t\n\x0b\x0c\r"


def _normal(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), IGNORED.decode(), "")


_LEDGER = (
    "sender long, owner int, n int, keys binary, repeats binary, owned binary,"
    " doc_id array<bigint>, chars array<bigint>, sha array<string>"
)


def _ledger(n_owners: int):
    """Rows of one sender and owner: coded fingerprints and the documents behind them.

    Documents stand in the order of their fingerprints; ``owned`` has for each the rank of its
    fingerprint (uint32), ``repeats`` one byte per fingerprint: 1 if the sender has it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = exchange.sender_ids()
        held: list[tuple] = []
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts.to_pylist(), strict=True):
                normal = text.encode().translate(None, IGNORED)
                held.append((xxhash.xxh3_64_intdigest(normal), doc, len(text), hashlib.sha256(normal).hexdigest()))
            if len(held) >= exchange.SENDER_KEYS // 4:
                yield _messages(held, next(ids), n_owners)
                held = []
        if held:
            yield _messages(held, next(ids), n_owners)

    return run


def _messages(held: list[tuple], sender: int, n_owners: int) -> pa.RecordBatch:
    held.sort(key=lambda x: x[0])
    keys = np.array([x[0] for x in held], np.uint64)
    cuts = exchange.deal(keys, n_owners)
    rows = []
    for owner in np.flatnonzero(np.diff(cuts)):
        own = held[cuts[owner] : cuts[owner + 1]]
        distinct, rank, count = np.unique(keys[cuts[owner] : cuts[owner + 1]], return_inverse=True, return_counts=True)
        rows.append(
            (
                sender,
                int(owner),
                len(distinct),
                exchange.rice_encode(distinct),
                (count > 1).astype(np.uint8).tobytes(),
                rank.astype("<u4").tobytes(),
                *([x[i] for x in own] for i in (1, 2, 3)),
            )
        )
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES
    )


_NAMES = ["sender", "owner", "n", "keys", "repeats", "owned", "doc_id", "chars", "sha"]
_KINDS = [
    pa.int64(),
    pa.int32(),
    pa.int32(),
    pa.binary(),
    pa.binary(),
    pa.binary(),
    pa.list_(pa.int64()),
    pa.list_(pa.int64()),
    pa.list_(pa.string()),
]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document; ``suspect`` where its fingerprint occurs again."""
    for batch in batches:
        for row in batch.to_pylist():
            again = exchange.bits(row["dup"], row["n"]) | np.frombuffer(row["repeats"], np.uint8).astype(bool)
            suspect = again[np.frombuffer(row["owned"], "<u4")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_id"], pa.int64()),
                    pa.array(row["chars"], pa.int64()),
                    pa.array(row["sha"], pa.string()),
                    pa.array(suspect),
                ],
                names=["doc_id", "chars", "text_sha256", "suspect"],
            )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Of equal texts the one
    with most code points in the original stays, then the smallest ``doc_id``; of rows that repeat
    an id and text one is kept.  An empty table gives an empty result.  A null ``doc_id`` is kept
    as a group of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    source = docs.select("doc_id", "text")
    ledger = scratch.keep(source.mapInArrow(_ledger(owners(spark, source)), _LEDGER), "ledger")
    judged = scratch.keep(
        exchange.with_answers(ledger).mapInArrow(
            _judge, "doc_id long, chars long, text_sha256 string, suspect boolean"
        ),
        "judged",
    )
    scratch.drop("ledger")
    suspects = scratch.keep(judged.where("suspect AND doc_id IS NOT NULL").select("doc_id").distinct(), "suspects")
    texts = rows_with(source, suspects).select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), _normal("text").alias("normal")
    )
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("last"))).alias("best")
    groups = texts.groupBy(F.xxhash64("normal").alias("fp"), "normal").agg(best, F.count(F.lit(1)).alias("group_size"))
    groups = scratch.keep(
        groups.select(F.sha2(F.encode("normal", "UTF-8"), 256).alias("text_sha256"), F.bitwise_not("best.last").alias("keep_id"), "group_size"), "groups"
    )
    alone = judged.where("NOT suspect OR doc_id IS NULL").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    grouped = judged.where("suspect AND doc_id IS NOT NULL").join(groups, "text_sha256")
    repeated = judged.where("suspect AND doc_id IS NOT NULL").count() > suspects.count()
    if not repeated:
        grouped = grouped.withColumn("kept", F.col("doc_id") == F.col("keep_id"))
    else:  # rows that repeat an id: one of those that are equal in id and text stays
        first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.col("chars").desc())) == 1
        kept = grouped.where("doc_id = keep_id").withColumn("kept", first)
        grouped = kept.unionByName(grouped.where("doc_id <> keep_id").withColumn("kept", F.lit(False)))
    return alone.unionByName(grouped.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
