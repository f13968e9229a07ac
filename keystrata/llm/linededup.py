"""Near-duplicate lines: exact set-similarity join, later matches are removed.

The sets are the lower-cased five-word shingles of each line (a shorter line is one shingle).
Tokens are ordered by rarity, the prefix of each line goes through the hash exchange, length,
positional and bitmap filters thin the pairs, and Jaccard is computed on whole sets
(:mod:`.setjoin`).

A line is removed if a line before it - in a document with a smaller ``doc_id``, or higher up in
the same one - has a similarity of 0.8 or more.  All but the first line of a class have one in
their class; for the first lines it takes pairs of classes, of which each class needs one only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .scratch import rows_with


def _engine(docs: DataFrame, cell_rows: int = setjoin.CELL_ROWS) -> setjoin.Engine:
    return setjoin.Engine(docs, "linededup", setjoin.lines, cell_rows)


def later_matches(engine: setjoin.Engine) -> DataFrame:
    """``doc_id, unit`` (line number from 0) of every line that an earlier one matches."""
    keys = setjoin.prefix_keys(engine.lists())
    settled = engine.links(keys, "earlier", "alive").select(F.col("a.c1").alias("c1"), F.col("a.c2").alias("c2")).distinct()
    order = engine.info.select("c1", "c2", F.struct("doc_id", "unit").alias("first"))
    first_lines = order.join(settled, ["c1", "c2"], "left_semi").select("first.doc_id", "first.unit")
    again = engine.ledger.join(order, ["c1", "c2"]).where("struct(doc_id, unit) <> first").select("doc_id", "unit")
    return again.unionByName(first_lines)


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the lines ``gone``, and the digest of the text as it was."""
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            text = text or ""
            parts = text.split("\n")
            drop = {i for i in gone or () if i < len(parts)}
            kept = "\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else text
            values = (hashlib.sha256(text.encode()).digest(), len(parts), len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept)
            for c, v in zip(columns, values, strict=True):
                c.append(v)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "sha", "n_lines", "n_removed", "kept_sha256", "kept_text"],
        )


_REWRITTEN = "doc_id long, sha binary, n_lines long, n_removed long, kept_sha256 string, kept_text string"


def line_dedup(docs: DataFrame, with_text: bool = False, cell_rows: int = setjoin.CELL_ROWS) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` for every row of ``docs``.

    Lines are split at ``\\n``; lines without words match nothing and stay.  A null text counts
    as one empty line.  Rows without a ``doc_id`` are returned whole and match nothing.  Of rows that
    repeat an id a line number goes in all of them: repeat texts, not ids.  An empty table gives an
    empty result.  ``with_text`` adds ``kept_text``; it moves every text, else only texts that lose a
    line are moved.
    """
    engine = _engine(docs, cell_rows)
    gone = engine.scratch.keep(later_matches(engine).groupBy("doc_id").agg(F.collect_set("unit").alias("gone")), "gone")
    if with_text:
        return docs.select("doc_id", "text").join(gone, "doc_id", "left").mapInArrow(_rewrite, _REWRITTEN).drop("sha")
    changed = rows_with(docs.select("doc_id", "text"), gone).mapInArrow(_rewrite, _REWRITTEN)
    changed = changed.drop("kept_text", "n_lines").dropDuplicates(["doc_id", "sha"])  # rows that repeat an id and text
    return engine.documents.join(changed, ["doc_id", "sha"], "left").select(
        "doc_id",
        F.col("n_units").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
