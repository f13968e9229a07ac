"""Quality rules with suffix-array repetition.

A suffix array over the words of each document (prefix doubling, all documents of a slice at
once) with its longest-common-prefix values gives, for every word, the longest repeated run of
words that begins there.  Starts that cannot be extended to the left are the maximal repeated
substrings; their spans are united, and the covered fraction and the longest repeat are limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore
from .scratch import reach


@dataclass(frozen=True)
class Limits:
    """Base rules: fewest words, and most percent of words in repeated ``window``-word runs.

    Verdict: among maximal repeats of at least ``least`` words, most percent of words covered,
    and most words of the longest one.
    """

    words: int = 20
    window: int = 8
    repeat_percent: int = 30
    least: int = 5
    covered_percent: int = 35
    longest: int = 60


def longest_repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word, how many words from it on occur again elsewhere in its document."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int32)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    left = np.repeat(first[1:], count) - np.arange(n)
    order = np.lexsort((hashes, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    starts = np.flatnonzero(fresh)
    sizes = np.diff(starts, append=n)
    rank[order] = np.repeat(starts, sizes)
    active = order[np.repeat(sizes > 1, sizes)]
    levels, h = [rank], 1
    while len(active):
        follow = np.where(left[active] > h, rank[np.minimum(active + h, n)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 2) + follow
        o = np.argsort(key, kind="stable")
        key, active = key[o], active[o]
        old = rank[active]
        head = np.ones(len(active), bool)
        head[1:] = old[1:] != old[:-1]
        sub = head.copy()
        sub[1:] |= key[1:] != key[:-1]
        place = np.arange(len(active))
        group = place[head][np.cumsum(head) - 1]
        begin = np.flatnonzero(sub)
        sizes = np.diff(begin, append=len(active))
        rank = rank.copy()
        rank[active] = old + np.repeat(begin, sizes) - group
        active = active[np.repeat(sizes > 1, sizes)]
        h *= 2
        levels.append(rank)
    suffix = np.empty(n, np.int64)
    suffix[rank[:n]] = np.arange(n)
    base = levels[0]
    pair = np.flatnonzero(base[suffix[1:]] == base[suffix[:-1]])
    i, j = suffix[pair].copy(), suffix[pair + 1].copy()
    common = np.zeros(len(pair), np.int32)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][i] == levels[level][j]
        step = np.where(same, 1 << level, 0)
        common += step.astype(np.int32)
        i += step
        j += step
    longest = np.zeros(n, np.int32)
    np.maximum.at(longest, suffix[pair], common)
    np.maximum.at(longest, suffix[pair + 1], common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """The union of the spans of all maximal repeats of at least ``least`` words, as a mask."""
    n = len(longest)
    begins = longest >= least
    begins[1:] &= longest[1:] >= longest[:-1]  # else the span of the word before reaches as far
    at = np.flatnonzero(begins)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:n]) > 0


_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_covered long, longest_repeat long"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(texts: pa.Array, limits: Limits) -> list[pa.Array]:
    """The columns of ``_FIELDS`` for a slice of texts."""
    w = textcore.words(texts)
    n_docs = len(texts)

    def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])

    ink = ~textcore._WHITE[w.data] & (w.data & 0xC0 != 0x80)
    repeats = longest_repeats(w.hash, w.first)
    n_words = w.count
    n_repeat = per_doc(covered(repeats, limits.window), w.first)
    n_covered = per_doc(covered(repeats, limits.least), w.first)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, w.doc_of_word(), repeats)
    failed = (n_words < limits.words) | (100 * n_repeat > limits.repeat_percent * n_words)
    fine = (100 * n_covered <= limits.covered_percent * n_words) & (longest <= limits.longest)
    columns = [
        n_words,
        per_doc(ink, w.text_at),
        per_doc(_SYMBOL[w.data], w.text_at),
        _repeated_lines(w, n_docs),
        n_repeat,
        failed,
        ~failed & fine,
        n_covered,
        longest,
    ]
    return [pa.array(c) for c in columns]


def _repeated_lines(w: textcore.Words, n_docs: int) -> np.ndarray:
    """Per document the lines with a word that equal an earlier line of it."""
    breaks = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate((w.text_at[:-1], breaks + 1)))
    begin = begin[begin < len(w.data)]
    if len(begin) == 0:
        return np.zeros(n_docs, np.int64)
    end = np.append(begin[1:], len(w.data))
    end -= (w.data[end - 1] == 10).astype(np.int64)
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[worded], end[worded]
    doc = np.searchsorted(w.text_at, begin, side="right") - 1
    power, inverse = textcore._powers(len(w.data) + 1, 1)
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(textcore._TABLE[1][w.data] * power[: len(w.data)], out=total[1:])
    h = textcore.mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    order = np.lexsort((h, doc))
    again = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=n_docs)


def quality_rules(docs: DataFrame, limits: Limits | None = None, keep_columns: bool = False) -> DataFrame:
    """Measures and verdict for every document; one row per row of ``docs``, no shuffle.

    Null texts count as empty: no words, so ``base_failed``.  With ``keep_columns`` the result
    has the columns of ``docs`` that are not among the measures, too.
    """
    limits = limits or Limits()
    names = [f.split()[0] for f in _FIELDS.split(",")]
    carried = [c for c in docs.columns if c not in names] if keep_columns else ["doc_id"]
    places = [docs.columns.index(c) for c in carried]
    source = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # plain names: mapInArrow does not quote them
    text = f"_{docs.columns.index('text')}"
    source = source.select(*dict.fromkeys([*(f"_{i}" for i in places), text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textcore.as_strings(batch.column(text))
            for a, b in textcore.slices(texts):
                own = [batch.column(f"_{i}").slice(a, b - a) for i in places]
                yield pa.RecordBatch.from_arrays(own + measure(texts.slice(a, b - a), limits), names=[f"_{i}" for i in places] + names)

    reach(docs.sparkSession)
    schema = ", ".join(f"_{i} {source.schema[f'_{i}'].dataType.simpleString()}" for i in places)
    return source.mapInArrow(run, f"{schema}, {_FIELDS}").toDF(*carried, *names)


def keep_good(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are.

    Null and empty texts have no words and go; repeated rows share a verdict; an empty table stays empty.
    """
    limits = limits or Limits()
    kept_at = [f.split()[0] for f in _FIELDS.split(",")].index("kept")

    text = docs.columns.index("text")
    rows = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))  # plain names: mapInArrow does not quote them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textcore.as_strings(batch.column(text))
            for a, b in textcore.slices(texts):
                yield batch.slice(a, b - a).filter(measure(texts.slice(a, b - a), limits)[kept_at])

    reach(docs.sparkSession)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
