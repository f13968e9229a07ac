"""Exact, line, n-gram and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import components, exact_groups, lower, prose, repeated_windows, shingles, similar, table, texts, words

from keystrata.llm import exact, jaccard, linededup, setjoin, substring, textcore

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def near_texts(seed):
    """Groups of near copies (chains among them), small sets and a passage in many texts."""
    rng = random.Random(seed)
    passage = prose(rng, 14)
    out = []
    for size in (2, 3, 5, 9, 14, 30, 80):
        text = prose(rng, size).split()
        for _ in range(5):
            out.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = f"edit{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                text.append("more")
    return out + [f"{passage} {prose(rng, 40)}" for _ in range(12)] + [passage.upper()]


def test_exact(spark):
    rows = list(enumerate(texts()))
    got = exact.exact_dedup(table(spark, rows)).collect()
    want = exact_groups(rows)
    assert len(got) == len(rows)
    for r in got:
        keep, n = want[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (keep, n, keep == r.doc_id)
        assert r.text_sha256 == SHA("".join(words(rows[r.doc_id][1])))


def test_exact_edges(spark):
    assert exact.exact_dedup(table(spark, [])).count() == 0
    rows = exact.exact_dedup(table(spark, [(None, "a"), (1, "a"), (1, "a"), (2, None), (3, " ")])).collect()
    assert sorted((r.doc_id or -1, r.kept, r.group_size) for r in rows) == [(-1, True, 1), (1, False, 2), (1, True, 2), (2, False, 2), (3, True, 2)]


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join(spark, seed):
    rows = list(enumerate(texts(seed) + near_texts(seed)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(table(spark, rows)).collect()}
    assert got == components(rows)


def test_ngram_join_edges(spark):
    assert jaccard.jaccard_join(table(spark, [])).count() == 0
    rows = jaccard.jaccard_join(table(spark, [(None, "a b c"), (1, None), (2, "a b c"), (2, "a b c"), (3, "A B\tC")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 1, -1), (1, 0, 1), (2, 1, 2), (2, 1, 2), (3, 1, 2)]


@pytest.mark.parametrize("cell_rows", [setjoin.CELL_ROWS, 5])
def test_subsets_and_lists_find_the_same(spark, cell_rows):
    """Whatever the boundary, and in one cell or many, linked sets get into one part."""
    rows = list(enumerate(near_texts(4)))
    engine = setjoin.Engine(table(spark, rows), "test", cell_rows=cell_rows)
    lists = engine.lists()
    sets = sorted({frozenset(shingles(words(lower(t)))) for _, t in rows}, key=sorted)
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if similar(a, sets[j]):
                p, q = root[i], root[j]
                root = [min(p, q) if r in (p, q) else r for r in root]
    linked = sum(root.count(r) for r in set(root) if root.count(r) > 1)
    for boundary in (1, 12, setjoin.SMALL_MOST):
        links = engine.links(setjoin.join_keys(lists, boundary), "forest")
        roots = setjoin.components(links, engine.scratch, "test").collect()
        assert len(roots) == linked and len({r.root for r in roots}) == sum(root.count(r) > 1 for r in set(root))
        engine.scratch.drop("families", "wide", "links_near", "links_far", "widelabels0", "widelabels1", "unsettled", "testlabels1", "testlabels2", "testlabels3")
        engine.scratch = setjoin.Scratch(spark, "again")
    assert 1 <= setjoin.subset_boundary(lists) <= setjoin.SMALL_MOST


def test_overlaps_and_bitmaps():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(common, rng.integers(0, 60)), rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64)))) for _ in range(40)]
    got = setjoin.overlaps(sets)
    want = np.array([[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (got == want).all()
    first = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    maps, width = setjoin.bitmaps(setjoin.Sets(np.concatenate(sets), np.repeat(np.arange(40), np.diff(first)), first))
    at = np.concatenate(([0], np.cumsum(width)))
    column = pa.array([maps[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
    size = np.diff(first)
    for i in range(40):
        for j in range(i):
            if want[i, j] >= setjoin._least(size[i : i + 1], size[j : j + 1])[0]:
                keep = np.zeros(40, bool)
                setjoin._mark(keep, np.array([i]), np.array([j]), size, column)
                assert keep[i] and keep[j]


def test_rows_that_share_an_id(spark):
    """Each text is judged by itself, whatever other text has its id."""
    rng = random.Random(15)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = " ".join(["edited", *a.split()[1:]])
    rows = [(1, a), (1, b), (2, near), (3, c), (3, c), (5, b + " x")]
    links = jaccard.jaccard_join(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in links) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (5, 1)]
    cut = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(table(spark, rows)).collect())
    assert cut == [(1, 60, 59), (1, 60, 60), (2, 60, 59), (3, 60, 60), (3, 60, 60), (5, 61, 60)]
    kept = exact.exact_dedup(table(spark, [(1, "a b"), (1, "a b"), (1, "c"), (2, "ab")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept, r.group_size) for r in kept) == [(1, 1, False, 3), (1, 1, True, 1), (1, 1, True, 3), (2, 1, False, 3)]
    lines = linededup.line_dedup(table(spark, [(1, "x y z"), (1, "p q\nr s"), (2, "r s")])).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in lines) == [(1, 1, 0), (1, 2, 0), (2, 1, 1)]


def test_frequent_tokens_come_last():
    s = setjoin.shingle_sets(pa.array(["a b c d e f g h", "a b c d e", "x"]))
    often = np.sort(s.token[:1])
    rank = setjoin.ranks(s, (often, np.array([9])))
    for u in range(3):
        own = rank[s.first[u] : s.first[u + 1]]
        assert sorted(own.tolist()) == list(range(len(own)))
    assert rank[s.token == often[0]].tolist()[0] == 3


def brute_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows):
        parts, kept = (t or "").split("\n"), []
        for p in parts:
            s = shingles(words(lower(p)))
            if not any(similar(s, x) for x in seen):
                kept.append(p)
            if s:
                seen.append(s)
        out[i] = (len(parts), len(parts) - len(kept), SHA("\n".join(kept)))
    return out


@pytest.mark.parametrize("cell_rows", [setjoin.CELL_ROWS, 4])
def test_lines(spark, cell_rows):
    rng = random.Random(8)
    rows = [t for t in texts() if len(t or "") < 20_000] + ["\n".join(rng.sample(near_texts(2), 12)) for _ in range(6)]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in linededup.line_dedup(table(spark, rows), cell_rows=cell_rows).collect()}
    assert got == brute_lines(rows)


def test_line_edges(spark):
    assert linededup.line_dedup(table(spark, [])).count() == 0
    rows = linededup.line_dedup(table(spark, [(None, "a b"), (1, None), (2, "a b\n\na b\nc")]), with_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.kept_text) for r in rows) == [(-1, 0, "a b"), (1, 0, ""), (2, 1, "a b\n\nc")]


def test_substrings(spark):
    rng = random.Random(6)
    rows = texts() + [f"{prose(rng, 20)} {' '.join(['tick tock'] * 40)} {prose(rng, 20)}"]
    rows = list(enumerate(rows))
    gone = repeated_windows(rows)
    for r in substring.substring_dedup(table(spark, rows)).collect():
        ws, g = words(rows[r.doc_id][1]), gone[r.doc_id]
        kept = " ".join(w for w, x in zip(ws, g) if not x)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(ws), sum(g), SHA(kept)), r.doc_id


def test_substring_ladder_of_three(spark):
    rng = random.Random(9)
    passage = prose(rng, 90)
    rows = list(enumerate([f"{prose(rng, 10)} {passage} {prose(rng, 10)}", passage, " ".join(passage.split()[:60]), prose(rng, 200)]))
    assert substring.ladder(70) == [18, 35, 70] and substring.ladder(35) == [18, 35] and substring.ladder(10) == [10]
    for window in (70, 10):
        gone = repeated_windows(rows, window)
        got = {r.doc_id: r.n_removed for r in substring.substring_dedup(table(spark, rows), window).collect()}
        assert got == {i: sum(g) for i, g in gone.items()}


def test_substring_edges(spark):
    assert substring.substring_dedup(table(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = substring.substring_dedup(table(spark, [(None, text), (1, text), (1, text), (2, None)]), with_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows) == [(-1, 40, 0), (1, 40, 40), (1, 40, 40), (2, 0, 0)]


def test_passages_of_rows_without_id_count(spark):
    rng = random.Random(5)
    shared, other, copied = (prose(rng, n) for n in (45, 60, 50))
    rows = [(None, f"{prose(rng, 80)} {shared} {prose(rng, 20)}"), (None, other), (None, copied), (None, copied), (1, f"{prose(rng, 30)} {shared}"), (2, f"{other} {prose(rng, 9)}"), (3, prose(rng, 70))]
    got = substring.substring_dedup(table(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 50, 0), (0, 50, 0), (0, 60, 0), (0, 145, 0), (1, 75, 45), (2, 69, 60), (3, 70, 0)]


def test_selected_windows_are_in_every_wanted_one():
    rng = random.Random(2)
    w = textcore.words(pa.array([" ".join(rng.choices("abcd", k=90)), prose(rng, 200), "a b"]))
    _, least, chosen = substring.selected(w, 35, 18)
    for at in np.flatnonzero(least):
        assert chosen[at : at + 18].any()
