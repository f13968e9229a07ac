"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def prose(rng, n, vocabulary="alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho".split()):
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(n))


def texts(seed=0):
    """Texts with copies, near copies, shared passages, odd spaces, and empty and very long ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(12)]
    shared = prose(rng, 45)
    long = prose(rng, 9000)
    out = [None, "", " \n\t ", "one", "one", "One", "a b c d e f", "日本語　テキスト の 例  ", "x" * 5000, long, long + " tail", *base]
    for b in base[:6]:
        out += [b, f" {b}\n", b.replace(" ", "\n", 1)]
        ws = b.split()
        ws[len(ws) // 2] = "changed"
        out.append(" ".join(ws))
    out += [f"{prose(rng, 30)} {shared} {prose(rng, 20)}" for _ in range(3)] + [f"{prose(rng, 40)}\n" * 3, "\n".join([prose(rng, 12)] * 2)]
    return out


def table(spark, rows, extra=True):
    """``documents`` with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    if extra:
        for name in ("sender", "owner", "class", "kept", "n_words", "size", "findings", "redacted", "token", "_words"):
            df = df.withColumn(name, F.lit("own"))
    return df


def shingles(ws, k=5):
    if len(ws) >= k:
        return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
    return {tuple(ws)} if ws else set()


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def components(rows):
    """Smallest reachable id by comparing all sets."""
    sets = {i: shingles(words(lower(t))) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def exact_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(words(t)), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def repeated_windows(rows, k=35):
    """Which words of each document stand below a window that starts twice."""
    starts = {}
    for i, t in rows:
        ws = words(t)
        for at in range(len(ws) - k + 1):
            starts.setdefault(tuple(ws[at : at + k]), []).append((i, at))
    gone = {i: [False] * len(words(t)) for i, t in rows}
    for places in starts.values():
        if len(places) > 1:
            for i, at in places:
                gone[i][at : at + k] = [True] * k
    return gone
