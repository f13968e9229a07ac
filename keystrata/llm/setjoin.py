"""Exact Jaccard join of shingle sets, shared by document and line dedup.

Sets are keyed by content (*class*: a 128-bit digest of the set, two longs), so copies never meet
in pairs.

1. A bounded table of the most frequent shingles is counted over all texts; they come last in
   the global token order, all others are ordered by hash.
2. Each class sends the prefix of its set to the hash exchange; only tokens that occur again
   survive, as rows ``(token, class, size, rank)``.
3. Rows become join keys (:func:`join_keys`).  The classes of a key form a group with one of them,
   the key's head; keys with the same head share one *family*, so that a pair of near copies meets
   once however many keys it shares.
4. Families are dealt into cells of bounded size.  A first pass over bitmaps leaves the classes
   that have a likely partner in their cell (length, positional and bitmap filters); a second one
   gets whole sets, compares them and returns what the caller needs: a spanning forest of the
   links in the cell, or one earlier match per class.

No step returns the pairs of a group: cells return at most one row per class.  Families above
one cell are first compared within their cells and with the head; then only the classes that this
left unsettled meet the other cells (:meth:`Engine.links`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, textcore
from .scratch import Scratch, owners, rows_with

SHINGLE = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Most rows of the table of frequent shingles (16 bytes each), and per sender (before summing).
HEAVY, HEAVY_SENDER, HEAVY_LEAST = 1 << 17, 1 << 16, 16
#: Sets up to this size may be joined by subsets.
SMALL_MOST = 64
BITMAP_MOST = 1 << 16
#: Classes and tokens of a cell (on average); a family above either is dealt into several.
CELL_ROWS, CELL_TOKENS = 512, 4_000_000
#: Low bits of a packed head that hold its rank.
_RANK_BITS = 24


@dataclass
class Sets:
    """Distinct shingles of the units of a slice: sorted by unit and hash, with ``first`` per unit."""

    token: np.ndarray
    unit: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)


@dataclass
class Units:
    """Texts that are joined: document index in the slice, number in the document, bytes."""

    doc: np.ndarray
    number: np.ndarray
    texts: pa.Array


def whole_documents(texts: pa.Array) -> Units:
    n = len(texts)
    return Units(np.arange(n), np.zeros(n, np.int64), texts)


def lines(texts: pa.Array) -> Units:
    """Every ``\\n``-split line of every text (the line break stays with the line)."""
    data, at = textcore.raw(texts)
    breaks = np.flatnonzero(data == 10) + 1
    doc_of_break = np.searchsorted(at, breaks - 1, side="right") - 1
    begin = np.concatenate((at[:-1], breaks))
    doc = np.concatenate((np.arange(len(texts)), doc_of_break))
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    offsets = np.append(begin, len(data)).astype(np.int32)
    return Units(doc, number, pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]))


def shingle_sets(texts: pa.Array, lower: bool = True) -> Sets:
    """Distinct ``SHINGLE``-word shingles; a text with fewer words is one shingle, without words none."""
    w = textcore.words(texts, lower=lower)
    at, token = textcore.windows(w, SHINGLE)
    unit = w.doc_of_word()[at]
    short_units, short_tokens = [unit], [token]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(w.count == k)
        short_units.append(few)
        short_tokens.append(textcore.window_hash(w.hash, w.first[few], k))
    unit, token = _by_unit(np.concatenate(short_units), np.concatenate(short_tokens))
    fresh = np.ones(len(unit), bool)
    fresh[1:] = (unit[1:] != unit[:-1]) | (token[1:] != token[:-1])
    unit, token = unit[fresh], token[fresh]
    return Sets(token, unit, np.searchsorted(unit, np.arange(len(texts) + 1)))


def _by_unit(unit: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by unit and token; by one 64-bit key unless its 40 bits of the token leave a tie."""
    if len(unit) and int(unit.max()) < 1 << 24:
        order = np.argsort((unit.astype(np.uint64) << np.uint64(40)) | (token >> np.uint64(24)))
        u, t = unit[order], token[order]
        if not ((u[1:] == u[:-1]) & (t[1:] < t[:-1])).any():
            return u, t
    order = np.lexsort((token, unit))
    return unit[order], token[order]


def classes(s: Sets) -> np.ndarray:
    """A 16-byte digest of every set (two sums of independently mixed tokens, and the size)."""
    out = np.empty((len(s.first) - 1, 2), "<u8")
    for i, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        total = np.zeros(len(s.token) + 1, np.uint64)
        np.cumsum(textcore.mix(s.token ^ np.uint64(salt)), out=total[1:])
        out[:, i] = textcore.mix(total[s.first[1:]] - total[s.first[:-1]] + s.size.astype(np.uint64))
    return out


def ranks(s: Sets, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Place of every token in its set under the global order: frequent ones last, else by hash."""
    tokens, weight = heavy
    place = np.searchsorted(tokens, s.token)
    place[place == len(tokens)] = 0
    often = (tokens[place] == s.token) if len(tokens) else np.zeros(len(s.token), bool)
    light_before = np.concatenate(([0], np.cumsum(~often)))
    rank = light_before[:-1] - light_before[s.first[s.unit]]
    at = np.flatnonzero(often)
    order = np.lexsort((s.token[at], weight[place[at]], s.unit[at]))
    at = at[order]
    unit = s.unit[at]
    lights = light_before[s.first[1:]] - light_before[s.first[:-1]]
    rank[at] = lights[unit] + np.arange(len(at)) - np.searchsorted(unit, unit)
    return rank


def needed(size):
    """Least overlap of a set of this size with any partner (works on arrays and columns alike)."""
    return (NUMERATOR * size + DENOMINATOR - 1) // DENOMINATOR


def bitmaps(s: Sets, most: int = BITMAP_MOST) -> tuple[bytes, np.ndarray]:
    """Parity bitmaps of all sets, one after the other, and the bytes of each.

    A set has one to two bits a token, or ``most``; smaller bitmaps are folds of larger ones.  Sets
    that share little differ in about half of so many bits, and similar ones in at most 2 / 9 of
    their tokens, so more bits would only cost more to move.
    """
    size = np.maximum(s.size, 1)
    bits = np.minimum(most, np.maximum(64, 1 << (np.ceil(np.log2(size)).astype(np.int64))))
    begin = np.concatenate(([0], np.cumsum(bits)))
    at = begin[s.unit] + (s.token & (bits[s.unit] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(begin[-1])).astype(np.uint8) & 1
    return np.packbits(odd).tobytes(), bits // 8


class Engine:
    """The steps above for one table of documents and one way to cut them into units.

    ``alive`` has the tokens that occur again (``token, c1, c2, size, rank``), ``info`` the first
    unit, size and bitmap of every class with such a token, and ``ledger`` units: all documents, or of
    ``lines`` those whose class occurs again or has such a token.  Documents without an id are in
    the ledger only.  For ``lines``, ``documents`` has the number of units and the SHA-256 of every text.
    """

    def __init__(self, docs: DataFrame, name: str, units: Callable[[pa.Array], Units] = whole_documents, cell_rows: int = CELL_ROWS):
        self.spark = docs.sparkSession
        self.docs = docs.select("doc_id", "text")
        self.units = units
        self.cell_rows = cell_rows
        self.scratch = Scratch(self.spark, name)
        self._build()

    # -- building the token lists ------------------------------------------------------------

    def _build(self) -> None:
        heavy = self._frequent()
        whole = self.units is whole_documents
        stored = self.scratch.keep(
            self.docs.mapInArrow(
                _postings(self.units, heavy, owners(self.spark, self.docs), whole),
                f"{exchange.MESSAGE}, item binary, place binary, {', '.join(f'{x} binary' for x in _LISTING)},"
                " doc_id long, unit long, size long, c1 long, c2 long, sha binary",
            ),
            "postings",
        )
        sent = stored.where("sender IS NOT NULL").drop("doc_id", "unit", "size", "c1", "c2", "sha")
        found = self.scratch.keep(exchange.settle(sent, _alive(whole), _FOUND_DDL), "alive")
        self.alive = found.where("token IS NOT NULL").select("token", "c1", "c2", "size", "rank")
        first = F.min(F.struct("doc_id", "unit", "bitmap")).alias("f")
        info = found.where("bitmap IS NOT NULL").groupBy("c1", "c2").agg(first)
        self.info = self.scratch.keep(info.select("c1", "c2", "f.doc_id", "f.unit", "f.bitmap"), "info")
        rows = stored.where("sender IS NULL") if whole else found.where("token IS NULL AND bitmap IS NULL")
        self.ledger = self.scratch.keep(rows.select("doc_id", "unit", "size", "c1", "c2"), "ledger")
        if not whole:
            documents = stored.where("sender IS NULL").select("doc_id", F.col("unit").alias("n_units"), "sha")
            self.documents = self.scratch.keep(documents, "documents")
        self.scratch.drop("postings")

    def _frequent(self):
        """Tokens by how often they occur, as sorted arrays; at most ``HEAVY`` of them."""
        counted = self.docs.mapInArrow(_frequent(self.units), "token long, n long")
        counted = self.scratch.keep(
            counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_LEAST), "frequent"
        )
        steps = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().collect()
        least, total = 62, 0
        for row in sorted(steps, key=lambda r: -r["step"]):
            total += row["count"]
            if total > HEAVY:
                break
            least = row["step"]
        rows = counted.where(F.col("n") >= F.lit(1 << least)).collect()
        tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
        weight = np.array([r["n"] for r in rows], np.int64)
        order = np.argsort(tokens)
        self.scratch.drop("frequent")
        return self.spark.sparkContext.broadcast((tokens[order], weight[order]))

    def lists(self) -> DataFrame:
        """``alive`` of the tokens that two classes or more have, with the number ``n`` of rows and the key's ``head``."""
        return with_heads(self.alive.withColumnRenamed("token", "key"))

    # -- links -----------------------------------------------------------------------------------

    def links(self, keyed: DataFrame, rule: str, *release: str) -> DataFrame:
        """Links ``a, b`` (structs ``c1, c2``) of classes that share a key and are similar.

        ``keyed`` is what :func:`with_heads` returns.  Rule ``forest``: of every connected part of
        a family a spanning forest.  Rule ``earlier``: for every class ``a`` that has a similar
        class with an earlier first unit in its family, one such class ``b``.  ``release`` names
        tables that nobody needs once the families are written.
        """
        family = self.scratch.keep(families(keyed), "families")
        self.scratch.drop(*release)
        pivot = F.shiftright("c1", _RANK_BITS) == F.col("head")  # the head stands in every cell of its family
        blocks = F.ceil(F.greatest(F.col("n") / self.cell_rows, F.col("w") / CELL_TOKENS)).cast("int")
        shapes = shape(family, pivot).select("head", blocks.alias("blocks"), "idle").where("blocks > 1 OR idle")
        shapes = self.scratch.keep(shapes, "shapes")
        wide = shapes.where("NOT idle").drop("idle")
        narrow = wide.isEmpty()
        dealt = family.join(shapes, "head", "left").where("idle IS NULL OR NOT idle").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod("c2", "blocks").cast("long")
        cells = dealt.withColumn("cell", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<long>")).otherwise(F.array(own))))
        links = self._compare(cells.withColumn("side", F.lit(2)), rule, "near")
        if narrow:
            return links
        return links.unionByName(self._across(family.join(wide, "head"), links, rule))

    def _across(self, family: DataFrame, links: DataFrame, rule: str) -> DataFrame:
        """Links between cells of the same family, for the classes that their own cell left unsettled.

        With rule ``earlier`` those are the classes without a match, else those outside the
        family's largest connected part.
        """
        me = F.struct("c1", "c2")
        if rule == "earlier":
            rows = family.join(links.select(F.col("a.c1").alias("c1"), F.col("a.c2").alias("c2"), F.lit(False).alias("open")).distinct(), ["c1", "c2"], "left")
            rows = rows.withColumn("open", F.coalesce("open", F.lit(True)))
        else:
            roots = components(links, self.scratch, "wide").select(F.col("class.c1").alias("c1"), F.col("class.c2").alias("c2"), "root")
            rows = family.join(roots, ["c1", "c2"], "left").withColumn("root", F.coalesce("root", me))
            parts = rows.groupBy("head", "root").agg(F.count(F.lit(1)).alias("m"))
            main = parts.groupBy("head").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
            rows = rows.join(main, "head").withColumn("open", F.col("root") != F.col("main"))
        rows = self.scratch.keep(rows.select("head", "c1", "c2", "size", "blocks", "open"), "unsettled")
        rows = rows.join(rows.where("open").select("head").distinct(), "head", "left_semi")
        rows = rows.withColumns({"up": F.lit(0), "down": F.lit(0), "own": F.pmod("c2", "blocks").cast("long")})
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
        left = rows.where("open").withColumn("side", F.lit(0)).withColumn("cell", F.col("own") * F.col("blocks") + F.col("other"))
        right = rows.withColumn("side", F.lit(1)).withColumn("cell", F.col("other") * F.col("blocks") + F.col("own"))
        return self._compare(left.unionByName(right), rule, "far")

    def _compare(self, cells: DataFrame, rule: str, tag: str) -> DataFrame:
        """Links of the classes in every cell (``head, cell, side, c1, c2, size, up, down``); written to storage."""
        keep = ["head", "cell", "side", "c1", "c2", "size"]
        beside = cells.join(self.info.select("c1", "c2", "bitmap"), ["c1", "c2"]).select(*keep, "up", "down", "bitmap")
        likely = _together(beside).mapInArrow(_in_cells(_likely), "head long, cell long, side int, c1 long, c2 long, size int")
        likely = self.scratch.keep(likely, f"likely_{tag}")
        first = likely.select("c1", "c2").distinct().join(self.info.drop("bitmap"), ["c1", "c2"])
        wanted = first.groupBy("doc_id").agg(F.collect_list(F.struct("unit", "c1", "c2")).alias("wanted"))
        wanted = self.scratch.keep(wanted, f"wanted_{tag}")
        sets = rows_with(self.docs, wanted).mapInArrow(_fetch(self.units), "c1 long, c2 long, doc_id long, unit long, tokens binary")
        sets = self.scratch.keep(sets, f"sets_{tag}")
        if sets.count() > first.count():  # rows that repeat an id and text
            sets = sets.dropDuplicates(["c1", "c2"])
        whole = likely.join(sets, ["c1", "c2"]).select(*keep, "doc_id", "unit", "tokens")
        found = _together(whole).mapInArrow(_in_cells(_linked(rule)), "a1 long, a2 long, b1 long, b2 long").distinct()
        pair = lambda x: F.struct(F.col(f"{x}1").alias("c1"), F.col(f"{x}2").alias("c2")).alias(x)
        links = self.scratch.keep(found.select(pair("a"), pair("b")), f"links_{tag}")
        self.scratch.drop(f"likely_{tag}", f"sets_{tag}", f"wanted_{tag}")
        return links


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("head", "cell").sortWithinPartitions("head", "cell")


def with_heads(keys: DataFrame) -> DataFrame:
    """``key, c1, c2, size, rank`` of the keys that two classes or more have, with ``n`` and the packed ``top``.

    The head is the class with the smallest first long.  Its upper bits name the family, the
    lowest ones of ``top`` have the head's rank; longs only, so that Spark hashes and needs no sort.
    Heads grow with the texts and Catalyst knows only the compressed size of ``keys``: they are never broadcast.
    """
    low = (1 << _RANK_BITS) - 1
    packed = F.col("c1").bitwiseAND(F.lit(~low)).bitwiseOR(F.least(F.col("rank").cast("long"), F.lit(low)))
    heads = keys.groupBy("key").agg(F.min(packed).alias("top"), F.min("c1").alias("a"), F.max("c1").alias("b"), F.count(F.lit(1)).alias("n"))
    return keys.join(heads.where("a <> b").select("key", "top", "n").hint("merge"), "key")


def families(keyed: DataFrame) -> DataFrame:
    """``head, c1, c2, size, up, down``: each class once per family, however many keys it has there.

    ``up`` and ``down`` are how much a common key stands later, or earlier, in the class than in the head, at most.
    """
    low = (1 << _RANK_BITS) - 1
    rank = F.col("top").bitwiseAND(F.lit(low))
    apart = F.when(rank == low, 0).otherwise(F.col("rank") - rank).cast("int")
    rows = keyed.select(F.shiftright("top", _RANK_BITS).alias("head"), "c1", "c2", "size", apart.alias("apart"))
    return rows.groupBy("head", "c1", "c2").agg(
        F.max("size").alias("size"), F.greatest(F.max("apart"), F.lit(0)).alias("up"), F.greatest(-F.min("apart"), F.lit(0)).alias("down")
    )


def shape(family: DataFrame, pivot) -> DataFrame:
    """``head, n, w, idle`` of every family: its classes, their tokens, and whether it has no pair that length and position allow.

    Most families are two classes that share one common shingle by chance; they go before bitmaps
    are moved.  The bounds are those of :func:`_likely`, which judges all other families.
    """
    apart = lambda p: F.sum(F.when(p, F.col("size")).otherwise(0))
    facts = family.groupBy("head").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.sum(pivot.cast("int")).alias("pivots"),
        apart(pivot).alias("y"), apart(~pivot).alias("x"), F.max("up").alias("up"), F.max("down").alias("down"),
    )
    near = f"{DENOMINATOR} * x >= {NUMERATOR} * y AND {DENOMINATOR} * y >= {NUMERATOR} * x"
    fits = f"{NUMERATOR + DENOMINATOR} * least(x - up, y - down) >= {NUMERATOR} * (x + y)"
    return facts.select("head", "n", "w", F.expr(f"n = 1 OR (n = 2 AND pivots = 1 AND NOT ({near} AND {fits}))").alias("idle"))


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``class, root`` for every class in ``links`` (``a, b``): the smallest class that is reachable.

    Minimum labels spread along links and then jump to their label's label, until nothing
    changes; every round is written to storage, so lineage stays short.  Labels of neighbours are
    reduced per task before they are shuffled; the join by a hub's many links is one that Spark splits.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = scratch.keep(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{tag}edges")
    labels = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root"))
    labels = scratch.keep(labels, f"{tag}labels0")
    turn = 0
    while True:
        turn += 1
        around = edges.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v")
        around = around.groupBy("u").agg(F.min("r").alias("m"))
        lower = labels.join(around, "u").select("u", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        target = lower.select(F.col("u").alias("root"), F.col("root").alias("next"))
        jumped = lower.join(target, "root", "left").select(
            "u", "old", F.least("root", F.coalesce("next", "root")).alias("root")
        )
        jumped = scratch.keep(jumped, f"{tag}labels{turn}")
        if jumped.where("old <> root").isEmpty():
            scratch.drop(f"{tag}edges", f"{tag}labels{turn - 1}")
            return jumped.select(F.col("u").alias("class"), "root")
        labels = jumped.select("u", "root")
        scratch.drop(f"{tag}labels{turn - 1}")


def subset_boundary(lists: DataFrame) -> int:
    """Up to which size joining by pairs of tokens costs less than scanning token lists.

    Both costs are counted over all rows, by size: keys to write for the one, rows that a set's
    lists have for the other.
    """
    size = F.least("size", F.lit(SMALL_MOST + 1)).alias("size")
    per_class = lists.groupBy("c1", "c2", size).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    rows = per_class.groupBy("size").agg(F.sum("n").alias("scan"), F.sum(F.expr("k * (k - 1) / 2")).alias("enum")).collect()
    scan, enum = ({r["size"]: r[name] for r in rows} for name in ("scan", "enum"))
    best, least = 1, sum(scan.values())
    for b in range(2, SMALL_MOST + 1):
        cost = sum(v for n, v in scan.items() if n > b) + sum(v for n, v in enum.items() if n <= b * DENOMINATOR // NUMERATOR)
        if cost < least:
            best, least = b, cost
    return best


def prefix_keys(lists: DataFrame) -> DataFrame:
    """The tokens of each class's shortest prefix that shares a token with every similar set's."""
    return lists.where(F.col("rank") <= F.col("size") - F.expr(_NEEDED))


def join_keys(lists: DataFrame, boundary: int) -> DataFrame:
    """Keys with their heads: pairs of prefix tokens for small sets, single tokens for large ones.

    Two sets that are similar share one token among the first ``size - needed + 1`` of each and
    two among the first ``size - needed + 2``.  Sets a little above the boundary have keys of
    both kinds, since they may be similar to sets below it.  Single tokens keep the heads they have
    in ``lists``; where a head has the token beyond its prefix, its family may lack it.
    """
    large = prefix_keys(lists.where(F.col("size") > boundary))
    small = (
        lists.where(F.col("size") <= boundary * DENOMINATOR // NUMERATOR)
        .groupBy("c1", "c2", "size")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("t"))
        .select(
            "c1",
            "c2",
            "size",
            F.explode(
                F.expr(
                    "flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)),"
                    " y -> named_struct('key', xxhash64(x.key, y.key), 'rank', x.rank))))"
                )
            ).alias("k"),
        )
        .select("k.key", "c1", "c2", "size", "k.rank")
    )
    return large.unionByName(with_heads(small))


_NEEDED = f"(({NUMERATOR} * size + {DENOMINATOR - 1}) div {DENOMINATOR})"


# -- functions that run on executors -------------------------------------------------------------


def _frequent(units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            for a, b in textcore.slices(texts):
                held.append(textcore.windows(textcore.words(units(texts.slice(a, b - a)).texts, lower=True), SHINGLE)[1])
                size += len(held[-1])
                if size >= exchange.SENDER_KEYS:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    return run


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    """The tokens that a sender has twice or more, the most frequent ones if there are many."""
    tokens = np.sort(np.concatenate(held))
    begin = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(begin, append=len(tokens))
    pick = np.flatnonzero(count > 1)
    if len(pick) > HEAVY_SENDER:
        pick = pick[np.argsort(-count[pick], kind="stable")[:HEAVY_SENDER]]
    return pa.RecordBatch.from_arrays(
        [pa.array(tokens[begin[pick]].view(np.int64)), pa.array(count[pick], pa.int64())], names=["token", "n"]
    )


#: What a sender says of its classes (``u_...``: of all its units), as arrays of numbers in one binary value each.
_LISTING = {
    "names": "<i8", "sizes": "<i4", "first": "<u4", "many": "?", "widths": "<i4", "maps": "u1",
    "u_item": "<u4", "u_doc": "<i8", "u_number": "<i8",
}
_STORED = pa.schema(
    [("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("m", pa.int32())]
    + [(x, pa.binary()) for x in ("keys", "fresh", "item", "place", *_LISTING)]
    + [(x, pa.int64()) for x in ("doc_id", "unit", "size", "c1", "c2")]
    + [("sha", pa.binary())]
)
_FOUND = pa.schema(
    [("token", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("size", pa.int32()), ("rank", pa.int32())]
    + [("doc_id", pa.int64()), ("unit", pa.int64()), ("bitmap", pa.binary())]
)
_FOUND_DDL = "token long, c1 long, c2 long, size int, `rank` int, doc_id long, unit long, bitmap binary"


def _wide(arrays: dict, schema: pa.Schema = _STORED) -> pa.RecordBatch:
    n = len(next(iter(arrays.values())))
    return pa.RecordBatch.from_arrays(
        [arrays[f.name] if f.name in arrays else pa.nulls(n, f.type) for f in schema], schema=schema
    )


class _Sender:
    """Units and prefix tokens until there are enough; then every class is listed once, with its first unit."""

    def __init__(self, number: int):
        self.number = number
        self.units: list[tuple[np.ndarray, ...]] = []
        self.tokens: list[tuple[np.ndarray, ...]] = []
        self.maps: list[np.ndarray] = []
        self.n_units = self.count = 0

    def add(self, s: Sets, rank: np.ndarray, doc: np.ndarray, number: np.ndarray, named: np.ndarray, names: np.ndarray) -> None:
        size = s.size
        own = np.flatnonzero(named)
        maps, width = bitmaps(s)
        data, begin = np.frombuffer(maps, np.uint8), np.concatenate(([0], np.cumsum(width)))
        self.units.append((names[own, 0], names[own, 1], doc[own], number[own], size[own], width[own]))
        self.maps += [data[begin[i] : begin[i + 1]] for i in own.tolist()]
        place = np.full(len(size), -1, np.int64)
        place[own] = self.n_units + np.arange(len(own))
        most = size - needed(size) + np.where(size <= SMALL_MOST * DENOMINATOR // NUMERATOR, 2, 1)
        pick = np.flatnonzero((rank < most[s.unit]) & (place[s.unit] >= 0))
        self.tokens.append((s.token[pick], place[s.unit[pick]], rank[pick]))
        self.n_units += len(own)
        self.count += len(pick)

    def rows(self, n_owners: int) -> Iterator[pa.RecordBatch]:
        if not self.n_units:
            return
        c1, c2, doc, number, size, width = (np.concatenate(x) for x in zip(*self.units, strict=True))
        order = np.lexsort((number, doc, c2, c1))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
        item = np.empty(len(order), np.int64)
        item[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        chosen = np.zeros(len(order), bool)
        chosen[first] = True
        said = {
            "names": np.stack((c1[first], c2[first]), axis=1), "sizes": size[first], "first": first,
            "many": np.bincount(item) > 1, "widths": width[first], "maps": np.concatenate([self.maps[i] for i in first.tolist()]),
            "u_item": item, "u_doc": doc, "u_number": number,
        }
        listing = {name: pa.array([np.ascontiguousarray(v).astype(_LISTING[name]).tobytes()], pa.binary()) for name, v in said.items()}
        yield _wide({"sender": pa.array([self.number], pa.int64()), "owner": pa.array([-1], pa.int32()), **listing})
        token, unit, rank = (np.concatenate(x) for x in zip(*self.tokens, strict=True))
        pick = chosen[unit]
        payload = {"item": item[unit[pick]].astype("<u4"), "place": rank[pick].astype("<u4")}
        batch = exchange.messages(self.number, n_owners, token[pick], payload)
        yield _wide({name: batch.column(name) for name in batch.schema.names})


def _postings(units, heavy, n_owners: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = exchange.sender_ids()
        sender = _Sender(next(numbers))
        frequent = heavy.value
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in textcore.slices(texts):
                u = units(texts.slice(a, b - a))
                s = shingle_sets(u.texts)
                names = classes(s).view(np.int64)
                own = ids.slice(a, b - a)
                named = own.is_valid().to_numpy(zero_copy_only=False)[u.doc] & (s.size > 0)
                doc = own.fill_null(0).to_numpy(zero_copy_only=False)[u.doc]
                sender.add(s, ranks(s, frequent), doc, u.number, named, names)
                if whole:
                    columns = {x: pa.array(names[:, i], pa.int64(), mask=~named) for i, x in enumerate(("c1", "c2"))}
                    yield _wide({"doc_id": own, "unit": pa.array(u.number, pa.int64()), "size": pa.array(s.size, pa.int64()), **columns})
                else:
                    data, at = textcore.raw(texts.slice(a, b - a))
                    sha = [hashlib.sha256(data[x:y]).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    n_units = np.bincount(u.doc, minlength=b - a)
                    yield _wide({"doc_id": own, "unit": pa.array(n_units, pa.int64()), "sha": pa.array(sha, pa.binary())})
                if sender.count >= exchange.SENDER_KEYS or sender.n_units >= exchange.SENDER_KEYS:
                    yield from sender.rows(n_owners)
                    sender = _Sender(next(numbers))
        yield from sender.rows(n_owners)

    return run


def _alive(whole: bool):
    """Of one sender: the tokens that occur again, the classes that have one or occur again, and (of lines) their units."""

    def run(stored: pa.Table, answers: pa.Table) -> pa.Table:
        listing = stored.filter(pc.less(stored["owner"], 0))
        said = {name: np.frombuffer(listing[name].to_pylist()[0], kind) for name, kind in _LISTING.items()}
        names = said["names"].reshape(-1, 2)
        found = exchange.repeated(stored, answers, {"item": "<u4", "place": "<u4"})
        item = found["item"].astype(np.int64)
        again = said["many"].copy()
        again[item] = True
        begin = np.concatenate(([0], np.cumsum(said["widths"])))
        at = np.flatnonzero(again)
        maps = [said["maps"][begin[i] : begin[i + 1]].tobytes() for i in at.tolist()]
        class_of = lambda i: {"c1": pa.array(names[i, 0]), "c2": pa.array(names[i, 1]), "size": pa.array(said["sizes"][i], pa.int32())}
        out = [
            {"token": pa.array(found["key"].view(np.int64)), **class_of(item), "rank": pa.array(found["place"].astype(np.int32))},
            {**class_of(at), "doc_id": pa.array(said["u_doc"][said["first"][at]]), "unit": pa.array(said["u_number"][said["first"][at]]), "bitmap": pa.array(maps, pa.binary())},
        ]
        if not whole:
            u = np.flatnonzero(again[said["u_item"]])
            out.append({**class_of(said["u_item"][u]), "doc_id": pa.array(said["u_doc"][u]), "unit": pa.array(said["u_number"][u])})
        return pa.Table.from_batches([_wide(x, _FOUND) for x in out], schema=_FOUND)

    return run


def _in_cells(work):
    """``work`` on tables of whole cells, whatever batches they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if held and _place(held[-1], held[-1].num_rows - 1) != _place(batch, 0):
                yield work(pa.Table.from_batches(held).combine_chunks())
                held = []
            # the last cell may go on in the next batch
            ends = _cell_ends(batch)
            if len(ends) > 1:
                held.append(batch.slice(0, ends[-2]))
                yield work(pa.Table.from_batches(held).combine_chunks())
                held = [batch.slice(ends[-2])]
            else:
                held.append(batch)
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _place(batch, row: int) -> tuple:
    return tuple(batch.column(c)[row].as_py() for c in ("head", "cell"))


def _cell_ends(batch) -> np.ndarray:
    at = [np.asarray(batch.column(c)) for c in ("head", "cell")]
    fresh = np.zeros(batch.num_rows, bool)
    for x in at:
        fresh[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(fresh), batch.num_rows)


def _chunk(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


#: Pairs that are looked at together.
_PAIRS = 1 << 20


def _least(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least overlap of two similar sets of these sizes."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def _lengths(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (DENOMINATOR * n >= NUMERATOR * m) & (DENOMINATOR * m >= NUMERATOR * n)


def _likely(table: pa.Table) -> pa.RecordBatch:
    """The classes that the filters leave a partner in their cell.

    Each class meets the head first, all cells of the table at once, by length, position and
    bitmap; one that this leaves without a partner meets the rest of its cell.
    """
    column = lambda name: np.asarray(table[name]).astype(np.int64)
    head, c1, size, up, down, side = (column(x) for x in ("head", "c1", "size", "up", "down", "side"))
    maps = _chunk(table["bitmap"])
    ends = _cell_ends(table)
    begin = np.concatenate(([0], ends[:-1]))
    cell = np.repeat(np.arange(len(ends)), ends - begin)
    keep = np.zeros(len(size), bool)
    heads = np.flatnonzero(((c1 >> _RANK_BITS) == head) & (side == 2))
    of_cell = np.full(len(ends), -1)
    of_cell[cell[heads][::-1]] = heads[::-1]
    several = np.bincount(cell[heads], minlength=len(ends)) > 1
    pivot = of_cell[cell]
    x = np.flatnonzero((pivot >= 0) & (pivot != np.arange(len(size))))
    y = pivot[x]
    most = np.minimum(size[x] - up[x], size[y] - down[x])
    fine = _lengths(size[x], size[y]) & (several[cell[x]] | (most >= _least(size[x], size[y])))
    _mark(keep, x[fine], y[fine], size, maps)
    rest = np.flatnonzero(~keep & (pivot != np.arange(len(size))) & (side != 1))
    many = (ends - begin)[cell[rest]]
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 1, _PAIRS), side="left")
    for a, b in zip(cuts, [*cuts[1:], len(rest)], strict=True):
        own, n = rest[a:b], many[a:b]
        x = np.repeat(own, n)
        y = np.repeat(begin[cell[own]], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        fine = (x != y) & (y != pivot[x]) & ((side[x] == 2) | (side[y] == 1)) & _lengths(size[x], size[y])
        _mark(keep, x[fine], y[fine], size, maps)
    names = ["head", "cell", "side", "c1", "c2", "size"]
    return pa.RecordBatch.from_arrays([_chunk(table[c]).filter(pa.array(keep)) for c in names], names=names)


def _mark(keep: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, maps: pa.Array) -> None:
    """Mark both members of the pairs whose bitmaps allow enough overlap: differing parities need differing tokens."""
    data, at = textcore.raw(maps)
    width = np.diff(at)
    narrow = np.minimum(width[x], width[y])
    for to in np.unique(narrow).tolist():
        pick = np.flatnonzero(narrow == to)
        rows, place = np.unique(np.concatenate((x[pick], y[pick])), return_inverse=True)
        bits = np.empty((len(rows), to), np.uint8)
        for w in np.unique(width[rows]).tolist():
            some = np.flatnonzero(width[rows] == w)
            wide = data[at[rows[some]][:, None] + np.arange(w)]
            bits[some] = np.bitwise_xor.reduce(wide.reshape(len(some), -1, to), axis=1)
        p, q = place[: len(pick)], place[len(pick) :]
        step = max(1, (4 << 20) // to)
        for i in range(0, len(pick), step):
            a, b = x[pick[i : i + step]], y[pick[i : i + step]]
            odd = np.bitwise_count(bits[p[i : i + step]] ^ bits[q[i : i + step]]).sum(axis=1, dtype=np.int64)
            good = (size[a] + size[b] - odd) // 2 >= _least(size[a], size[b])
            keep[a[good]] = keep[b[good]] = True


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens every two of the sets have in common."""
    n = len(sets)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    total = np.zeros(n * n, np.int64)
    pending: list[np.ndarray] = []
    step = 1
    while True:
        same = np.flatnonzero(tokens[step:] == tokens[:-step])
        if len(same):
            pending.append(owner[same] * n + owner[same + step])
        if pending and (not len(same) or sum(map(len, pending)) > _PAIRS):
            total += np.bincount(np.concatenate(pending), minlength=n * n)
            pending = []
        if not len(same):
            out = total.reshape(n, n)
            return out + out.T
        if step == 16:  # from here on mostly long runs are left: forget the others
            run = np.cumsum(np.concatenate(([True], tokens[1:] != tokens[:-1]))) - 1
            long = np.bincount(run)[run] > 16
            tokens, owner = tokens[long], owner[long]
        step += 1


def _linked(rule: str):
    def work(table: pa.Table) -> pa.RecordBatch:
        """What the caller needs of the links in every cell: see :meth:`Engine.links`."""
        c1, c2, side, doc, unit = (np.asarray(table[c]).astype(np.int64) for c in ("c1", "c2", "side", "doc_id", "unit"))
        held = _chunk(table["tokens"])
        data, at = textcore.raw(held)
        found: list[np.ndarray] = []
        begin = 0
        for end in _cell_ends(table).tolist():
            if end - begin > 1:
                sets = [np.frombuffer(data[at[i] : at[i + 1]].tobytes(), np.uint64) for i in range(begin, end)]
                size = np.array([len(x) for x in sets])
                common = overlaps(sets)
                link = DENOMINATOR * common >= NUMERATOR * (size[:, None] + size[None, :] - common)
                own = slice(begin, end)
                link &= (side[own][:, None] == 2) | (side[own][:, None] != side[own][None, :])
                pairs = _forest(link) if rule == "forest" else _earlier(link, doc[own], unit[own], side[own])
                found.append(pairs + begin)
            begin = end
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        columns = [pa.array(c[pairs[:, i]]) for i in (0, 1) for c in (c1, c2)]
        return pa.RecordBatch.from_arrays(columns, names=["a1", "a2", "b1", "b2"])

    return work


def _forest(link: np.ndarray) -> np.ndarray:
    """Pairs that connect what ``link`` connects, one less than members of every part."""
    out: list[tuple[int, int]] = []
    free = np.ones(len(link), bool)
    for start in range(len(link)):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            a = todo.pop()
            near = np.flatnonzero(link[a] & free).tolist()
            free[near] = False
            out += [(a, b) for b in near]
            todo += near
    return np.array(out, np.int64).reshape(-1, 2)


def _earlier(link: np.ndarray, doc: np.ndarray, unit: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each row that may be asked for (not side 1) the earliest linked row before it, if there is one."""
    order = np.lexsort((unit, doc))
    ranked = link[np.ix_(order, order)] & np.tri(len(link), k=-1, dtype=bool)
    same = (doc[order][:, None] == doc[order][None, :]) & (unit[order][:, None] == unit[order][None, :])
    ranked &= ~same & (side[order] != 1)[:, None]
    rows = np.flatnonzero(ranked.any(axis=1))
    return np.stack((order[rows], order[ranked[rows].argmax(axis=1)]), axis=1) if len(rows) else np.zeros((0, 2), np.int64)


def _fetch(units):
    """The sets of the wanted classes; a text of the same id that is another class gives nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textcore.as_strings(batch.column("text"))
            wanted = batch.column("wanted").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for a, b in textcore.slices(texts):
                u = units(texts.slice(a, b - a))
                s = shingle_sets(u.texts)
                names = classes(s).view(np.int64)
                begin = np.searchsorted(u.doc, np.arange(b - a + 1))
                out: list[tuple] = []
                for d, rows in enumerate(wanted[a:b]):
                    for row in rows:
                        i = begin[d] + row["unit"]
                        if i < begin[d + 1] and (names[i, 0], names[i, 1]) == (row["c1"], row["c2"]):
                            out.append((row["c1"], row["c2"], ids[a + d], row["unit"], s.token[s.first[i] : s.first[i + 1]].tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["c1", "c2", "doc_id", "unit", "tokens"]
                )

    return run
