"""Newest-wins reduction of mutations ``(seq, key, op, value)`` and lookups on it.

``seq`` is the one order of writes.  A deletion is a row with ``op = 'delete'`` and no value; an
empty value is a live one.  Lookups keep the three answers apart - value, deleted, never
written - until their last projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.shared import keep

PUT, DELETE = "put", "delete"


def newest(mutations: DataFrame, by: str = "key", order: str = "seq") -> DataFrame:
    """The newest row of every key, deletions included.

    A ranked window: Spark keeps one row per key and task before the shuffle
    (``WindowGroupLimit``), so a hot key costs one row per task, and a filter on the key above
    this view reaches the scan.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))
    return mutations.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def live(mutations: DataFrame) -> DataFrame:
    """``key, value, seq`` of the keys whose newest mutation is a put."""
    return newest(mutations).where(F.col("op") == PUT).select("key", "value", "seq")


def with_tombstones(mutations: DataFrame) -> DataFrame:
    """``key, value, seq, deleted`` of every key that was ever written."""
    return newest(mutations).select("key", "value", "seq", (F.col("op") == DELETE).alias("deleted"))


def size(mutations: DataFrame) -> DataFrame:
    """One row ``n``: live keys.  Distinct keys are counted after a map-side reduction."""
    state = mutations.groupBy("key").agg(F.max(F.struct("seq", "op")).alias("s"))
    return state.agg(F.count(F.when(F.col("s.op") == PUT, 1)).alias("n"))


def get(mutations: DataFrame, key: bytes | Column) -> DataFrame:
    """``key, value, state`` of one key; no row if it was never written."""
    wanted = key if isinstance(key, Column) else F.lit(key)
    return newest(mutations.where(F.col("key") == wanted)).select("key", _value(), _state())


def multi_get(mutations: DataFrame, keys: DataFrame, keep: int = 1_000_000) -> DataFrame:
    """``key, value, state`` for every row of ``keys``; state is put, delete or absent.

    Requested keys are sent to the scan if they are few (their number is counted), so that only
    their mutations are shuffled; otherwise both sides meet by key.
    """
    wanted = keys.select("key")
    asked = wanted.distinct()
    few = asked.limit(keep + 1).count() <= keep
    hits = mutations.join(F.broadcast(asked) if few else asked, "key", "left_semi")
    found = newest(hits).select("key", "value", "op")
    return wanted.join(found, "key", "left").select("key", _value(), _state())


def _state() -> Column:
    return F.coalesce(F.col("op"), F.lit("absent")).alias("state")


def _value() -> Column:
    return F.when(F.col("op") == PUT, F.col("value")).alias("value")


def scan(mutations: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Live rows with ``low <= key <= high`` in key order (an extension: ranges over the whole store)."""
    inside = mutations
    if low is not None:
        inside = inside.where(F.col("key") >= F.lit(low))
    if high is not None:
        inside = inside.where(F.col("key") <= F.lit(high))
    return live(inside).orderBy("key")


#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_ROW_BITS = 33


def positions(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Rows numbered from 1 in the order of columns (without any: in some order), without gathering them in one task.

    Rows are range-partitioned, sorted within partitions and written once with the place of each in
    its partition.  Counts and rows are both read from that table: partitioning twice would sample
    two sets of bounds, and the offsets of one do not fit the rows of the other.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    stored = keep(dealt.withColumn("_id", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("_id", _ROW_BITS).alias("_part")
    counts = stored.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return stored.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + at).drop(
        "_part", "_id", "_before"
    )


def merge(runs: DataFrame) -> DataFrame:
    """K-way merge of sorted runs: the newest row per key, deletions kept, in key order."""
    return newest(runs).orderBy("key")


def merge_final(runs: DataFrame) -> DataFrame:
    """A merge into the lowest place that a key can be in: deletions have nothing left to hide."""
    return newest(runs).where(F.col("op") == PUT).orderBy("key")


def young_get(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key the row of the newest overlapping run that holds it (``run_id``, then ``seq``)."""
    wanted = keys.select("key").distinct()
    rows = runs.join(wanted, "key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("run_id").desc(), F.col("seq").desc()))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def level_get(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """For each key the row of the shallowest level that holds it; the newest one there."""
    wanted = keys.select("key").distinct()
    rows = runs.join(wanted, "key", "left_semi")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("level", F.col("seq").desc()))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def counters(mutations: DataFrame) -> DataFrame:
    """``op, n`` of all mutations."""
    return mutations.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def hit_rate(accesses: DataFrame, table: str = "table") -> DataFrame:
    """One row ``operations, misses, rate`` of a cache that never evicts: the first access of a table is its only miss."""
    per = accesses.groupBy(table).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("operations"),
        F.count(F.lit(1)).alias("misses"),
        ((F.sum("n") - F.count(F.lit(1))) / F.sum("n")).alias("rate"),
    )


def lru_hits(accesses: DataFrame, capacity: int, reader: str = "reader", table: str = "table", order: str = "seq") -> DataFrame:
    """``reader, operations, misses`` of caches of ``capacity`` tables that evict the least recently used one.

    A table is still cached when fewer than ``capacity`` other tables were read since its last
    access.  Each reader (an executor, say) has a cache of its own and is folded in order with the
    cached tables as the only state.
    """
    from collections import OrderedDict

    import pyarrow as pa

    def fold(rows: pa.Table) -> pa.Table:
        cached: OrderedDict = OrderedDict()
        misses = 0
        for name in rows.sort_by("_order")["_table"].to_pylist():
            if name in cached:
                cached.move_to_end(name)
                continue
            misses += 1
            cached[name] = None
            if len(cached) > capacity:
                cached.popitem(last=False)
        return pa.table({"reader": rows["_reader"][:1], "operations": pa.array([rows.num_rows], pa.int64()), "misses": pa.array([misses], pa.int64())})

    kind = accesses.schema[reader].dataType.simpleString()
    named = accesses.select(F.col(reader).alias("_reader"), F.col(table).alias("_table"), F.col(order).alias("_order"))
    return named.groupBy("_reader").applyInArrow(fold, f"reader {kind}, operations long, misses long")
