"""Key ranges: which runs cover a key, which runs overlap, floor lookup.

Few ranges are broadcast (their number is checked); many are dealt into buckets of the key
space, whose bounds are quantiles of the ranges' lower ends, and met by an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.config import Config

_BUCKETS = 256


def _bounds(ranges: DataFrame) -> list[bytes]:
    """At most ``_BUCKETS`` lower ends at about equal distances in rank.

    They are taken from the keys with the smallest hashes, a bounded and repeatable sample that each
    task reduces first; where the bounds lie decides how even buckets are, not what is found.
    """
    sample = ranges.select("min_key").where("min_key IS NOT NULL").orderBy(F.xxhash64("min_key"), "min_key").limit(16 * _BUCKETS)
    keys = sorted({bytes(r["min_key"]) for r in sample.collect()})
    return keys[:: max(1, -(-len(keys) // _BUCKETS))]


def _bucket(key: Column, bounds: list[bytes]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= key))


def covering(points: DataFrame, ranges: DataFrame, limit: int = Config.broadcast_rows) -> DataFrame:
    """Pairs of points (``key``) and ranges (``min_key, max_key``, inclusive) that cover them."""
    inside = (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))
    if ranges.limit(limit + 1).count() <= limit:
        return points.join(F.broadcast(ranges), inside)
    bounds = _bounds(ranges)
    dealt = ranges.withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col("min_key"), bounds), _bucket(F.col("max_key"), bounds)))
    )
    return points.withColumn("_bucket", _bucket(F.col("key"), bounds)).join(dealt, "_bucket").where(inside).drop("_bucket")


def overlapping(ranges: DataFrame, others: DataFrame | None = None, limit: int = Config.broadcast_rows) -> DataFrame:
    """``id, other_id`` of ranges that share a key; of one table each pair once."""
    same = others is None
    right = (ranges if same else others).select(
        F.col("id").alias("other_id"), F.col("min_key").alias("other_min"), F.col("max_key").alias("other_max")
    )
    meet = (F.col("min_key") <= F.col("other_max")) & (F.col("other_min") <= F.col("max_key"))
    if same:
        meet = meet & (F.col("id") < F.col("other_id"))
    left = ranges.select("id", "min_key", "max_key")
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), meet).select("id", "other_id")
    bounds = _bounds(ranges)
    deal = lambda df, a, b: df.withColumn(
        "_bucket", F.explode(F.sequence(_bucket(F.col(a), bounds), _bucket(F.col(b), bounds)))
    )
    pairs = deal(left, "min_key", "max_key").join(deal(right, "other_min", "other_max"), "_bucket").where(meet)
    return pairs.select("id", "other_id").distinct()


def floor_lookup(points: DataFrame, index: DataFrame) -> DataFrame:
    """Points with the ``offset`` of the greatest ``min_key`` that is not above ``key`` (null: none).

    Points and index entries are dealt into buckets of the key space and read in key order, each
    point taking the last entry before it; a bucket's first points take the last entry of the
    buckets before, of which there is one for each bucket.
    """
    bounds = _bounds(index)
    dealt = index.select("min_key", "offset", _bucket(F.col("min_key"), bounds).alias("_bucket"))
    lasts = dealt.groupBy("_bucket").agg(F.max(F.struct("min_key", "offset"))["offset"].alias("_last")).orderBy("_bucket").collect()
    kind = index.schema["offset"].dataType
    before = F.lit(None).cast(kind)
    for r in lasts:  # at most one for each bucket
        before = F.when(F.col("_bucket") > r["_bucket"], F.lit(r["_last"]).cast(kind)).otherwise(before)
    rows = points.withColumns({"_bucket": _bucket(F.col("key"), bounds), "_at": F.col("key"), "_entry": F.lit(False), "_offset": F.lit(None).cast(kind)})
    entries = dealt.select("_bucket", F.col("min_key").alias("_at"), F.lit(True).alias("_entry"), F.col("offset").alias("_offset"))
    order = Window.partitionBy("_bucket").orderBy("_at", F.col("_entry").desc(), "_offset")
    both = rows.unionByName(entries, allowMissingColumns=True).withColumn("offset", F.coalesce(F.last("_offset", ignorenulls=True).over(order), before))
    return both.where("NOT _entry").drop("_bucket", "_at", "_entry", "_offset")


def block_index(runs: DataFrame, block: int) -> DataFrame:
    """``run_id, block_id, min_key, offset``: the first key that begins in each block.

    ``runs`` has ``run_id, key, start`` (the record's place in its file).
    """
    at = F.floor(F.col("start") / block).cast("long")
    return (
        runs.groupBy("run_id", at.alias("block_id"))
        .agg(F.min("key").alias("min_key"))
        .withColumn("offset", F.col("block_id") * block)
    )
