"""Shared working folder for tables that cut lineage."""

from __future__ import annotations

import math
import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.shared import root

#: Folders of this process that have not been removed.
_OPEN: dict[str, SparkSession] = {}


def sweep(spark: SparkSession, *but: Scratch) -> None:
    """Delete the working tables of all operators of this session but ``but``.

    For callers whose results have been written: a result that is still to be computed reads them.
    """
    for base in [b for b, s in _OPEN.items() if s is spark and b not in {x.base for x in but}]:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _OPEN[base]


class Scratch:
    """Tables of one operator run below :func:`keystrata.shared.root`.

    A table that has been written is read back from storage that every executor shares, so
    an executor that is lost later costs at most the tasks that it was running.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        _OPEN[self.base] = spark
        reach(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no result still to be computed reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def reach(spark: SparkSession) -> None:
    """Let the Python workers import this package when the driver found it on its own path only."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths and home in [os.path.abspath(p) for p in sys.path]:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


#: Bytes of input (as Catalyst estimates them) behind the keys of one owner.
OWNER_BYTES = 64 << 20


def owners(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Into how many ranges hashed keys are dealt: with the size of the input, and not fewer than shuffles have partitions.

    An owner holds the keys of its range at once, so their number has to grow with the input.
    """
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs is None:
        return least
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // OWNER_BYTES)) if size < 1 << 55 else least  # else Catalyst does not know the size


#: Most ids that are broadcast as they are, and most buckets of ids (each one long) where there are more.
BROADCAST_IDS, BROADCAST_BUCKETS = 10_000, 1 << 20


def rows_with(docs: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """``docs`` beside the rows of ``wanted`` (a stored table, one row per key, ``doc_id`` by default) that have the same key.

    Few wanted rows are broadcast, counted before.  Of more, the buckets of their hashed keys
    are broadcast, a bounded table without false negatives, so that mostly wanted rows are shuffled.
    """
    on = list(key or ("doc_id",))
    n = wanted.count()
    if n <= BROADCAST_IDS:
        return docs.join(F.broadcast(wanted), on)
    if n < 2 * BROADCAST_BUCKETS:
        m = min(BROADCAST_BUCKETS, 1 << math.ceil(math.log2(8 * n)))
        bucket: Column = F.pmod(F.xxhash64(*on), F.lit(m)).alias("_bucket")
        some = wanted.select(bucket).distinct()
        docs = docs.withColumn("_bucket", bucket).join(F.broadcast(some), "_bucket", "left_semi").drop("_bucket")
    return docs.join(wanted.hint("merge"), on)  # at any size in the same way


def rows_without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` but for the rows whose ``key`` is in ``gone`` (a stored table of ``key``); rows with a null key stay.

    The buckets of the hashed keys in ``gone`` are broadcast, a bounded table; rows of other buckets
    stay where they are, and only the rest is shuffled (at any size in the same way) and compared by key.
    """
    n = gone.count()
    if n >= 2 * BROADCAST_BUCKETS:
        return docs.join(gone.hint("merge"), key, "left_anti")
    m = min(BROADCAST_BUCKETS, 1 << math.ceil(math.log2(16 * max(n, 1))))
    bucket: Column = F.pmod(F.xxhash64(key), F.lit(m)).alias("_bucket")
    some = F.broadcast(gone.select(bucket).distinct())
    dealt = docs.withColumn("_bucket", bucket)
    away = dealt.join(some, "_bucket", "left_anti").drop("_bucket")
    near = dealt.join(some, "_bucket", "left_semi").drop("_bucket")
    return away.unionByName(near.join(gone.hint("merge"), key, "left_anti"))
