"""The manifest: which runs are live, and what to compact next.

``actions`` has ``action_seq, action ('add' | 'remove')`` and the columns of a run:
``id, path, min_key, max_key, level, file_size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.config import Config


def replay(actions: DataFrame) -> DataFrame:
    """Live runs: of each run and level the last action, if it added it."""
    rank = F.row_number().over(Window.partitionBy("level", "id").orderBy(F.col("action_seq").desc()))
    return actions.withColumn("_rank", rank).where("_rank = 1 AND action = 'add'").drop("_rank", "action", "action_seq")


def add(actions: DataFrame, runs: DataFrame, action: str = "add") -> DataFrame:
    """The log with one action more for every run, numbered after the last one."""
    last = actions.agg(F.coalesce(F.max("action_seq"), F.lit(-1)).alias("_last"))
    rank = F.row_number().over(Window.orderBy("level", "id"))  # a manifest has a row per file
    more = runs.withColumn("action", F.lit(action)).crossJoin(F.broadcast(last))
    return actions.unionByName(more.withColumn("action_seq", F.col("_last") + rank).drop("_last").select(actions.columns))


def remove(actions: DataFrame, runs: DataFrame) -> DataFrame:
    return add(actions, runs, "remove")


def level(manifest: DataFrame, number: int) -> DataFrame:
    """The runs of a level in their order: smallest key (none first), then id."""
    return manifest.where(F.col("level") == number).orderBy(F.col("min_key").asc_nulls_first(), "id")


def summary(manifest: DataFrame) -> DataFrame:
    """``level, tables, bytes, min_key, max_key``."""
    return manifest.groupBy("level").agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum("file_size").alias("bytes"),
        F.min("min_key").alias("min_key"),
        F.max("max_key").alias("max_key"),
    )


def stats_text(manifest: DataFrame) -> str:
    """One line per level, for people."""
    rows = summary(manifest).orderBy("level").collect()
    return "\n".join(f"level {r.level}: {r.tables} tables, {bytes(r.min_key).hex()}..{bytes(r.max_key).hex()}" for r in rows)


def capacity(level: Column | str, config: Config = Config()) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.when(c == 0, F.lit(config.young_tables)).otherwise(F.pow(F.lit(config.level_base), c)).cast("long")


def over_capacity(manifest: DataFrame, config: Config = Config()) -> DataFrame:
    """``level, tables, capacity, over``."""
    counts = manifest.groupBy("level").agg(F.count(F.lit(1)).alias("tables"))
    return counts.withColumn("capacity", capacity("level", config)).withColumn("over", F.col("tables") > F.col("capacity"))


def adaptive_count(tables: Column | str, limit: Column | str) -> Column:
    """Runs to compact at once: a tenth of what is too many, between 1 and 5 (rounded toward zero)."""
    t, c = (F.col(x) if isinstance(x, str) else x for x in (tables, limit))
    excess = t - c
    tenth = F.when(excess >= 0, F.floor(excess / 10)).otherwise(F.ceil(excess / 10))
    return F.greatest(F.lit(1), F.least(F.lit(5), tenth)).cast("int")


def next_candidates(manifest: DataFrame) -> DataFrame:
    """``level, id, next_id``: whose turn comes after each run, wrapping around its level."""
    order = Window.partitionBy("level").orderBy(F.col("min_key").asc_nulls_first(), "id")
    first = F.first("id").over(order)
    return manifest.select("level", "id", F.coalesce(F.lead("id").over(order), first).alias("next_id"))


def next_candidate(manifest: DataFrame, last: tuple[bytes, int] | None) -> tuple[bytes, int] | None:
    """The run of one level after ``last`` in its order, or the first; none for an empty level."""
    key = F.struct("min_key", "id")
    rows = manifest.select(key.alias("k"))
    if last is not None:
        after = (F.col("k.min_key") > F.lit(last[0])) | ((F.col("k.min_key") == F.lit(last[0])) & (F.col("k.id") > last[1]))
        row = rows.where(after).agg(F.min("k").alias("k")).first()
        if row["k"] is not None:
            return bytes(row["k"]["min_key"]), row["k"]["id"]
    row = rows.agg(F.min("k").alias("k")).first()
    return None if row["k"] is None else (bytes(row["k"]["min_key"]), row["k"]["id"])


def trivial_moves(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that share no key with any other source or target: they change their level only."""
    from . import ranges

    met = ranges.overlapping(sources, targets).select("id")
    among = ranges.overlapping(sources)
    met = met.unionByName(among.select("id")).unionByName(among.select(F.col("other_id").alias("id"))).distinct()
    return sources.join(met, "id", "left_anti").withColumn("level", F.col("level") + 1)


def vacuum_candidates(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``path``) that no live run has."""
    return files.join(manifest.select("path"), "path", "left_anti")


def next_file_number(paths: DataFrame, prefix: str) -> DataFrame:
    """One row ``next``: the highest number after the prefix, plus one (1 for none)."""
    number = F.regexp_extract("path", f"(?:^|/){prefix}([0-9]+)$", 1)
    return paths.where(number != "").agg((F.coalesce(F.max(number.cast("long")), F.lit(0)) + 1).alias("next"))
