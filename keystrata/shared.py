"""The shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Without one, a session in local mode gets a temporary folder; on a cluster nothing local is
    safe to write to, so the setting is asked for.
    """
    where = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} is not set: name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='keystrata-')}"
        spark.conf.set(_SETTING, where)
    return where.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what follows sees the same rows however often it reads them."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
