"""A versioned key-value store on Parquet: log batches, sorted runs in levels, manifest versions.

Layout below the store's path::

    log/batch=N/       mutations not yet flushed, in batches
    runs/<name>/       sorted runs; each Parquet file is one run with a key range
    manifest/<version> one JSON file per version: live runs, flushed batches, last seq

Files are immutable.  A change writes new files first and then publishes one new manifest
version, by creating a file that must not exist; readers keep the version that they opened.
"""

from __future__ import annotations

import base64
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.config import Config
from keystrata.operators import latest, manifest

MUTATION = "seq long, key binary, op string, value binary"
RUN = "id long, path string, min_key binary, max_key binary, level int, file_size long"


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class Store:
    """One store; writes come from one driver at a time (others get :class:`Conflict`)."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or Config()
        self.reads = self.writes = 0
        self.state: dict = {}
        self.start()

    # -- manifest versions -----------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def start(self) -> None:
        """Open the newest version, or begin an empty store."""
        fs, folder = self._fs(f"{self.path}/manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            self.state = {"version": 0, "seq": -1, "batches": [], "next_batch": 0, "next_id": 1, "runs": [], "turn": {}}
            return
        text = self.spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0]
        self.state = json.loads(text)

    def publish(self, **changes) -> None:
        new = self.state | changes | {"version": self.state["version"] + 1}
        fs, target = self._fs(f"{self.path}/manifest/{new['version']:012d}.json")
        try:
            out = fs.create(target, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(str(target)) from e
            raise
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        self.state = new

    def manifest(self) -> DataFrame:
        rows = [
            (r["id"], r["path"], bytearray(base64.b64decode(r["min_key"])), bytearray(base64.b64decode(r["max_key"])), r["level"], r["file_size"])
            for r in self.state["runs"]
        ]
        return self.spark.createDataFrame(rows, RUN)

    # -- writes --------------------------------------------------------------------------------

    def write(self, mutations: DataFrame, order: str | None = None, **state) -> None:
        """Append ``key, op, value`` rows; among rows of one call ``order`` tells which is newer.

        ``state`` is published in the same version as the rows.
        """
        rows = mutations.select("key", "op", F.when(F.col("op") == latest.PUT, F.col("value")).alias("value"), *([F.col(order).alias("_o")] if order else []))
        rows = latest.positions(rows, *(["_o"] if order else []), name="_p")
        number, last = self.state["next_batch"], self.state["seq"]
        target = f"{self.path}/log/{number:09d}-{uuid.uuid4().hex}"
        rows.select((F.lit(last) + F.col("_p")).alias("seq"), "key", "op", "value").write.parquet(target)
        top = self.spark.read.parquet(target).agg(F.max("seq"), F.count(F.lit(1)), F.sum(_data_bytes())).first()
        self.writes += top[1]
        batch = {"path": target, "bytes": int(top[2] or 0)}
        self.publish(seq=last if top[0] is None else top[0], next_batch=number + 1, batches=[*self.state["batches"], batch], **state)
        if sum(b["bytes"] for b in self.state["batches"]) > self.config.log_bytes:
            self.flush()

    def put(self, rows: DataFrame, order: str | None = None) -> None:
        """Upsert ``key, value`` rows (values are not null)."""
        self.write(rows.where("value IS NOT NULL").withColumn("op", F.lit(latest.PUT)), order)

    def delete(self, keys: DataFrame) -> None:
        rows = keys.select("key").withColumn("op", F.lit(latest.DELETE))
        self.write(rows.withColumn("value", F.lit(None).cast("binary")))

    def flush(self) -> None:
        """Turn the log batches into runs of level 0, deletions included."""
        if not self.state["batches"]:
            return
        mutations = self.spark.read.schema(MUTATION).parquet(*(b["path"] for b in self.state["batches"]))
        size = sum(b["bytes"] for b in self.state["batches"])
        runs, next_id = self.write_runs(latest.newest(mutations), 0, size)
        self.publish(batches=[], runs=[*self.state["runs"], *runs], next_id=next_id)
        if len([r for r in self.state["runs"] if r["level"] == 0]) > self.config.young_tables:
            from keystrata.plans.compaction import compact

            compact(self, 0)

    def write_runs(self, rows: DataFrame, level: int, size: int) -> tuple[list[dict], int]:
        """Sorted, range-partitioned files of about ``table_bytes``; their manifest rows."""
        target = f"{self.path}/runs/{uuid.uuid4().hex}"
        parts = max(1, -(-size // self.config.table_bytes))
        rows.select("seq", "key", "op", "value").repartitionByRange(parts, "key").sortWithinPartitions("key").write.parquet(target)
        files = (
            self.spark.read.parquet(target)
            .groupBy(F.col("_metadata.file_path").alias("path"))
            .agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum(_data_bytes()).alias("n"))
            .orderBy("a")
            .collect()
        )
        at = self.state["next_id"]
        text = lambda b: base64.b64encode(bytes(b)).decode()
        runs = [
            {"id": at + i, "path": f["path"], "min_key": text(f["a"]), "max_key": text(f["b"]), "level": level, "file_size": f["n"]}
            for i, f in enumerate(files)
        ]
        return runs, at + len(runs)

    # -- reads ---------------------------------------------------------------------------------

    def mutations(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All rows that may decide keys from ``low`` to ``high``: files outside are not opened."""
        runs = [
            r["path"]
            for r in self.state["runs"]
            if (high is None or base64.b64decode(r["min_key"]) <= high) and (low is None or base64.b64decode(r["max_key"]) >= low)
        ]
        paths = [b["path"] for b in self.state["batches"]] + runs
        if not paths:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*paths)

    def live(self) -> DataFrame:
        return latest.live(self.mutations())

    def get(self, key: bytes) -> bytes | None:
        """The value of a key; none if it is absent or deleted."""
        self.reads += 1
        rows = latest.get(self.mutations(key, key), key).collect()
        return None if not rows or rows[0]["value"] is None else bytes(rows[0]["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return latest.multi_get(self.mutations(), keys)

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        return latest.scan(self.mutations(low, high), low, high)

    def stats(self) -> str:
        return manifest.stats_text(self.manifest())

    def vacuum(self, seconds: float = 86_400) -> list[str]:
        """Delete data files that neither the newest version nor its log has.

        Files younger than ``seconds`` stay: a writer may be about to publish them, or a reader
        may still have the version before.
        """
        fs, root = self._fs(self.path)
        until = (time.time() - seconds) * 1000
        keep = {r["path"] for r in self.state["runs"]}
        batches = {b["path"].rpartition("/")[2] for b in self.state["batches"]}
        gone = []
        for part in ("runs", "log"):
            folder = self._fs(f"{self.path}/{part}")[1]
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                path = status.getPath()
                listed = list(fs.listStatus(path))
                if any(f.getModificationTime() > until for f in listed):
                    continue
                files = [f.getPath() for f in listed]
                if part == "log":
                    dead = [] if path.getName() in batches else files
                else:
                    names = {k.rpartition("/")[2] for k in keep if f"/{path.getName()}/" in k}
                    dead = [f for f in files if f.getName() not in names and (f.getName().startswith("part-") or not names)]
                for f in dead:
                    if f.getName().startswith("part-"):
                        gone.append(f.toString())
                    fs.delete(f, False)
                if len(dead) == len(files):
                    fs.delete(path, True)
        return gone

    def close(self) -> None:
        """Flush what is in the log; reads work on after that."""
        self.flush()


def _data_bytes():
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 13).cast("long")
