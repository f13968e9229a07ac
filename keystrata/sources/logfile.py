"""Block-framed binary files: logs in write order and sorted tables with a block index.

A file is an independent, bounded unit (rotation and table limits), so files are parsed and made
whole in a task each.  Reading goes through Spark's ``binaryFile`` source and so reaches every
store that Spark reaches.

Formats (all integers little-endian int32)::

    fragment  = crc32c(type, data)  length  type(1 byte)  data
    entry     = key length (top bit: deletion)  key  value
    table     = fragments of sorted entries, then the index, then the length of the first part
    index     = (block offset, key length, first key that begins in the block)*
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.config import BLOCK, HEADER
from keystrata.functions.codecs import crc32c_of
from keystrata.functions.layout import FIRST, FULL, LAST, MIDDLE

_TOP = 1 << 31
SCHEMA = "path string, position long, `offset` long, key binary, op string, value binary, intact boolean"


def encode_entry(key: bytes, value: bytes | None) -> bytes:
    """An entry's bytes; no value makes a deletion, an empty one does not."""
    size = len(key) | (_TOP if value is None else 0)
    return size.to_bytes(4, "little") + key + (value or b"")


def decode_entry(data: bytes) -> tuple[bytes, bytes | None]:
    size = int.from_bytes(data[:4], "little")
    end = 4 + (size & ~_TOP)
    return data[4:end], None if size & _TOP else data[end:]


def frame(entries: list[bytes]) -> tuple[bytes, list[int]]:
    """A file of framed entries, and where each record begins."""
    out, starts = bytearray(), []
    for data in entries:
        room = BLOCK - len(out) % BLOCK
        if room < HEADER:
            out += bytes(room)
        starts.append(len(out))
        first = min(len(data), BLOCK - len(out) % BLOCK - HEADER)
        whole = BLOCK - HEADER
        parts = [data[:first], *(data[i : i + whole] for i in range(first, len(data), whole))]
        for i, part in enumerate(parts):
            kind = FULL if len(parts) == 1 else FIRST if i == 0 else LAST if i == len(parts) - 1 else MIDDLE
            crc = crc32c_of(bytes([kind]) + part)
            out += crc.to_bytes(4, "little") + len(part).to_bytes(4, "little") + bytes([kind]) + part
    return bytes(out), starts


def records(content: bytes, limit: int | None = None) -> Iterator[tuple[int, bytes, bool]]:
    """``(offset, entry, whether all checksums agree)`` of every record.

    A file that ends within a record, or has none of the known types, ends the scan there.
    """
    end = len(content) if limit is None else limit
    at, begin, held, intact = 0, 0, b"", True
    while True:
        room = BLOCK - at % BLOCK
        if room < HEADER:
            at += room
        if at + HEADER > end:
            return
        crc = int.from_bytes(content[at : at + 4], "little")
        size = int.from_bytes(content[at + 4 : at + 8], "little")
        kind = content[at + 8]
        data = content[at + HEADER : at + HEADER + size]
        if kind not in (FULL, FIRST, MIDDLE, LAST) or len(data) < size:
            return
        if kind in (FULL, FIRST):
            begin, held, intact = at, b"", True
        held += data
        intact = intact and crc32c_of(bytes([kind]) + data) == crc
        at += HEADER + size
        if kind in (FULL, LAST):
            yield begin, held, intact


def table_file(entries: list[tuple[bytes, bytes | None]]) -> bytes:
    """A sorted table: framed entries, block index and footer."""
    data, starts = frame([encode_entry(k, v) for k, v in entries])
    index, last = bytearray(), -1
    for (key, _), start in zip(entries, starts, strict=True):
        if start // BLOCK != last:
            last = start // BLOCK
            index += (last * BLOCK).to_bytes(4, "little") + len(key).to_bytes(4, "little") + key
    return data + bytes(index) + len(data).to_bytes(4, "little")


def table_index(content: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    """Bytes of data, and ``(block offset, first key)`` of every block."""
    limit = int.from_bytes(content[-4:], "little")
    at, out = limit, []
    while at < len(content) - 4:
        size = int.from_bytes(content[at + 4 : at + 8], "little")
        out.append((int.from_bytes(content[at : at + 4], "little"), content[at + 8 : at + 8 + size]))
        at += 8 + size
    return limit, out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parse(tables: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                limit = int.from_bytes(content[-4:], "little") if tables else None
                rows = [(i, at, *decode_entry(e), ok) for i, (at, e, ok) in enumerate(records(content, limit))]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(rows), pa.string()),
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.binary()),
                        pa.array(["delete" if v is None else "put" for v in columns[3]], pa.string()),
                        pa.array(columns[3], pa.binary()),
                        pa.array(columns[4], pa.bool_()),
                    ],
                    names=["path", "position", "offset", "key", "op", "value", "intact"],
                )

    return run


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the log files below ``path``: ``path, position, offset, key, op, value, intact``."""
    return _files(spark, path).mapInArrow(_parse(False), SCHEMA)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the table files below ``path``, as :func:`read_logs`."""
    return _files(spark, path).mapInArrow(_parse(True), SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``path, offset, min_key`` of every block of the table files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = table_index(content)[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found)), pa.array([o for o, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary())],
                    names=["path", "offset", "min_key"],
                )

    return _files(spark, path).mapInArrow(run, "path string, `offset` long, min_key binary")


def write_files(df: DataFrame, folder: str, file: str, order: str, tables: bool) -> DataFrame:
    """Write the rows of each value of ``file`` as one binary file; returns what was written.

    ``folder`` is a URI of a store that the executors reach.  A file is written under another
    name and then moved, so a repeated task replaces it whole.  ``name, n, bytes, min_key,
    max_key`` describe the files.
    """

    def write(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        table = table.sort_by(order)
        entries = [
            (k, v if op == "put" else None)
            for k, op, v in zip(table["key"].to_pylist(), table["op"].to_pylist(), table["value"].to_pylist(), strict=True)
        ]
        content = table_file(entries) if tables else frame([encode_entry(k, v) for k, v in entries])[0]
        name = f"{'sstable' if tables else 'wal'}_{table[file][0].as_py()}"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        draft = f"{base}/.{name}-{zlib.crc32(content)}"
        with store.open_output_stream(draft) as out:
            out.write(content)
        store.move(draft, f"{base}/{name}")
        keys = [k for k, _ in entries]
        return pa.table(
            {
                "name": [name],
                "n": pa.array([len(keys)], pa.int64()),
                "bytes": pa.array([len(content)], pa.int64()),
                "min_key": pa.array([min(keys)], pa.binary()),
                "max_key": pa.array([max(keys)], pa.binary()),
            }
        )

    columns = [file, order, "key", "op", "value"]
    return df.select(*dict.fromkeys(columns)).groupBy(file).applyInArrow(
        write, "name string, n long, bytes long, min_key binary, max_key binary"
    )


def write_logs(df: DataFrame, folder: str, file: str = "file", order: str = "seq") -> DataFrame:
    return write_files(df, folder, file, order, tables=False)


def write_tables(df: DataFrame, folder: str, file: str = "file", order: str = "key") -> DataFrame:
    return write_files(df, folder, file, order, tables=True)


def intact_share(entries: DataFrame) -> DataFrame:
    """One row ``entries, intact``: how many records have the checksums that they were written with."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("intact"), 1)).alias("intact"))
