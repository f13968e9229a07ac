"""Where records lie in block-framed files.

A file is a sequence of 32 KiB blocks.  A record is one fragment if it fits into what is left of
the block after a 9-byte header, else it fills blocks with first, middle and last fragments.
Less than a header's room at a block's end stays zero.  For one record this has a closed form in
the file position, so the only state of a file's fold is that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.config import BLOCK, HEADER

#: Fragment types of the format (fixed values).
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


def record_bytes(key: str = "key", value: str = "value") -> Column:
    """Bytes of an encoded entry: key length, key and value (none for a deletion)."""
    return F.lit(4) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def place(position: int, data: int) -> tuple[int, int, int]:
    """``(start, fragments, end)`` of a record of ``data`` bytes at a file position."""
    room = BLOCK - position % BLOCK
    if room < HEADER:
        position, room = position + room, BLOCK
    if data <= room - HEADER:
        return position, 1, position + HEADER + data
    rest = data - (room - HEADER)
    more = -(-rest // (BLOCK - HEADER))
    return position, 1 + more, position + room + rest + HEADER * more


def log_layout(records: DataFrame, file: str = "file", order: str = "seq", data: str = "bytes") -> DataFrame:
    """``file, order, start, fragments, end`` of every record, by a fold over each file.

    A file is bounded by the rotation limit, so its records fit into one task.
    """
    import pyarrow as pa

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        at, placed = 0, []
        for n in table[data].to_pylist():
            start, fragments, at = place(at, n)
            placed.append((start, fragments, at))
        columns = [pa.array(c, pa.int64()) for c in zip(*placed, strict=True)]
        return pa.table({file: table[file], order: table[order], "start": columns[0], "fragments": columns[1], "end": columns[2]})

    rows = records.select(file, F.col(order).cast("long").alias(order), F.col(data).cast("long").alias(data))
    kind = rows.schema[file].dataType.simpleString()
    return rows.groupBy(file).applyInArrow(fold, f"`{file}` {kind}, `{order}` long, start long, fragments long, `end` long")


def split_by_bytes(rows: DataFrame, group: str, order: str, data: str, limit: int, at_least: bool = True) -> DataFrame:
    """``rows`` with ``part``: a new part begins after the bytes of one reach (or pass) ``limit``.

    The sum starts anew with each part, which no window frame expresses; each group is folded
    in Arrow batches, in order, with the running sum as the only state.
    """
    import pyarrow as pa

    schema = rows.schema
    names = rows.columns

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        part, total, out = 0, 0, []
        for n in table[data].to_pylist():
            out.append(part)
            total += n
            if total >= limit if at_least else total > limit:
                part, total = part + 1, 0
        return table.select(names).append_column("part", pa.array(out, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.groupBy(group).applyInArrow(fold, f"{fields}, part long")
