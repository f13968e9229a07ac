"""Byte codecs as column expressions.

Integers are coded by hexadecimal text, which stays inside generated code; only floating point
bit patterns and CRC-32C need Arrow functions.  Binary columns already compare byte by byte
without sign, so a big-endian coded key sorts like the numbers (negative ones last).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _hex(c: Column, digits: int) -> Column:
    return F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(digits))


def _swap(h: Column, digits: int) -> Column:
    """Hexadecimal text with its bytes in reverse order."""
    return F.concat(*(F.substring(h, at, 2) for at in range(digits - 1, 0, -2)))


def long_be(c: Column | str) -> Column:
    return F.unhex(_hex(_col(c), 16))


def long_le(c: Column | str) -> Column:
    return F.unhex(_swap(_hex(_col(c), 16), 16))


def int_be(c: Column | str) -> Column:
    return F.unhex(_hex(_col(c), 8))


def int_le(c: Column | str) -> Column:
    return F.unhex(_swap(_hex(_col(c), 8), 8))


def from_long_be(c: Column | str) -> Column:
    return F.conv(F.hex(_col(c)), 16, -10).cast("long")


def from_long_le(c: Column | str) -> Column:
    return F.conv(_swap(F.hex(_col(c)), 16), 16, -10).cast("long")


def _int(h: Column) -> Column:
    n = F.conv(h, 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def from_int_be(c: Column | str) -> Column:
    return _int(F.hex(_col(c)))


def from_int_le(c: Column | str) -> Column:
    return _int(_swap(F.hex(_col(c)), 8))


def from_text(c: Column | str) -> Column:
    return F.encode(_col(c), "UTF-8")


def to_text(c: Column | str) -> Column:
    return F.decode(_col(c), "UTF-8")


def size(c: Column | str) -> Column:
    return F.octet_length(_col(c))


def read_bytes(c: Column | str, at: int, n: int) -> Column:
    """``n`` bytes from offset ``at`` (0 is the first)."""
    return F.substring(_col(c), at + 1, n)


def unsigned(c: Column | str) -> Column:
    """The bytes as an array of numbers from 0 to 255."""
    h = F.hex(_col(c))
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.conv(h.substr(i, F.lit(2)), 16, 10).cast("int")
    )
    return F.when(F.length(h) == 0, F.array().cast("array<int>")).otherwise(pairs)


def key_hash(c: Column | str) -> Column:
    return F.xxhash64(_col(c))


def key_sequence(spark: SparkSession, n: int) -> DataFrame:
    """``key``: n big-endian keys from 0 up."""
    return spark.range(n).select(long_be("id").alias("key"))


def _pack(kind: str, spark_type: str):
    import struct

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v and v is pd.NA else struct.pack(kind, v), na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return pandas_udf(run, spark_type)


def _unpack(kind: str, spark_type: str):
    import struct

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else struct.unpack(kind, v)[0], na_action="ignore")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return pandas_udf(run, spark_type)


def float_bytes(c: Column | str, big: bool = False) -> Column:
    return _pack(">f" if big else "<f", "binary")(_col(c))


def double_bytes(c: Column | str, big: bool = False) -> Column:
    return _pack(">d" if big else "<d", "binary")(_col(c))


def from_float_bytes(c: Column | str, big: bool = False) -> Column:
    return _unpack(">f" if big else "<f", "float")(_col(c))


def from_double_bytes(c: Column | str, big: bool = False) -> Column:
    return _unpack(">d" if big else "<d", "double")(_col(c))


def _crc_table() -> list[int]:
    """CRC-32C remainders of all bytes, from the reflected Castagnoli polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0x82F63B78 if b & 1 else 0)
        out.append(b)
    return out


_CRC = _crc_table()


def crc32c_of(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ _CRC[(crc ^ byte) & 255]
    return crc ^ 0xFFFFFFFF


def crc32c(c: Column | str) -> Column:
    """CRC-32C as an unsigned number; many values advance together, one byte position at a time."""
    import numpy as np

    def run(values: pd.Series) -> pd.Series:
        table = np.array(_CRC, np.uint32)
        given = values.notna().to_numpy()
        data = [bytes(v) for v in values[given]]
        order = sorted(range(len(data)), key=lambda i: -len(data[i]))
        sizes = np.array([len(data[i]) for i in order])
        crc = np.full(len(data), 0xFFFFFFFF, np.uint32)
        flat = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1] if len(sizes) else sizes
        for at in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -at, side="left"))  # values longer than this position
            crc[:n] = crc[:n] >> np.uint32(8) ^ table[(crc[:n] ^ flat[begin[:n] + at]) & np.uint32(255)]
        out = np.zeros(len(data), np.int64)
        out[order] = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
        result = pd.Series([None] * len(values), dtype="Int64")
        result[given] = out
        return result

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return pandas_udf(run, "long")(_col(c))
