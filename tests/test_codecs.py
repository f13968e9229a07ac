"""Byte codecs, ordering of keys, checksums and record layout."""

import random
import struct

from pyspark.sql import functions as F

from keystrata.config import BLOCK, HEADER
from keystrata.functions import codecs, layout
from keystrata.operators import latest
from keystrata.sources import logfile

NUMBERS = [0, 1, -1, 1234, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63)]


def test_long_and_int_round_trip(spark):
    longs = spark.createDataFrame([(n,) for n in NUMBERS], "n long")
    for encode, decode, kind in ((codecs.long_be, codecs.from_long_be, ">q"), (codecs.long_le, codecs.from_long_le, "<q")):
        rows = longs.select("n", encode("n").alias("b")).select("n", "b", decode("b").alias("back")).collect()
        assert all(bytes(r.b) == struct.pack(kind, r.n) and r.back == r.n for r in rows)
    ints = spark.createDataFrame([(n,) for n in NUMBERS[:6]], "n int")
    for encode, decode, kind in ((codecs.int_be, codecs.from_int_be, ">i"), (codecs.int_le, codecs.from_int_le, "<i")):
        rows = ints.select("n", encode("n").alias("b")).select("n", "b", decode("b").alias("back")).collect()
        assert all(bytes(r.b) == struct.pack(kind, r.n) and r.back == r.n for r in rows)


def test_floats_round_trip_and_null(spark):
    df = spark.createDataFrame([(1.234,), (-0.5,), (None,)], "d double")
    rows = df.select("d", codecs.double_bytes("d").alias("b"), codecs.from_double_bytes(codecs.double_bytes("d")).alias("x")).collect()
    assert [None if r.b is None else bytes(r.b) for r in rows] == [struct.pack("<d", 1.234), struct.pack("<d", -0.5), None]
    assert [r.x for r in rows] == [1.234, -0.5, None]
    f = df.select(codecs.from_float_bytes(codecs.float_bytes(F.col("d").cast("float"), big=True), big=True).alias("x")).collect()
    assert abs(f[0].x - 1.234) < 1e-6 and f[2].x is None


def test_keys_compare_without_sign(spark):
    keys = [b"", b"a", b"aa", b"aaaa", b"b", b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]
    df = spark.createDataFrame([(bytearray(k),) for k in reversed(keys)], "key binary")
    assert [bytes(r.key) for r in df.orderBy("key").collect()] == sorted(keys)
    placed = latest.positions(df, "key").orderBy("position").collect()
    assert [bytes(r.key) for r in placed] == sorted(keys) and [r.position for r in placed] == list(range(1, 10))
    wrapped = spark.createDataFrame([(2**31 - 1,), (-(2**31),)], "n int").select("n", codecs.int_be("n").alias("key"))
    assert [r.n for r in wrapped.orderBy("key").collect()] == [2**31 - 1, -(2**31)]


def test_bytes_of_a_key(spark):
    row = spark.createDataFrame([(bytearray(b"\x00\xffa"),)], "k binary").select(
        codecs.unsigned("k").alias("u"), codecs.size("k").alias("n"), codecs.read_bytes("k", 1, 2).alias("r")
    ).first()
    assert row.u == [0, 255, 97] and row.n == 3 and bytes(row.r) == b"\xffa"
    assert spark.createDataFrame([(bytearray(b""),)], "k binary").select(codecs.unsigned("k").alias("u")).first().u == []


def test_crc32c(spark):
    assert codecs.crc32c_of(b"123456789") == 0xE3069283
    rng = random.Random(0)
    values = [b"", b"123456789", *(rng.randbytes(rng.randrange(200)) for _ in range(50))]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)] + [(99, None)], "i int, v binary")
    got = {r.i: r.c for r in df.select("i", codecs.crc32c("v").alias("c")).collect()}
    assert got == {i: codecs.crc32c_of(v) for i, v in enumerate(values)} | {99: None}


def _simulated(position, data):
    """Fragments written one by one."""
    if BLOCK - position % BLOCK < HEADER:
        position += BLOCK - position % BLOCK
    start, n = position, 0
    while True:
        if BLOCK - position % BLOCK < HEADER:
            position += BLOCK - position % BLOCK
        take = min(data, BLOCK - position % BLOCK - HEADER)
        position, data, n = position + HEADER + take, data - take, n + 1
        if data == 0:
            return start, n, position


def test_layout_closed_form(spark):
    rng = random.Random(1)
    rows, want, position = [], [], 0
    for i in range(400):
        data = rng.choice([5, 100, 3000, BLOCK - 20 + rng.randrange(21), 3 * BLOCK + 25, rng.randrange(4, 90_000)])
        assert layout.place(position, data) == _simulated(position, data)
        want.append((i, *layout.place(position, data)))
        position = want[-1][3]
        rows.append((7, i, data))
    df = spark.createDataFrame(rows, "file int, seq long, bytes long")
    got = [(r.seq, r.start, r.fragments, r.end) for r in layout.log_layout(df).orderBy("seq").collect()]
    assert got == want


def test_split_restarts_its_sum(spark):
    df = spark.createDataFrame([(1, i, 40) for i in range(10)] + [(2, 0, 500)], "g int, seq long, bytes long")
    parts = {(r.g, r.seq): r.part for r in layout.split_by_bytes(df, "g", "seq", "bytes", 100).collect()}
    assert [parts[1, i] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3] and parts[2, 0] == 0


def test_files_hold_what_was_written():
    rng = random.Random(2)
    sizes = [0, 1, 100, 3 * BLOCK + 25, 2 * BLOCK + 1, *range(BLOCK - 20, BLOCK + 1)]
    entries = [(f"key{i:03d}".encode(), None if i % 5 == 4 else rng.randbytes(n)) for i, n in enumerate(sizes)]
    content, starts = logfile.frame([logfile.encode_entry(k, v) for k, v in entries])
    found = list(logfile.records(content))
    assert [logfile.decode_entry(e) for _, e, _ in found] == entries
    assert [at for at, _, _ in found] == starts and all(ok for _, _, ok in found)
    position = 0
    for (k, v), start in zip(entries, starts, strict=True):
        assert layout.place(position, 4 + len(k) + len(v or b""))[0] == start
        position = layout.place(position, 4 + len(k) + len(v or b""))[2]
    assert position == len(content)
    broken = bytearray(content)
    broken[starts[2] + 20] ^= 1
    assert [ok for _, _, ok in logfile.records(bytes(broken))].count(False) == 1
    assert len(list(logfile.records(content[: starts[3] + 50]))) == 3  # a file cut short ends the scan
    table = logfile.table_file(entries)
    limit, index = logfile.table_index(table)
    assert limit == len(content) and [o for o, _ in index] == sorted({s // BLOCK * BLOCK for s in starts})
    assert index[0][1] == b"key000"
