"""Mutations, lookups, manifests and compaction; documented meaning where it is easy to get wrong."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keystrata.config import Config
from keystrata.operators import latest, manifest, ranges
from keystrata.plans import compaction
from keystrata.sources import logfile
from keystrata.sources.store import Conflict, Store

SCHEMA = "seq long, key binary, op string, value binary"


def log(spark, *rows):
    return spark.createDataFrame([(s, bytearray(k), op, None if v is None else bytearray(v)) for s, k, op, v in rows], SCHEMA)


def as_dict(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def keys(spark, *ks):
    return spark.createDataFrame([(bytearray(k),) for k in ks], "key binary")


def test_newest_wins_and_deletions_hide(spark):
    m = log(
        spark,
        (1, b"a", "put", b"1"), (2, b"a", "delete", None), (3, b"b", "put", b"1"), (4, b"b", "put", b"2"),
        (5, b"c", "delete", None), (6, b"c", "put", b"3"), (7, b"d", "delete", None), (8, b"e", "put", b""),
    )
    assert as_dict(latest.live(m)) == {b"b": b"2", b"c": b"3", b"e": b""}
    assert latest.size(m).first().n == 3
    states = {bytes(r.key): r.state for r in latest.multi_get(m, keys(spark, b"a", b"b", b"e", b"zz")).collect()}
    assert states == {b"a": "delete", b"b": "put", b"e": "put", b"zz": "absent"}
    assert latest.get(m, b"zz").count() == 0 and latest.get(m, b"a").first().state == "delete"
    assert {bytes(r.key) for r in latest.with_tombstones(m).where("deleted").collect()} == {b"a", b"d"}
    assert latest.live(m.limit(0)).count() == 0 and latest.size(m.limit(0)).first().n == 0


def test_many_requested_keys_give_the_same(spark):
    m = log(spark, (1, b"a", "put", b"1"), (2, b"b", "delete", None))
    wanted = keys(spark, b"a", b"b", b"c", b"a")
    few, many = (sorted((bytes(r.key), r.state) for r in latest.multi_get(m, wanted, keep=k).collect()) for k in (100, 1))
    assert few == many and len(few) == 4


def test_young_and_level_lookup_need_the_key_itself(spark):
    rows = [
        (1, b"k", "put", b"old", 1, 2), (5, b"a", "put", b"x", 3, 0), (6, b"z", "put", b"x", 3, 0),
        (4, b"k", "put", b"mid", 9, 1), (3, b"q", "put", b"older id", 8, 1), (7, b"q", "put", b"new", 2, 0),
    ]
    runs = spark.createDataFrame([(s, bytearray(k), o, bytearray(v), r, lv) for s, k, o, v, r, lv in rows], SCHEMA + ", run_id long, level int")
    assert {bytes(r.key): bytes(r.value) for r in latest.level_get(runs, keys(spark, b"k", b"q")).collect()} == {b"k": b"mid", b"q": b"new"}
    young = latest.young_get(runs.where("level = 0"), keys(spark, b"k", b"q", b"a")).collect()
    assert {bytes(r.key) for r in young} == {b"q", b"a"}


def test_ranges_small_and_large_agree(spark):
    rng = random.Random(3)
    spans = [(i, *sorted((rng.randrange(500), rng.randrange(500)))) for i in range(40)]
    table = spark.createDataFrame([(i, bytearray(a.to_bytes(2, "big")), bytearray(b.to_bytes(2, "big"))) for i, a, b in spans], "id long, min_key binary, max_key binary")
    points = spark.createDataFrame([(p, bytearray(p.to_bytes(2, "big"))) for p in range(0, 500, 7)], "n int, key binary")
    want = sorted((p, i) for p in range(0, 500, 7) for i, a, b in spans if a <= p <= b)
    pairs = sorted((x, y) for x, a, b in spans for y, c, d in spans if x < y and a <= d and c <= b)
    index = table.select("min_key", F.col("id").alias("offset")).dropDuplicates(["min_key"])
    by_key = {bytes(r.min_key): r.offset for r in index.collect()}
    floor = {p: next((by_key[k] for k in sorted(by_key, reverse=True) if k <= p.to_bytes(2, "big")), None) for p in range(0, 500, 7)}
    for limit in (1000, 3):
        assert sorted((r.n, r.id) for r in ranges.covering(points, table, limit).collect()) == want
        assert sorted((r.id, r.other_id) for r in ranges.overlapping(table, limit=limit).collect()) == pairs
    assert {r.n: r.offset for r in ranges.floor_lookup(points, index).collect()} == floor
    assert {r.offset for r in ranges.floor_lookup(points, index.limit(0)).collect()} == {None}


RUNS = "id long, path string, min_key binary, max_key binary, level int, file_size long"


def run_rows(spark, *rows):
    return spark.createDataFrame([(i, f"p{i}", bytearray(a), bytearray(b), lv, 10) for i, a, b, lv in rows], RUNS)


def test_manifest_replay_and_turns(spark):
    runs = run_rows(spark, (1, b"a", b"c", 0), (2, b"b", b"d", 0), (3, b"e", b"f", 1))
    actions = runs.limit(0).withColumn("action_seq", F.lit(0).cast("long")).withColumn("action", F.lit(""))
    actions = manifest.add(actions, runs)
    actions = manifest.remove(actions, runs.where("id = 2"))
    assert {r.id for r in manifest.replay(actions).collect()} == {1, 3}
    moved = runs.where("id = 2").withColumn("level", F.lit(1))
    actions = manifest.add(actions, moved)
    assert {(r.id, r.level) for r in manifest.replay(actions).collect()} == {(1, 0), (3, 1), (2, 1)}
    live = manifest.replay(actions)
    assert {(r.level, r.tables) for r in manifest.summary(live).collect()} == {(0, 1), (1, 2)}
    assert "level 1: 2 tables" in manifest.stats_text(live)
    level1 = live.where("level = 1")
    assert manifest.next_candidate(level1, None) == (b"b", 2)
    assert manifest.next_candidate(level1, (b"b", 2)) == (b"e", 3)
    assert manifest.next_candidate(level1, (b"e", 3)) == (b"b", 2)
    assert manifest.next_candidate(level1.limit(0), None) is None
    assert [r.id for r in manifest.level(live, 1).collect()] == [2, 3]


def test_counts_to_compact():
    for n, cap, want in ((8, 4, 1), (150, 100, 5), (134, 100, 3), (50, 100, 1)):
        runs = [{"level": 1}] * n
        assert compaction.adaptive(runs, 1, cap) == want
    assert compaction.adaptive([{}] * 7, 0, 4) == 7 and compaction.standard([{}] * 7, 2, 4) == 1


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def batch(spark, *rows):
    return spark.createDataFrame(
        [(i, bytearray(k), op, None if v is None else bytearray(v)) for i, (k, op, v) in enumerate(rows)],
        "o long, key binary, op string, value binary",
    )


def test_store_matches_a_dict_under_random_writes(spark, folder):
    rng = random.Random(5)
    store = Store(spark, folder, Config(table_bytes=400, young_tables=1, level_base=2))
    want: dict[bytes, bytes] = {}
    for turn in range(6):
        rows = []
        for _ in range(60):
            k = rng.randrange(80).to_bytes(2, "big")
            if rng.random() < 0.3:
                rows.append((k, "delete", None))
                want.pop(k, None)
            else:
                v = rng.randbytes(rng.randrange(12))
                rows.append((k, "put", v))
                want[k] = v
        store.write(batch(spark, *rows), order="o")
        if turn % 2:
            store.flush()
        if turn in (2, 5):
            assert as_dict(store.live()) == want
    compaction.compact(store)
    assert as_dict(store.live()) == want
    deeper = [r for r in store.state["runs"] if r["level"] > 0]
    for level in {r["level"] for r in deeper}:
        own = sorted((r for r in deeper if r["level"] == level), key=compaction._key)
        assert all(compaction._end(a) < compaction._key(b)[0] for a, b in zip(own, own[1:], strict=False))
    store.close()
    again = Store(spark, folder, store.config)
    assert as_dict(again.live()) == want and again.state == store.state
    assert again.vacuum() == []  # too young to be taken
    again.vacuum(0)
    assert as_dict(Store(spark, folder).live()) == want
    some = next(iter(want))
    assert again.get(some) == want[some] and again.get(b"nothing") is None
    part = {k: v for k, v in want.items() if b"\x00\x10" <= k <= b"\x00\x30"}
    assert as_dict(again.scan(b"\x00\x10", b"\x00\x30")) == part


def test_delete_after_flush_stays_deleted_and_tombstones_go(spark, folder):
    store = Store(spark, folder, Config(young_tables=10))
    store.put(batch(spark, (b"k", "put", b"1"), (b"m", "put", b"2")).select("key", "value"))
    store.flush()
    store.delete(keys(spark, b"k", b"never"))
    assert store.get(b"k") is None and store.get(b"m") == b"2"
    store.flush()
    assert store.get(b"k") is None
    done = compaction.merge_level(store, 0)
    assert done["merged"] == 2 and store.get(b"k") is None and store.get(b"m") == b"2"
    assert [r.op for r in store.mutations().collect()] == ["put"]
    assert "level 1: 1 tables" in store.stats()


def test_only_the_outer_sources_meet_the_next_level(spark, folder):
    store = Store(spark, folder, Config(young_tables=10))
    for ks in ((b"b", b"c"), (b"m", b"n"), (b"x", b"y")):
        store.put(batch(spark, *((k, "put", k) for k in ks)).select("key", "value"))
        store.flush()
    compaction.merge_level(store, 0)  # nothing meets: all move
    assert {r["level"] for r in store.state["runs"]} == {1}
    for ks in ((b"a", b"c"), (b"g", b"h"), (b"w", b"x")):
        store.put(batch(spark, *((k, "put", b"new") for k in ks)).select("key", "value"))
        store.flush()
    compaction.merge_level(store, 0)
    own = sorted((r for r in store.state["runs"]), key=compaction._key)
    assert all(compaction._end(a) < compaction._key(b)[0] for a, b in zip(own, own[1:], strict=False))
    assert as_dict(store.live())[b"c"] == b"new" and as_dict(store.live())[b"m"] == b"m"


def test_a_second_writer_is_told(spark, folder):
    one, two = Store(spark, folder), Store(spark, folder)
    one.put(batch(spark, (b"k", "put", b"1")).select("key", "value"))
    with pytest.raises(Conflict):
        two.put(batch(spark, (b"k", "put", b"2")).select("key", "value"))
    two.start()
    assert two.get(b"k") == b"1"


def test_empty_store(spark, folder):
    store = Store(spark, folder)
    assert store.get(b"k") is None and store.live().count() == 0 and store.vacuum(0) == []
    store.close()


def test_binary_files_round_trip(spark, folder):
    rows = [(i % 3, i, f"key{i:04d}".encode(), "delete" if i % 7 == 0 else "put", b"" if i % 5 == 0 else b"v" * i * 20) for i in range(200)]
    df = spark.createDataFrame([(f, s, bytearray(k), op, bytearray(v)) for f, s, k, op, v in rows], "file int, seq long, key binary, op string, value binary")
    made = logfile.write_logs(df, f"{folder}/wal").collect()
    assert sorted(r["name"] for r in made) == ["wal_0", "wal_1", "wal_2"]
    back = logfile.read_logs(spark, f"{folder}/wal")
    assert logfile.intact_share(back).first().asDict() == {"entries": 200, "intact": 200}
    got = {bytes(r.key): (r.op, None if r.value is None else bytes(r.value)) for r in back.collect()}
    assert got == {k: (op, None if op == "delete" else v) for _, _, k, op, v in rows}
    logfile.write_tables(df, f"{folder}/tables").collect()
    assert logfile.read_tables(spark, f"{folder}/tables").count() == 200
    index = logfile.read_index(spark, f"{folder}/tables")
    assert index.groupBy("path").agg(F.min("offset").alias("o")).where("o = 0").count() == 3


def test_stream_into_store(spark, folder, tmp_path):
    from keystrata.streaming.ingest import ingest

    batch(spark, (b"a", "put", b"1"), (b"b", "put", b"2"), (b"a", "delete", None)).coalesce(1).write.parquet(f"{tmp_path}/in")
    store = Store(spark, folder)
    stream = spark.readStream.schema("o long, key binary, op string, value binary").parquet(f"{tmp_path}/in")
    ingest(stream, store, f"{tmp_path}/ck", order="o").awaitTermination()
    assert as_dict(store.live()) == {b"b": b"2"}


def test_positions_number_rows_that_carry_columns(spark):
    n = 1_200_000
    rows = spark.range(n, numPartitions=6).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), "id").alias("v"))
    numbered = latest.positions(rows, "k")
    before = F.lag("k").over(Window.orderBy("position"))
    found = numbered.withColumn("before", before).agg(
        F.countDistinct("position").alias("n"), F.min("position").alias("a"), F.max("position").alias("b"), F.sum((F.col("before") > F.col("k")).cast("int")).alias("odd")
    ).first()
    assert (found.n, found.a, found.b, found.odd) == (n, 1, n, 0)
    assert latest.positions(rows.limit(0), "k").count() == 0


def test_ordered_writes_get_distinct_seq(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Config(log_bytes=1 << 40))
    n = 200_000
    rows = spark.range(n, numPartitions=5).select(
        F.encode(F.concat(F.lit("key"), F.col("id") % 1000), "UTF-8").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"), "id"
    )
    store.put(rows, order="id")
    store.put(rows.limit(10))
    seq = store.mutations().agg(F.countDistinct("seq").alias("n"), F.max("seq").alias("top")).first()
    assert (seq.n, seq.top) == (n + 10, n + 9)
    store.put(rows, order="id")
    assert all(int(v) >= n - 1000 for v in (bytes(r.value) for r in store.live().collect()))


def test_cache_evicts_the_least_recently_used(spark):
    rng = random.Random(4)
    rows = [(r, rng.randrange(12), i) for i, r in enumerate(rng.randrange(3) for _ in range(400))]
    want = {}
    for reader in range(3):
        cached, misses = [], 0
        for _, t, _ in [x for x in rows if x[0] == reader]:
            misses += t not in cached
            cached = [x for x in cached if x != t][-4:] + [t]
        want[reader] = (sum(x[0] == reader for x in rows), misses)
    df = spark.createDataFrame(rows, "reader int, table int, seq int")
    assert {r.reader: (r.operations, r.misses) for r in latest.lru_hits(df, 5).collect()} == want
