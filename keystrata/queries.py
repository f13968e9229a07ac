"""Registered queries over the driver's tables, each with the same question in SQL.

``events`` is the mutation log: ``event_id`` orders writes, ``user_id`` (big-endian) is the key,
events of type ``error`` delete, all others put their ``props``.  Runs are cut from it by
``event_id``; binary results are shown as hexadecimal text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata import shared
from keystrata.config import BLOCK, Config
from keystrata.functions import codecs, layout
from keystrata.operators import latest, manifest, ranges

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.col("event_type") == "error"
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        codecs.long_be("user_id").alias("key"),
        F.when(deleted, latest.DELETE).otherwise(latest.PUT).alias("op"),
        F.when(~deleted, codecs.from_text("props")).alias("value"),
    )


#: Rows of events per run.
RUN_ROWS = 1000


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations with ``run_id`` and a ``level``: the newest runs in level 0, older ones deeper."""
    m = mutations(spark, sf_dir).withColumn("run_id", F.floor(F.col("seq") / RUN_ROWS).cast("long"))
    return m.withColumn("level", F.pmod(-F.col("run_id"), F.lit(3)).cast("int"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with narrow key ranges: orders in ranges of keys, sized from 150 to 600 keys."""
    o = _table(spark, sf_dir, "orders")
    return (
        o.groupBy(F.floor(F.col("o_orderkey") / 400).cast("long").alias("id"))
        .agg(F.min("o_orderkey").alias("a"), (F.max("o_orderkey") + F.max(F.col("o_custkey") % 600)).alias("b"), F.count(F.lit(1)).alias("file_size"))
        .select(
            "id",
            F.concat(F.lit("sstable_"), "id").alias("path"),
            codecs.long_be("a").alias("min_key"),
            codecs.long_be("b").alias("max_key"),
            F.pmod("id", F.lit(3)).cast("int").alias("level"),
            "file_size",
        )
    )


_M = """m AS (SELECT event_id AS seq, lpad(hex(user_id), 16, '0') AS k, user_id,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v,
  event_type = 'error' AS gone, event_id // 1000 AS run_id, (3 - (event_id // 1000) % 3) % 3 AS level FROM events)"""
_N = f"WITH {_M}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM m) WHERE rn = 1)"
_R = """r AS (SELECT o_orderkey // 400 AS id, min(o_orderkey) AS a, max(o_orderkey) + max(o_custkey % 600) AS b,
  count(*) AS file_size, (o_orderkey // 400) % 3 AS level FROM orders GROUP BY ALL)"""


def _show(df: DataFrame) -> DataFrame:
    """Keys as hexadecimal text and values as text."""
    out = df.withColumn("k", F.hex("key"))
    return out.withColumn("v", codecs.to_text("value")) if "value" in df.columns else out


@_query(f"{_N} SELECT k, v FROM n WHERE NOT gone")
def latest_live(spark, sf_dir):
    return _show(latest.live(mutations(spark, sf_dir))).select("k", "v")


@_query(f"{_N} SELECT k, v, seq, gone AS deleted FROM n")
def latest_with_tombstones(spark, sf_dir):
    return _show(latest.with_tombstones(mutations(spark, sf_dir))).select("k", "v", "seq", "deleted")


@_query(f"{_N} SELECT k, v, CASE WHEN gone THEN 'delete' ELSE 'put' END AS state FROM n WHERE k = lpad(hex(7), 16, '0')")
def point_get(spark, sf_dir):
    return _show(latest.get(mutations(spark, sf_dir), codecs.long_be(F.lit(7)))).select("k", "v", "state")


@_query(
    f"{_N} SELECT lpad(hex(c_custkey), 16, '0') AS k, v,"
    " CASE WHEN n.k IS NULL THEN 'absent' WHEN gone THEN 'delete' ELSE 'put' END AS state"
    " FROM customer LEFT JOIN n ON n.k = lpad(hex(c_custkey), 16, '0')"
)
def multi_get(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(codecs.long_be("c_custkey").alias("key"))
    return _show(latest.multi_get(mutations(spark, sf_dir), keys)).select("k", "v", "state")


@_query(f"{_N} SELECT count(*) FILTER (WHERE NOT gone) AS n FROM n")
def memtable_size(spark, sf_dir):
    return latest.size(mutations(spark, sf_dir))


@_query(f"{_N} SELECT k, v, row_number() OVER (ORDER BY k) AS position FROM n WHERE NOT gone")
def sorted_scan(spark, sf_dir):
    return _show(latest.positions(latest.live(mutations(spark, sf_dir)), "key")).select("k", "v", "position")


@_query(f"{_N} SELECT k, v FROM n WHERE NOT gone AND user_id BETWEEN 20 AND 60")
def range_scan(spark, sf_dir):
    low, high = ((n).to_bytes(8, "big") for n in (20, 60))
    return _show(latest.scan(mutations(spark, sf_dir), low, high)).select("k", "v")


@_query(f"WITH {_M} SELECT CASE WHEN gone THEN 'delete' ELSE 'put' END AS op, count(*) AS n FROM m GROUP BY 1")
def operation_counters(spark, sf_dir):
    return latest.counters(mutations(spark, sf_dir))


@_query(
    "SELECT p_partkey, row_number() OVER (ORDER BY b, p_partkey) AS position FROM"
    " (SELECT p_partkey, encode(CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN chr(233) || p_brand"
    " WHEN p_partkey % 5 = 2 THEN p_brand ELSE p_brand || p_size END) AS b FROM part)"
)
def unsigned_order(spark, sf_dir):
    mod = F.col("p_partkey") % 5
    text = (
        F.when(mod == 0, "").when(mod == 1, F.concat(F.lit("é"), "p_brand")).when(mod == 2, F.col("p_brand"))
        .otherwise(F.concat("p_brand", F.col("p_size").cast("string")))
    )
    keyed = _table(spark, sf_dir, "part").select("p_partkey", codecs.from_text(text).alias("key"))
    return latest.positions(keyed, "key", "p_partkey").select("p_partkey", "position")


@_query(
    "WITH x AS (SELECT l_orderkey AS n, l_orderkey - 3000 AS s, l_linenumber - 4 AS i FROM lineitem),"
    " h AS (SELECT *, right(lpad(hex(s), 16, '0'), 16) AS be, right(lpad(hex(i::BIGINT), 16, '0'), 8) AS ib FROM x)"
    " SELECT n, i, be AS long_be, substr(be,15,2)||substr(be,13,2)||substr(be,11,2)||substr(be,9,2)||substr(be,7,2)||substr(be,5,2)||substr(be,3,2)||substr(be,1,2) AS long_le,"
    " ib AS int_be, substr(ib,7,2)||substr(ib,5,2)||substr(ib,3,2)||substr(ib,1,2) AS int_le, s AS back_long, i AS back_int, 8 AS bytes FROM h"
)
def codec_integers(spark, sf_dir):
    x = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("n"), (F.col("l_orderkey") - 3000).alias("s"), (F.col("l_linenumber") - 4).cast("int").alias("i")
    )
    coded = x.select(
        "n",
        "i",
        codecs.long_be("s").alias("lb"),
        codecs.long_le("s").alias("ll"),
        codecs.int_be("i").alias("ib"),
        codecs.int_le("i").alias("il"),
    )
    same = lambda a, b: F.when(a == b, a)  # noqa: E731  both ways back agree
    return coded.select(
        "n",
        "i",
        F.hex("lb").alias("long_be"),
        F.hex("ll").alias("long_le"),
        F.hex("ib").alias("int_be"),
        F.hex("il").alias("int_le"),
        same(codecs.from_long_be("lb"), codecs.from_long_le("ll")).alias("back_long"),
        same(codecs.from_int_be("ib"), codecs.from_int_le("il")).alias("back_int"),
        codecs.size("lb").alias("bytes"),
    )


@_query("SELECT o_orderkey, o_totalprice AS price, o_totalprice::FLOAT::DOUBLE AS narrow, 8 AS double_size, 4 AS float_size FROM orders")
def codec_floats(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    coded = o.select("o_orderkey", codecs.double_bytes("o_totalprice").alias("d"), codecs.float_bytes(F.col("o_totalprice").cast("float"), big=True).alias("f"))
    return coded.select(
        "o_orderkey",
        codecs.from_double_bytes("d").alias("price"),
        codecs.from_float_bytes("f", big=True).cast("double").alias("narrow"),
        codecs.size("d").alias("double_size"),
        codecs.size("f").alias("float_size"),
    )


@_query("SELECT name, length(name) AS n, bytes FROM (SELECT s_name AS name, array_to_string([ord(c) FOR c IN string_split(s_name, '')], ' ') AS bytes FROM supplier)")
def key_bytes(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), codecs.from_text("s_name").alias("key"))
    return s.select(codecs.to_text("key").alias("name"), codecs.size("key").cast("long").alias("n"), F.array_join(codecs.unsigned("key").cast("array<string>"), " ").alias("bytes"))


@_query(
    f"WITH {_M} SELECT run_id, count(*) AS entries, count(DISTINCT k) AS keys, min(k) AS min_key, max(k) AS max_key,"
    " sum(13 + 8 + coalesce(octet_length(encode(v)), 0))::BIGINT AS bytes FROM m GROUP BY run_id"
)
def flush_runs(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.countDistinct("key").alias("keys"),
        F.hex(F.min("key")).alias("min_key"),
        F.hex(F.max("key")).alias("max_key"),
        F.sum(layout.record_bytes() + 9).alias("bytes"),
    )


@_query(f"WITH {_R} SELECT c_custkey AS n, id, level FROM customer JOIN r ON c_custkey BETWEEN a AND b")
def runs_containing_key(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), codecs.long_be("c_custkey").alias("key"))
    return ranges.covering(keys, order_runs(spark, sf_dir)).select("n", "id", "level")


@_query(f"WITH {_R} SELECT x.id, y.id AS other_id FROM r x JOIN r y ON x.a <= y.b AND y.a <= x.b AND x.id < y.id")
def run_overlaps(spark, sf_dir):
    return ranges.overlapping(order_runs(spark, sf_dir))


@_query(
    f"WITH {_M} SELECT k, v, run_id, gone AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run_id DESC, seq DESC) AS rn"
    " FROM m WHERE level = 0) WHERE rn = 1"
)
def young_get(spark, sf_dir):
    keys = _table(spark, sf_dir, "events").select(codecs.long_be("user_id").alias("key"))
    found = latest.young_get(runs(spark, sf_dir).where("level = 0"), keys)
    return _show(found).select("k", "v", "run_id", (F.col("op") == latest.DELETE).alias("deleted"))


@_query(
    f"WITH {_M} SELECT k, v, level::INT AS level, gone AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, seq DESC) AS rn FROM m) WHERE rn = 1"
)
def level_get(spark, sf_dir):
    keys = _table(spark, sf_dir, "events").select(codecs.long_be("user_id").alias("key"))
    return _show(latest.level_get(runs(spark, sf_dir), keys)).select("k", "v", "level", (F.col("op") == latest.DELETE).alias("deleted"))


@_query(f"{_N} SELECT k, v, run_id, gone AS deleted FROM n")
def kway_merge(spark, sf_dir):
    return _show(latest.merge(runs(spark, sf_dir))).select("k", "v", "run_id", (F.col("op") == latest.DELETE).alias("deleted"))


@_query(f"{_N} SELECT k, v FROM n WHERE NOT gone")
def merge_drops_tombstones(spark, sf_dir):
    return _show(latest.merge_final(runs(spark, sf_dir))).select("k", "v")


def _sorted_layout(spark, sf_dir, keys=4000):
    """Orders as sorted tables of so many keys with the place of every record."""
    o = _table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / keys).cast("long").alias("run_id"),
        F.col("o_orderkey").alias("seq"),
        (F.lit(4 + 8) + F.octet_length(codecs.from_text("o_orderpriority"))).alias("bytes"),
    )
    return layout.log_layout(o, "run_id").withColumn("key", codecs.long_be("seq"))


def _layout_sql(rows: str) -> str:
    """``w (file, rn, seq, start, fragments, e)``: the place of every row of ``rows (file, seq, d)``, record by record."""
    return (
        f"WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS rn FROM ({rows})),"
        " w AS (SELECT DISTINCT file, 0::BIGINT AS rn, NULL::BIGINT AS seq, 0::BIGINT AS start, 0::BIGINT AS fragments, 0::BIGINT AS e FROM r"
        " UNION ALL SELECT file, rn, seq, start, CASE WHEN d <= room - 9 THEN 1 ELSE 1 + (d - room + 9 + 32758) // 32759 END,"
        " CASE WHEN d <= room - 9 THEN start + 9 + d ELSE start + room + (d - room + 9) + 9 * ((d - room + 9 + 32758) // 32759) END"
        " FROM (SELECT *, 32768 - start % 32768 AS room FROM (SELECT r.file, r.rn, r.seq, r.d,"
        " CASE WHEN 32768 - w.e % 32768 < 9 THEN w.e + 32768 - w.e % 32768 ELSE w.e END AS start"
        " FROM w JOIN r ON r.file = w.file AND r.rn = w.rn + 1)))"
    )


@_query(
    _layout_sql("SELECT doc_id % 16 AS file, doc_id AS seq, 12 + octet_length(encode(coalesce(text, ''))) AS d FROM documents")
    + ' SELECT file, seq, start, fragments, e AS "end" FROM w WHERE rn > 0'
)
def log_layout(spark, sf_dir):
    """Place of every document in a log of large values (several fragments each)."""
    d = _table(spark, sf_dir, "documents").select(
        F.pmod("doc_id", F.lit(16)).alias("file"), F.col("doc_id").alias("seq"), (F.lit(4 + 8) + F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")
    )
    return layout.log_layout(d)


@_query(
    _layout_sql("SELECT o_orderkey // 1000 AS file, o_orderkey AS seq, 12 + octet_length(encode(o_orderpriority)) AS d FROM orders")
    + " SELECT file AS run_id, max(rn) AS n, max(e) AS size FROM w WHERE rn > 0 GROUP BY file"
)
def wal_record_bytes(spark, sf_dir):
    """Records and bytes of every table, headers and blocks' ends included."""
    placed = _sorted_layout(spark, sf_dir, 1000)
    return placed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("size"))


@_query(
    _layout_sql("SELECT o_orderkey // 4000 AS file, o_orderkey AS seq, 12 + octet_length(encode(o_orderpriority)) AS d FROM orders")
    + " SELECT file AS run_id, start // 32768 AS block_id, lpad(hex(min(seq)), 16, '0') AS min_key, start // 32768 * 32768 AS offset"
    " FROM w WHERE rn > 0 GROUP BY ALL"
)
def block_index(spark, sf_dir):
    index = ranges.block_index(_sorted_layout(spark, sf_dir), BLOCK)
    return index.select("run_id", "block_id", F.hex("min_key").alias("min_key"), "offset")


@_query(
    f"WITH {_R}, p AS (SELECT c_custkey * 7 - 20 AS n FROM customer WHERE c_custkey * 7 - 20 >= 0)"
    " SELECT n, id AS offset FROM p ASOF LEFT JOIN r ON n >= a"
)
def floor_lookup(spark, sf_dir):
    points = _table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7 - 20).alias("n")).where("n >= 0")
    index = order_runs(spark, sf_dir).select("min_key", F.col("id").alias("offset"))
    return ranges.floor_lookup(points.withColumn("key", codecs.long_be("n")), index).select("n", "offset")


def _actions(spark, sf_dir):
    r = order_runs(spark, sf_dir)
    log = r.limit(0).withColumn("action_seq", F.lit(0).cast("long")).withColumn("action", F.lit(""))
    first = r.withColumn("action_seq", F.col("id") * 10).withColumn("action", F.lit("add"))
    moved = r.where("id % 4 = 1").withColumn("action_seq", F.col("id") * 10 + 1).withColumn("action", F.lit("remove"))
    back = (
        r.where("id % 8 = 1").withColumn("action_seq", F.col("id") * 10 + 2).withColumn("action", F.lit("add"))
        .unionByName(r.where("id % 8 = 5").withColumn("level", F.col("level") + 1).withColumn("action_seq", F.col("id") * 10 + 3).withColumn("action", F.lit("add")))
    )
    return log.unionByName(first).unionByName(moved).unionByName(back)


_LIVE = (
    f"WITH {_R}, x AS (SELECT id, (CASE WHEN id % 8 = 5 THEN level + 1 ELSE level END)::INT AS level, a, b, file_size FROM r),"
    " l AS (SELECT * FROM x UNION ALL SELECT id, level::INT, a, b, file_size FROM r WHERE false)"
)


@_query(_LIVE + " SELECT id, level, a AS lowest FROM l")
def manifest_replay(spark, sf_dir):
    live = manifest.replay(_actions(spark, sf_dir))
    return live.select("id", "level", codecs.from_long_be("min_key").alias("lowest"))


@_query(_LIVE + " SELECT level, count(*) AS tables, sum(file_size)::BIGINT AS bytes, min(a) AS lowest, max(b) AS highest FROM l GROUP BY level")
def manifest_summary(spark, sf_dir):
    s = manifest.summary(manifest.replay(_actions(spark, sf_dir)))
    return s.select("level", "tables", "bytes", codecs.from_long_be("min_key").alias("lowest"), codecs.from_long_be("max_key").alias("highest"))


@_query(
    f"WITH {_R}, c AS (SELECT level, count(*) AS tables FROM r GROUP BY level)"
    " SELECT level::INT AS level, tables, (CASE WHEN level = 0 THEN 4 ELSE 10 ** level END)::BIGINT AS capacity,"
    " tables > (CASE WHEN level = 0 THEN 4 ELSE 10 ** level END) AS over FROM c"
)
def level_over_capacity(spark, sf_dir):
    return manifest.over_capacity(order_runs(spark, sf_dir))


@_query(
    "SELECT c_custkey AS tables, greatest(1, least(5, cast(trunc((c_custkey - 100) / 10.0) AS INT))) AS count FROM customer"
)
def adaptive_targets(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tables"))
    return c.select("tables", manifest.adaptive_count("tables", F.lit(Config().capacity(2))).alias("count"))


@_query(
    f"WITH {_R} SELECT level::INT AS level, id, coalesce(lead(id) OVER w, first_value(id) OVER w) AS next_id FROM r"
    " WINDOW w AS (PARTITION BY level ORDER BY a, id)"
)
def round_robin_next(spark, sf_dir):
    return manifest.next_candidates(order_runs(spark, sf_dir))


@_query(
    "WITH r AS (SELECT o_orderkey // 400 AS id, min(o_orderkey) AS a, min(o_orderkey) + sum(o_custkey) % 800 AS b, (o_orderkey // 400) % 3 AS level FROM orders GROUP BY 1, 4),"
    " s AS (SELECT * FROM r WHERE level = 0), t AS (SELECT * FROM r WHERE level = 1)"
    " SELECT id, 1 AS level FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE s.a <= t.b AND t.a <= s.b)"
    " AND NOT EXISTS (SELECT 1 FROM s u WHERE u.id <> s.id AND s.a <= u.b AND u.a <= s.b)"
)
def trivial_moves(spark, sf_dir):
    """Runs of up to 800 keys, so that some have neighbours below and some have none."""
    o = _table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 400).cast("long").alias("id"))
    r = o.agg(F.min("o_orderkey").alias("a"), F.pmod(F.sum("o_custkey"), F.lit(800)).alias("width")).select(
        "id",
        codecs.long_be("a").alias("min_key"),
        codecs.long_be(F.col("a") + F.col("width")).alias("max_key"),
        F.pmod("id", F.lit(3)).cast("int").alias("level"),
    )
    return manifest.trivial_moves(r.where("level = 0"), r.where("level = 1")).select("id", "level")


@_query(f"WITH {_R} SELECT 'sstable_' || id AS path FROM r WHERE id % 4 = 1")
def vacuum_candidates(spark, sf_dir):
    r = order_runs(spark, sf_dir)
    return manifest.vacuum_candidates(r.select("path"), r.where("id % 4 <> 1"))


@_query("SELECT 1 + max(o_orderkey // 400) AS next FROM orders")
def next_file_number(spark, sf_dir):
    return manifest.next_file_number(order_runs(spark, sf_dir).select("path"), "sstable_")


@_query("SELECT count(*) AS operations, count(DISTINCT user_id) AS misses, (count(*) - count(DISTINCT user_id)) / count(*) AS rate FROM events")
def cache_hit_rate(spark, sf_dir):
    return latest.hit_rate(_table(spark, sf_dir, "events").select(F.col("user_id").alias("table")))


@_query(
    "WITH a AS (SELECT user_id % 8 AS reader, user_id // 8 AS t, event_id AS seq FROM events),"
    " p AS (SELECT *, lag(seq) OVER (PARTITION BY reader, t ORDER BY seq) AS was FROM a),"
    " h AS (SELECT p.reader, p.seq, count(DISTINCT a.t) AS others FROM p JOIN a ON a.reader = p.reader AND a.seq > p.was AND a.seq < p.seq GROUP BY ALL)"
    " SELECT p.reader, count(*) AS operations, count(*) FILTER (WHERE was IS NULL OR coalesce(others, 0) >= 8) AS misses"
    " FROM p LEFT JOIN h ON h.reader = p.reader AND h.seq = p.seq GROUP BY p.reader"
)
def cache_evictions(spark, sf_dir):
    """Misses of eight readers with caches of eight tables each."""
    a = _table(spark, sf_dir, "events").select(
        F.pmod("user_id", F.lit(8)).alias("reader"), F.floor(F.col("user_id") / 8).cast("long").alias("table"), F.col("event_id").alias("seq")
    )
    return latest.lru_hits(a, 8)


@_query(
    "WITH RECURSIVE r AS (SELECT o_orderkey // 4000 AS run_id, o_orderkey AS seq, 100 + o_custkey % 97 AS d,"
    " row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) AS rn FROM orders),"
    " w AS (SELECT DISTINCT run_id, 0::BIGINT AS rn, NULL::BIGINT AS seq, 0::BIGINT AS d, 0::BIGINT AS part, 0::BIGINT AS total FROM r"
    " UNION ALL SELECT r.run_id, r.rn, r.seq, r.d, CASE WHEN w.total >= 20000 THEN w.part + 1 ELSE w.part END,"
    " CASE WHEN w.total >= 20000 THEN r.d ELSE w.total + r.d END FROM w JOIN r ON r.run_id = w.run_id AND r.rn = w.rn + 1)"
    " SELECT run_id, part, count(*) AS n, min(seq) AS first, sum(d)::BIGINT AS size FROM w WHERE rn > 0 GROUP BY ALL"
)
def output_split(spark, sf_dir):
    """Parts of at least 20,000 bytes of each run of orders."""
    o = _table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 4000).cast("long").alias("run_id"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 97 + 100).alias("bytes")
    )
    split = layout.split_by_bytes(o, "run_id", "seq", "bytes", 20_000)
    return split.groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.sum("bytes").alias("size"))


@_query(
    "WITH RECURSIVE b AS (SELECT s_suppkey, s_name AS t, 4294967295::BIGINT AS c, 0 AS i FROM supplier"
    " UNION ALL SELECT s_suppkey, t, xor(c >> 1, CASE WHEN (c & 1) <> ((ord(t[i // 8 + 1]) >> (i % 8)) & 1) THEN 2197175160 ELSE 0 END), i + 1"
    " FROM b WHERE i < 8 * length(t))"
    " SELECT s_suppkey, xor(c, 4294967295) AS crc FROM b WHERE i = 8 * length(t)"
)
def crc_verify(spark, sf_dir):
    """CRC-32C of every supplier's name; the SQL computes it bit by bit."""
    return _table(spark, sf_dir, "supplier").select("s_suppkey", codecs.crc32c(codecs.from_text("s_name")).cast("long").alias("crc"))


@_query(f"{_N} SELECT k, v FROM n WHERE NOT gone")
def store_live(spark, sf_dir):
    """The log written to a store in three batches, flushed, compacted and read back."""
    from keystrata.plans.compaction import compact
    from keystrata.sources.store import Store

    store = Store(spark, shared.folder(spark, "store"), Config(table_bytes=200_000, young_tables=2))
    m = mutations(spark, sf_dir).withColumn("third", F.pmod("seq", F.lit(3)))
    top = m.agg(F.max("seq")).first()[0] + 1
    for i in range(3):
        part = m.where((F.col("seq") >= top * i // 3) & (F.col("seq") < top * (i + 1) // 3))
        store.write(part, order="seq")
        if i < 2:
            store.flush()
    compact(store)
    store.close()
    return _show(store.live()).select("k", "v")


@_query(f"WITH {_M} SELECT run_id, k, v, gone AS deleted, true AS intact FROM m")
def wal_replay(spark, sf_dir):
    """The log written as binary files and scanned back."""
    from keystrata.sources import logfile

    folder = shared.folder(spark, "wal")
    logfile.write_logs(runs(spark, sf_dir), folder, "run_id").collect()
    back = logfile.read_logs(spark, folder).withColumn("run_id", F.regexp_extract("path", "wal_([0-9]+)$", 1).cast("long"))
    return _show(back).select("run_id", "k", "v", (F.col("op") == latest.DELETE).alias("deleted"), "intact")


@_query("SELECT o_orderkey // 4000 AS run_id, lpad(hex(o_orderkey), 16, '0') AS k, o_orderpriority AS v, true AS intact FROM orders")
def sstable_scan(spark, sf_dir):
    """Orders written as sorted binary tables with block index and footer, and scanned back."""
    from keystrata.sources import logfile

    o = _table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 4000).cast("long").alias("run_id"),
        codecs.long_be("o_orderkey").alias("key"),
        F.lit(latest.PUT).alias("op"),
        codecs.from_text("o_orderpriority").alias("value"),
    )
    folder = shared.folder(spark, "sstable")
    logfile.write_tables(o, folder, "run_id").collect()
    back = logfile.read_tables(spark, folder).withColumn("run_id", F.regexp_extract("path", "sstable_([0-9]+)$", 1).cast("long"))
    return _show(back).select("run_id", "k", "v", "intact")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
