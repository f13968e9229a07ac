"""Registered queries over whole tables against loops over the same rows."""

import pyarrow.parquet as pq

from keystrata import queries

SF_DIR = "/root/testdata/sf0.1"


def newest(level=None):
    """``user_id: (value, run, deleted)`` of the newest event, of all runs or of those of one level."""
    columns = ["event_id", "user_id", "event_type", "props"]
    out = {}
    for event, user, kind, props in sorted(zip(*(pq.read_table(f"{SF_DIR}/events.parquet", columns=[c])[c].to_pylist() for c in columns))):
        run = event // queries.RUN_ROWS
        if level is None or -run % 3 == level:
            out[user] = (None if kind == "error" else props, run, kind == "error")
    return out


def rows(query, spark):
    return {int(r.k, 16): (r.v, r.run_id, r.deleted) for r in queries.queries()[query](spark, SF_DIR).collect()}


def test_young_get_looks_up_every_key(spark):
    got = rows("young_get", spark)
    assert got == newest(0) and max(got) >= 500


def test_kway_merge_takes_every_run(spark):
    got = rows("kway_merge", spark)
    assert got == newest() and len({run for _, run, _ in got.values()} - {1, 3, 4, 7}) > 1


def test_trivial_moves_meet_every_run_below(spark):
    orders = {}
    table = pq.read_table(f"{SF_DIR}/orders.parquet", columns=["o_orderkey", "o_custkey"])
    for key, customer in zip(table["o_orderkey"].to_pylist(), table["o_custkey"].to_pylist()):
        first, total = orders.get(key // 400, (key, 0))
        orders[key // 400] = (min(first, key), total + customer)
    span = {i: (a, a + total % 800) for i, (a, total) in orders.items()}
    upper, lower = ([i for i in span if i % 3 == level] for level in (0, 1))
    meets = lambda i, others: any(span[i][0] <= span[j][1] and span[j][0] <= span[i][1] for j in others if j != i)
    want = {(i, 1) for i in upper if not meets(i, upper) and not meets(i, lower)}
    got = {tuple(r) for r in queries.queries()["trivial_moves"](spark, SF_DIR).collect()}
    assert got == want and 0 < len(want) < len(upper)
    assert any(not meets(i, [j for j in lower if j % 2 == 0]) for i in upper if (i, 1) not in want)  # odd runs matter
