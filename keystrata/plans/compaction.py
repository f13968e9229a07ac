"""Levelled compaction.

A level over its capacity gives runs to the next one: all of level 0, else some whose turn it
is.  A source that meets nothing moves by name only.  The others are merged with every run of
the next level inside their common range, so that what is written never spans an untouched run.
Deletions go where no deeper level can hold the key.  Files are written first, then one manifest
version adds and removes.
"""

from __future__ import annotations

import base64
import logging
import time

from pyspark.sql import functions as F

from keystrata.operators import latest

log = logging.getLogger(__name__)


def _key(run: dict) -> tuple[bytes, int]:
    return base64.b64decode(run["min_key"]), run["id"]


def _end(run: dict) -> bytes:
    return base64.b64decode(run["max_key"])


def _meet(a: dict, b: dict) -> bool:
    return _key(a)[0] <= _end(b) and _key(b)[0] <= _end(a)


def standard(runs: list[dict], level: int, capacity: int) -> int:
    """Level 0 at once, deeper levels run by run."""
    return len(runs) if level == 0 else 1


def adaptive(runs: list[dict], level: int, capacity: int) -> int:
    """Level 0 at once; of deeper levels a tenth of what is too many, between 1 and 5."""
    return len(runs) if level == 0 else max(1, min(5, int((len(runs) - capacity) / 10)))


def choose(runs: list[dict], count: int, last: tuple[bytes, int] | None) -> list[dict]:
    """``count`` runs in the level's order that follow ``last``, wrapping around."""
    order = sorted(runs, key=_key)
    begin = next((i for i, r in enumerate(order) if last is not None and _key(r) > last), 0)
    return [order[(begin + i) % len(order)] for i in range(min(count, len(order)))]


def merge_level(store, level: int, strategy=adaptive) -> dict:
    """Compact one level once; returns what was done."""
    began = time.time()
    state = store.state
    own = [r for r in state["runs"] if r["level"] == level]
    if not own:
        return {"level": level, "moved": 0, "merged": 0, "written": 0, "seconds": 0.0}
    below = [r for r in state["runs"] if r["level"] == level + 1]
    turn = state["turn"].get(str(level))
    last = (base64.b64decode(turn[0]), turn[1]) if turn else None
    sources = choose(own, strategy(own, level, store.config.capacity(level)), last)
    moved = [s for s in sources if not any(_meet(s, o) for o in [*below, *own] if o is not s)]
    rest = [s for s in sources if s not in moved]
    if rest and level == 0:
        moved, rest = ([], sources) if any(_meet(m, r) for m in moved for r in rest) else (moved, rest)
    next_id, written, targets = state["next_id"], [], []
    if rest:
        low, high = min(_key(r)[0] for r in rest), max(_end(r) for r in rest)
        moved, inside = [m for m in moved if not low <= _end(m) or not _key(m)[0] <= high], [
            m for m in moved if low <= _end(m) and _key(m)[0] <= high
        ]
        rest += inside
        targets = [b for b in below if _key(b)[0] <= high and low <= _end(b)]
        while targets and (min(_key(t)[0] for t in targets) < low or max(_end(t) for t in targets) > high):
            low = min([low, *(_key(t)[0] for t in targets)])
            high = max([high, *(_end(t) for t in targets)])
            more = [b for b in below if _key(b)[0] <= high and low <= _end(b)]
            inside = [m for m in moved if _key(m)[0] <= high and low <= _end(m)]
            if len(more) == len(targets) and not inside:
                break
            rest, moved, targets = rest + inside, [m for m in moved if m not in inside], more
        inputs = rest + targets
        rows = store.spark.read.schema("seq long, key binary, op string, value binary").parquet(*(r["path"] for r in inputs))
        deeper = any(r["level"] > level + 1 and _key(r)[0] <= high and low <= _end(r) for r in state["runs"])
        # runs of this level that stay may hold older rows of the same keys
        stays = any(_key(r)[0] <= high and low <= _end(r) for r in own if r not in sources)
        merged = latest.newest(rows)
        if not deeper and not stays:
            merged = merged.where(F.col("op") == latest.PUT)
        written, next_id = store.write_runs(merged, level + 1, sum(r["file_size"] for r in inputs))
    gone = {r["id"] for r in rest + targets + moved}
    kept = [r for r in state["runs"] if r["id"] not in gone]
    kept += [m | {"level": level + 1} for m in moved] + written
    latest_turn = _key(sources[-1])
    store.publish(
        runs=kept,
        next_id=next_id,
        turn=state["turn"] | {str(level): [base64.b64encode(latest_turn[0]).decode(), latest_turn[1]]},
    )
    done = {
        "level": level,
        "moved": len(moved),
        "merged": len(rest) + len(targets),
        "written": len(written),
        "seconds": round(time.time() - began, 3),
    }
    log.info("compaction %s", done)
    return done


def compact(store, level: int = 0, strategy=adaptive) -> list[dict]:
    """Compact every level from ``level`` down to the deepest one at the start that is too full."""
    out = []
    deepest = max((r["level"] for r in store.state["runs"]), default=0)
    for at in range(level, deepest + 1):
        while len([r for r in store.state["runs"] if r["level"] == at]) > store.config.capacity(at):
            out.append(merge_level(store, at, strategy))
    return out
