"""Order-dependent gates over candidate rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.sources.shared import stored


FILLED = 20_000  # candidates that a block of the busiest key may hold


def cooldown(candidates: DataFrame, keys: list[str], seconds: int, ts: str = "ts_us", row: str = "event_id", blocks: int = 64) -> DataFrame:
    """Keeps a candidate iff it is ``seconds`` after the last kept one of its
    key, in order of time, then ``row``.

    A key's candidates are cut into blocks of ``blocks`` cooldowns, or as many
    times that as hold ``FILLED`` of them where they are busiest: a block is a
    call, which costs more than a few rows. The last one that a block keeps is a
    step function of the first time at which it may keep any; these functions (a
    row for each step) are composed along a key, and each block then keeps its
    own, so a busy key is spread over tasks. Candidates are written once to the
    shared folder, as each step reads them."""
    span = max(seconds, 1) * 1_000_000
    block, gap = span * blocks, seconds * 1_000_000
    of = lambda block: F.expr(f"({ts} - pmod({ts}, {block}L)) DIV {block}L")
    candidates = stored(candidates, "candidates")
    most = candidates.groupBy(*keys, of(block).alias("_b")).count().agg(F.max("count")).first()[0]
    block *= max(1, FILLED // (most or FILLED))
    d = candidates.withColumn("_b", of(block))
    kinds = ", ".join(f"`{k}` {candidates.schema[k].dataType.simpleString()}" for k in keys)

    def steps(t: pa.Table) -> pa.Table:
        """(keys, block, until, last): a block that may keep from a time up to
        ``until`` on, and later than the ``until`` before, keeps ``last`` as its last."""
        at = np.sort(t[ts].to_numpy())
        start = t["_b"][0].as_py() * block
        first = np.arange(min(len(at), int(np.searchsorted(at, start + span)) + 1))
        after = np.maximum(np.searchsorted(at, at + gap), np.arange(len(at)) + 1)
        end = np.where(after < len(at), after, np.arange(len(at)))
        while (end != (end := end[end])).any():  # along the kept ones, twice as far each time
            pass
        end = end[first]
        change = np.append(at[end][1:] != at[end][:-1], True)
        head = t.slice(0, 1).select([*keys, "_b"])
        columns = [pa.chunked_array([pa.array([c[0].as_py()] * int(change.sum()), c.type)]) for c in head.columns]
        return pa.Table.from_arrays([*columns, pa.array(at[first][change]), pa.array(at[end][change])], names=[*keys, "_b", "until", "last"])

    def along(t: pa.Table) -> pa.Table:
        """(keys, block, from): when a key's blocks may keep their first."""
        order = pc.sort_indices(t, sort_keys=[("_b", "ascending"), ("until", "ascending")])
        t = t.take(order)
        start, begins, now, done = [], [], None, None
        for i, (b, until, last) in enumerate(zip(t["_b"].to_pylist(), t["until"].to_pylist(), t["last"].to_pylist())):
            if not start or b != begins[-1][0]:
                start.append(i)
                begins.append((b, now))
                done = False
            if not done and (now is None or until >= now):
                now, done = last + gap, True
        head = t.take(pa.array(start)).select([*keys, "_b"])
        return head.append_column("_from", pa.array([f for _, f in begins], pa.int64()))

    def keep(own: pa.Table, begin: pa.Table) -> pa.Table:
        own = own.take(pc.sort_indices(own, sort_keys=[(ts, "ascending"), (row, "ascending")]))
        at, since = own[ts].to_numpy(), begin["_from"][0].as_py() if len(begin) else None
        i, kept = 0 if since is None else int(np.searchsorted(at, since)), []
        after = np.maximum(np.searchsorted(at, at + gap), np.arange(len(at)) + 1).tolist()
        while i < len(at):
            kept.append(i)
            i = after[i]
        return own.take(pa.array(kept, pa.int64())).drop_columns("_b")

    by = d.groupBy(*keys, "_b")
    maps = d.select(*keys, "_b", ts).groupBy(*keys, "_b").applyInArrow(steps, f"{kinds}, _b long, until long, last long")
    begins = maps.groupBy(*keys).applyInArrow(along, f"{kinds}, _b long, _from long")
    return by.cogroup(begins.groupBy(*keys, "_b")).applyInArrow(keep, candidates.schema)


def first_only(candidates: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts_us", "event_id")) -> DataFrame:
    """The first candidate of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def novel_set(firings: DataFrame, seconds: int = 900, fired: DataFrame | None = None) -> DataFrame:
    """Firings (key, ts_us, seq, priority, pattern, ids array) that are news: per
    key, rows of one alert (seq) are tried by priority; a pattern fires unless
    its ids are a subset of those of its last firing within ``seconds``; the
    first that fires ends the alert's turn. ``fired`` (key, pattern, ts_us, ids):
    the last firings before."""

    def run(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts_us", "seq", "priority"]).reset_index(drop=True)
        last = {p: (t, frozenset(i)) for p, t, i in zip(before["pattern"], before["ts_us"], before["ids"])}
        return rows.loc[list(news(rows["ts_us"], rows["seq"], rows["pattern"], rows["ids"], seconds, last))]

    if fired is None:
        return firings.groupBy("src_ip").applyInPandas(lambda rows: run(rows, rows[:0]), firings.schema)
    return firings.groupBy("src_ip").cogroup(fired.groupBy("src_ip")).applyInPandas(run, firings.schema)


def news(ts, seq, pattern, ids, seconds: int, fired: dict):
    """Positions of the firings that are news, in order; ``fired`` holds the
    last firing of each pattern: (time, ids)."""
    done = None
    for i, (t, q, p, x) in enumerate(zip(ts, seq, pattern, ids)):
        if done == q:
            continue
        x, old = frozenset(x), fired.get(p)
        if old and t - old[0] <= seconds * 1_000_000 and x <= old[1]:
            continue
        fired[p] = (t, x)
        done = q
        yield i
