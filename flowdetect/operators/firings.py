"""Firings of multi-class patterns that are news, spread over a source's time.

A pattern is complete at an alert when all its classes occur in the window that
ends there. It fires unless every id of that window stood in the window of the
pattern's last firing, ``hold`` or less before. So which alert fires next
depends on the last firing alone: within a block of time, firings are found by
jumping from each to its successor, and what a block does to the last firing
before it is a step function of that firing's time. These functions (a row for
each step) are composed along a source. Patterns are settled by priority, as an
alert that fires one is closed to the later ones."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

S = 1_000_000
NEVER = 1 << 62
LINKS = 20  # contributing alerts of an incident: the last ones


class Pattern:
    """One pattern over a source's alerts from ``start`` on, with those of the
    lead before it; ``t`` ascends. ``taken``: alerts that fired another one."""

    def __init__(self, t: np.ndarray, kind: np.ndarray, code: np.ndarray, start: int, need: list, window: int, hold: int, taken: np.ndarray):
        self.window, self.hold, self.start = window, hold, start
        self.inside = np.flatnonzero(np.isin(kind, need))
        self.pt, self.pid = t[self.inside], code[self.inside]
        complete = ~taken
        for c in need:
            at = np.concatenate([[-NEVER], t[kind == c]])
            complete &= at[np.searchsorted(at, t, "right") - 1] > t - window
        own = np.flatnonzero(complete & (t >= start))
        self.times, first = np.unique(t[own], return_index=True)
        self.rows = own[first]  # of equal times the first alert fires
        self.entries = np.unique(t[complete & (t < start) & (t >= start - hold)])
        # an id is fresh where the window before does not hold it: new to every
        # firing from `since` on and before `fresh`
        pairs = np.unique(np.stack([self.pid, self.pt]), axis=1)
        before = np.where(np.diff(pairs[0], prepend=-1) == 0, np.roll(pairs[1], 1), -NEVER)
        since, fresh = before + window, pairs[1]
        order = np.lexsort((since, fresh))
        order = order[since[order] < fresh[order]]
        self.since, self.fresh = since[order], fresh[order]

    def _news(self, x: np.ndarray) -> np.ndarray:
        """For ascending firing times, when the first id comes that is new to each."""
        k = np.searchsorted(self.fresh, x, "right")
        known = k < len(self.fresh)
        out = np.where(known, np.append(self.fresh, NEVER)[k], NEVER)
        other = np.flatnonzero(known & (np.append(self.since, NEVER)[k] > x))
        if len(other):  # ids that stood in the firing's window, left it and came back
            order, i, heap = np.argsort(self.since, kind="stable"), 0, []
            for o in other.tolist():
                while i < len(order) and self.since[order[i]] <= x[o]:
                    heapq.heappush(heap, int(self.fresh[order[i]]))
                    i += 1
                while heap and heap[0] <= x[o]:
                    heapq.heappop(heap)
                out[o] = heap[0] if heap else NEVER
        return out

    def after(self, x: np.ndarray) -> np.ndarray:
        """For ascending times of a last firing, the position in ``times`` of the
        next firing (their number, where there is none)."""
        late = np.searchsorted(self.times, x + self.hold, "right")
        news = self._news(x)
        j = np.searchsorted(self.times, news)
        gone = (j < late) & (np.append(self.times, NEVER)[j] - news >= self.window)
        out = np.minimum(j, late)
        for i in np.flatnonzero(gone).tolist():  # the new id left the window before the pattern was complete
            out[i] = self._walk(int(x[i]), int(late[i]))
        return out

    def _walk(self, x: int, late: int) -> int:
        a, b, c = np.searchsorted(self.pt, [x - self.window, x, x + self.hold], "right")
        new = np.concatenate([[-NEVER], self.pt[b:c][~np.isin(self.pid[b:c], self.pid[a:b])]])
        at = int(np.searchsorted(self.times, x, "right"))
        tries = self.times[at:late]
        ok = new[np.searchsorted(new, tries, "right") - 1] > tries - self.window
        return at + int(np.argmax(ok)) if ok.any() else late

    def fired(self, last: int | None) -> list[int]:
        """Positions in ``times`` that fire after the firing at ``last``."""
        n = len(self.times)
        i = 0 if last is None or last < self.start - self.hold else int(self.after(np.array([last]))[0])
        go, out = self.after(self.times).tolist(), []
        while i < n:
            out.append(i)
            i = go[i]
        return out

    def steps(self) -> tuple[list[int], list[int]]:
        """(until, last): a firing before the block up to ``until``, and later
        than the one before, leads to the last firing at ``last``."""
        n = len(self.times)
        if not n:
            return [], []
        go, end = self.after(self.times).tolist(), list(range(n))
        for i in range(n - 1, -1, -1):
            end[i] = end[go[i]] if go[i] < n else i
        until, last = [self.start - self.hold - 1], [int(self.times[end[0]])]
        for e, i in zip(self.entries.tolist(), self.after(self.entries).tolist()):
            to = int(self.times[end[i]]) if i < n else e
            if to == last[-1]:
                until[-1] = e
            else:
                until.append(e)
                last.append(to)
        return until, last


def _settled(rows: pa.Table, begins: pa.Table | None, patterns, block: int, hold: int, upto: int):
    """The block's alerts in order, the patterns before ``upto`` with what they
    fire, and the pattern ``upto`` itself, if there is one."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("ts_us", "ascending"), ("seq", "ascending")]))
    t = rows["ts_us"].to_numpy()
    kinds = rows["threat_class"].combine_chunks().dictionary_encode()
    kind, names = kinds.indices.to_numpy(zero_copy_only=False), kinds.dictionary.to_pylist()
    code = rows["id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype("int64")
    start, seq = rows["_b"][0].as_py() * block, rows["seq"].to_numpy(zero_copy_only=False)
    last = dict(zip(begins["priority"].to_pylist(), begins["last"].to_pylist())) if begins is not None else {}
    taken, done = np.zeros(len(t), bool), []
    for p, (_, need, seconds, *_) in enumerate(patterns[: upto + 1]):
        one = Pattern(t, kind, code, start, [names.index(c) if c in names else -1 for c in need], seconds * S, hold, taken)
        if p == upto:
            return rows, done, one
        at = one.fired(last[p]) if p in last else []
        done.append((one, at))
        taken = taken | ((t >= start) & np.isin(seq, seq[one.rows[at]])) if at else taken
    return rows, done, None


def _along(maps: pa.Table) -> pa.Table:
    """Of one source and pattern: the last firing before each block."""
    maps = maps.take(pc.sort_indices(maps, sort_keys=[("_b", "ascending"), ("until", "ascending")]))
    blocks, before, now, found = [], [], None, True
    for b, until, last in zip(*(maps[c].to_pylist() for c in ("_b", "until", "last"))):
        if not blocks or b != blocks[-1]:
            blocks.append(b)
            before.append(now)
            found = False
        if not found and (now is None or until >= now):
            now, found = last, True
    head = maps.slice(0, 1)
    same = lambda c: pa.array([head[c][0].as_py()] * len(blocks), head[c].type)
    return pa.Table.from_arrays([same("src_ip"), pa.array(blocks, pa.int64()), same("priority"), pa.array(before, pa.int64())], names=["src_ip", "_b", "priority", "last"])


def spread(alerts: DataFrame, patterns: tuple, hold: int = 900, block: int = 86_400) -> DataFrame:
    """Firings of ``patterns`` (name, classes, seconds, confidence, severity; by
    priority) over ``alerts`` (src_ip, ts_us, seq, threat_class, id, confidence,
    dst_ip, event_ts), with the last alerts that contribute.

    A source's alerts are dealt to blocks of ``block`` seconds, each with the
    ``hold`` and the longest window before it, so a busy source is spread over
    tasks; alerts without time are left out, an alert without id has none in
    common with another time or class."""
    lead, size, hold = (hold + max(p[2] for p in patterns)) * S, block * S, hold * S
    floor = f"({{0}} - pmod({{0}}, {size}L)) DIV {size}L".format
    d = alerts.where("ts_us IS NOT NULL").withColumn("_b", F.explode(F.expr(f"sequence({floor('ts_us')}, {floor(f'(ts_us + {lead}L)')})")))
    kind = {f.name: f.dataType.simpleString() for f in d.schema}
    by, begins = d.groupBy("src_ip", "_b"), None

    def maps(p: int):
        def run(rows: pa.Table, begins: pa.Table) -> pa.Table:
            until, last = _settled(rows, begins, patterns, size, hold, p)[2].steps()
            n = len(until)
            return pa.table({"src_ip": pa.array([rows["src_ip"][0].as_py()] * n, pa.string()), "_b": pa.array([rows["_b"][0].as_py()] * n, pa.int64()), "priority": pa.array([p] * n, pa.int32()), "until": pa.array(until, pa.int64()), "last": pa.array(last, pa.int64())})

        return run if p else lambda rows: run(rows, None)

    for p in range(len(patterns)):
        groups = by if begins is None else by.cogroup(begins.groupBy("src_ip", "_b"))
        own = groups.applyInArrow(maps(p), "src_ip string, _b long, priority int, until long, last long")
        own = own.groupBy("src_ip").applyInArrow(_along, "src_ip string, _b long, priority int, last long")
        begins = own if begins is None else begins.unionByName(own)

    links = ["ts_us", "seq", "threat_class", "id", "confidence"]
    out = ["src_ip", "ts_us", "seq", "dst_ip", "event_ts"]

    def keep(rows: pa.Table, begins: pa.Table) -> pa.Table:
        rows, done, _ = _settled(rows, begins, patterns, size, hold, len(patterns))
        at, priority, inside, offsets = [], [], [], [0]
        for p, (one, fired) in enumerate(done):
            hi = np.searchsorted(one.pt, one.times[fired], "right")
            lo = np.maximum(np.searchsorted(one.pt, one.times[fired] - one.window, "right"), hi - LINKS)
            for a, b in zip(lo.tolist(), hi.tolist()):
                inside.extend(one.inside[a:b].tolist())
                offsets.append(len(inside))
            at.extend(one.rows[fired].tolist())
            priority.extend([p] * len(fired))
        near = rows.select(links).take(pa.array(inside, pa.int64())).combine_chunks()
        structs = pa.StructArray.from_arrays([near[c].combine_chunks() for c in links], names=links)
        t = rows.select(out).take(pa.array(at, pa.int64()))
        return t.append_column("priority", pa.array(priority, pa.int32())).append_column("contributing", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs))

    schema = ", ".join(f"{c} {kind[c]}" for c in out) + ", priority int, contributing array<struct<" + ", ".join(f"{c}: {kind[c]}" for c in links) + ">>"
    fired = by.cogroup(begins.groupBy("src_ip", "_b")).applyInArrow(keep, schema)
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in patterns)), F.col("priority") + 1)
    return fired.select("src_ip", "ts_us", "seq", "priority", pick(0).alias("pattern"), pick(3).alias("confidence"), pick(4).alias("severity"), "contributing", "dst_ip", "event_ts")
