"""Removes every byte covered by a 200-byte string that starts anywhere else.

Two suffixes belong together when their first 200 bytes agree, so the order of
suffixes matters to that depth only, and which position is sampled, named and
sorted can be chosen by content. The steps are those of a difference-cover
construction: sample positions, sort and name what starts there, drop unique
names, carry the names over to the remaining suffixes, merge those and compare
neighbours.

1. Sample: the key of a suffix is the least (hashed) 100-byte string among the
   101 that start in its first 101 bytes. Equal suffixes have equal keys at
   equal offsets, so every pair is covered, as by a difference cover, but with
   2 samples in 101 positions. Neighbouring suffixes share a key and make a run.
2. Sort and name: runs are sorted by their key's name and by the name of the
   bytes that all suffixes of the run span. A key that occurs once drops all its
   suffixes. A run whose bytes occur twice decides all its suffixes at once.
3. Merge the rest: where a repeated key has runs that occur once, the suffixes
   of these, and of one representative of each repeated run under that key, are
   named by their 200 bytes, sorted, and compared with their neighbours.

A plain difference cover modulo 3 ranks every suffix in each of its levels; the
README gives the figures that rule it out here. Names are 64-bit fingerprints;
two texts, runs or suffixes count as equal when two of them (96 bits or more)
agree. Runs that occur more than once within a block of a task are settled
there, so a passage in a third of all documents stays a few rows per block.
Partitions of runs and suffixes are sorted by Spark and read along, so a task
holds the same however many rows its partition has.

Edge cases: null and empty texts, and texts under ``length`` bytes, lose
nothing. Repeated rows are copies: a text of ``length`` bytes or more that
occurs twice is removed whole. Overlapping occurrences in one text count.
Empty tables give empty results; extra columns are ignored. Long texts are
processed whole, a segment at a time; what is told of a text's runs and
suffixes meets in that text's row (4 bytes a byte of text at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import _BYTE, U64, as_long, chunks, hidden, mix, powers, table, text_key

_BITS = 22
_AT = U64((1 << _BITS) - 1)  # bits of a sort code that hold the position in a segment
SEGMENT = 1 << 21  # bytes of a text whose suffixes are looked at together


class Block:
    """Runs of suffixes with a common key, over texts laid end to end. A text
    above ``SEGMENT`` bytes is cut into segments that overlap by a suffix."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int):
        self.length, self.offs = length, offs
        if len(buf) <= SEGMENT + length:
            found = [self._runs(buf, offs, 0)]
        else:  # one long text
            found = [self._runs(buf[i : i + SEGMENT + length - 1], np.array([0, min(SEGMENT + length - 1, len(buf) - i)]), i) for i in range(0, max(len(buf) - length + 1, 1), SEGMENT)]
        self.l, self.r, self.g, self.t = (np.concatenate(x) for x in zip(*found))
        self.row = np.searchsorted(offs, self.l, "right") - 1

    def _runs(self, buf: np.ndarray, offs: np.ndarray, shift: int):
        n, length = len(buf), self.length
        k = length // 2
        none = np.empty(0, np.int64)
        if n < length:
            return none, none, none.astype(U64), none.astype(U64)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[buf] * powers(n + 1)[:n], out=sums[1:])
        inverse = powers(n + 1, -1)
        names = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
        code = (names & ~_AT) | np.arange(len(names), dtype=U64)
        width, wide = 1, length - k + 1
        while 2 * width <= wide:
            code = np.minimum(code[:-width], code[width:])
            width *= 2
        if wide > width:
            code = np.minimum(code[: len(code) - (wide - width)], code[wide - width :])
        ends = np.repeat(offs[1:], np.diff(offs))[: len(code)]
        at = np.flatnonzero(np.arange(len(code)) + length <= ends)
        if not len(at):
            return none, none, none.astype(U64), none.astype(U64)
        key = (code[at] & _AT).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)]))
        l, r, p = at[head], at[np.append(head[1:], len(at)) - 1], key[head]
        whole = mix((sums[r + length] - sums[l]) * inverse[l])
        t = mix(whole + mix((p - l).astype(U64) * U64(0x9E6C63D0876A68DD) + (r - l).astype(U64)))
        return l + shift, r + shift, names[p], t

    def number(self) -> np.ndarray:
        """Of each run: its place among the runs of its text."""
        first = np.searchsorted(self.row, self.row, "left")
        return np.arange(len(self.row)) - first


def _blocks(batch: pa.RecordBatch, text: int, length: int):
    for at, buf, offs in chunks(batch.column(text), 1 << 18):
        yield at, buf, Block(buf, offs, length)


def _settle(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal (a, b): which are first, and how many there are (capped at 2)."""
    if not len(a):
        return np.empty(0, bool), np.empty(0, np.int64)
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(x)))
    first, count = np.zeros(len(a), bool), np.empty(len(a), np.int64)
    first[order[head]] = True
    count[order] = np.repeat(np.minimum(size, 2), size)
    return first, count


RUNS = 400_000  # runs of a task that are settled together


def _sampled(batches: Iterator[pa.RecordBatch], length: int):
    """Runs to sort: (g, t, k1, k2, meta = run * 4 + occurrences). Further
    occurrences that the task holds at that time are already decided: 0, dealt
    by their text."""
    held, runs = [], 0

    def settled():
        g, t, k1, k2, number = (np.concatenate(x) for x in zip(*held))
        first, count = _settle(g, t)
        meta = number * 4 + np.where(first, count, 0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.where(first, as_long(g), k1), as_long(t), k1, k2, meta.astype(np.int32))], ["g", "t", "k1", "k2", "meta"])

    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
        for at, _, b in _blocks(batch, 2, length):
            row = at + b.row
            held.append((b.g, b.t, k1[row], k2[row], b.number()))
            runs += len(row)
            if runs > RUNS:
                yield settled()
                held, runs = [], 0
    if runs:
        yield settled()


HELD = 100_000  # sorted rows looked at together


def _sorted_rows(batches: Iterator[pa.RecordBatch], look, direct):
    """Rows of one sorted partition, ``HELD`` at a time. Those that need no look
    (``direct``) go at once; ``look(rows, kept, last)`` gives what is settled of the
    others and the rows to hold for the next ones, as the latest group may go on.
    As many fresh rows as are held are taken at least."""
    held, fresh, kept = [], 0, None
    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        now = direct(rows[-1])
        if now.any():
            yield tuple(x[now] for x in rows)
        held.append(tuple(x[~now] for x in rows))
        fresh += len(held[-1][0])
        if fresh >= max(HELD, len(kept[0]) if kept else 0):
            out, kept = look(tuple(np.concatenate(x) for x in zip(*([kept] if kept else []), *held)), bool(kept), False)
            yield out
            held, fresh = [], 0
    if fresh or kept:
        yield look(tuple(np.concatenate(x) for x in zip(*([kept] if kept else []), *held)), bool(kept), True)[0]


DECIDED, SHOWN, ASKED = 1, 2, 3


def _named(batches: Iterator[pa.RecordBatch]):
    """Of one partition of runs, sorted by key and name: what becomes of each
    one's suffixes. Of a key that goes on, one row a name is held at most; once a
    run that occurs once has stood under it beside another, its latest name only."""
    mixed = False  # the key held has such a run

    def look(rows, kept, last):
        nonlocal mixed
        g, t, k1, k2, meta = rows
        head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])]))
        size = np.diff(np.append(head, len(g)))
        twice = np.add.reduceat(meta & 3, head) > 1
        which = np.cumsum(np.concatenate([[True], g[head][1:] != g[head][:-1]])) - 1
        some = (np.bincount(which, weights=~twice)[which] > 0) & (np.bincount(which)[which] > 1)
        if kept and mixed:
            some |= which == 0
        open_ = np.zeros(len(head), bool)  # names that wait
        if not last:
            own = which == which[-1]
            mixed = bool((kept and mixed and which[-1] == 0) or (~twice[own][:-1]).any())  # the latest name may recur
            some[own] = mixed
            open_ = np.zeros(len(head), bool) if mixed else own
            open_[-1] = True
        flag = np.repeat(np.where(twice, DECIDED, np.where(some, ASKED, 0)), size)
        flag[head[twice & some]] = SHOWN
        flag[head[open_]] = 0
        wait = head[open_]
        keep = (g[wait], t[wait], k1[wait], k2[wait], (meta[wait] & ~3) | np.where(twice[open_], 2, meta[wait] & 3).astype(meta.dtype))
        told = flag > 0
        return (k1[told], k2[told], (meta[told] >> 2) * 4 + flag[told]), None if last else keep

    for out in _sorted_rows(batches, look, lambda meta: (meta & 3) == 0):
        k1, k2, meta = out if len(out) == 3 else (out[2], out[3], (out[4] >> 2) * 4 + DECIDED)
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(meta.astype(np.int32))], ["k1", "k2", "meta"])


def _spread(l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All positions of the closed intervals."""
    n = r - l + 1
    return np.repeat(l - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(l) else np.empty(0, np.int64)


def _merge(l: np.ndarray, r: np.ndarray, length: int):
    """Union of the byte ranges [l, r + length) as starts and ends, in order."""
    order = np.argsort(l, kind="stable")
    a, b = l[order], np.maximum.accumulate(r[order] + length) if len(l) else r
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.empty(0, np.int64)
    return a[new], b[np.append(new[1:], len(a)) - 1] if len(a) else b


def _kept(raw: np.ndarray, l: np.ndarray, r: np.ndarray, length: int):
    """Bytes and maximal runs removed, and the bytes kept."""
    a, b = _merge(l, r, length)
    cuts = zip([0, *b.tolist()], [*a.tolist(), len(raw)])
    return int((b - a).sum()), len(a), b"".join(raw[i:j].tobytes() for i, j in cuts)


def _applied(batches: Iterator[pa.RecordBatch], length: int):
    """Texts with what became of their runs: done ones with the bytes kept,
    those with suffixes to merge with the text (compressed), the decided
    runs, and the runs to show or ask about."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        told = batch.column(3)
        for at, buf, b in _blocks(batch, 2, length):
            rows = len(b.offs) - 1
            first = np.searchsorted(b.row, np.arange(rows), "left")
            out = []
            for i in range(rows):
                meta = np.unique(told[at + i].values.to_numpy(zero_copy_only=False))
                run, flag = first[i] + (meta >> 2), meta & 3
                lo, raw = b.offs[i], buf[b.offs[i] : b.offs[i + 1]]
                l, r = b.l[run] - lo, b.r[run] - lo
                done = flag != ASKED
                show = flag != DECIDED
                ask = None if done.all() else np.stack([l[done], r[done]]).astype(np.int32).tobytes()
                res = _kept(raw, l, r, length) if ask is None else (None, None, None)
                more = np.stack([l[show], r[show], ~done[show]]).astype(np.int32).tobytes() if show.any() else None
                out.append((*res, squeeze.compress(raw.tobytes()) if show.any() else None, ask, more))
            n, s, kept, z, decided, show = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array(n, pa.int64()), pa.array(s, pa.int64())]
                + [pa.array(x, pa.binary()) for x in (kept, z, decided, show)],
                ["k1", "k2", "n_removed", "n_spans", "kept", "z", "decided", "show"],
            )


SUFFIXES = 400_000  # suffixes of a task that are settled together


def _suffixes(batches: Iterator[pa.RecordBatch], length: int):
    """(w, v: names of 200 bytes, k1, k2, meta = position * 8 + occurrences
    * 2 + asked); what recurs among those that the task holds at that time is
    answered directly (w = k1)."""
    part, n = [], 0

    def settled():
        w, v, k1, k2, at, ask = (np.concatenate(x) for x in zip(*part))
        first, count = _settle(w, v)
        # the first stands for all; if it recurs here, it and the others are answered now
        more = (count > 1) & (ask > 0)
        rows = [(as_long(w[first]), v[first], k1[first], k2[first], at[first] * 8 + count[first] * 2 + (ask[first] * (count[first] < 2)))]
        rows.append((k1[more], v[more], k1[more], k2[more], at[more] * 8))
        w, v, k1, k2, meta = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (w.astype(np.int64), v.astype(np.int32), k1, k2.astype(np.int32), meta.astype(np.int64))], ["w", "v", "k1", "k2", "meta"])

    back = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            raw = np.frombuffer(back.decompress(batch.column(2)[i].as_py(), max_output_size=1 << 31), np.uint8)
            l, r, ask = np.frombuffer(batch.column(3)[i].as_py(), np.int32).reshape(3, -1).astype(np.int64)
            own = [batch.column(c)[i].as_py() for c in (0, 1)]
            for lo in range(0, len(raw), SEGMENT):
                here = (l >= lo) & (l < lo + SEGMENT)
                if not here.any():
                    continue
                seg = raw[lo : lo + SEGMENT + 3 * length]  # a run starts in the segment and is at most half of ``length`` long
                places, asked = _spread(l[here] - lo, r[here] - lo), np.repeat(ask[here], (r - l + 1)[here])
                sums = np.zeros(len(seg) + 1, U64)
                np.cumsum(_BYTE[seg] * powers(len(seg) + 1)[: len(seg)], out=sums[1:])
                inverse = powers(len(seg) + 1, -1)
                for j in range(0, len(places), SUFFIXES):
                    at = places[j : j + SUFFIXES]
                    name = (sums[at + length] - sums[at]) * inverse[at]
                    half = mix((sums[at + length // 2] - sums[at]) * inverse[at])
                    part.append((mix(name), half & U64(0x7FFFFFFF), *(np.full(len(at), k) for k in own), at + lo, asked[j : j + SUFFIXES]))
                    n += len(at)
                    if n >= SUFFIXES:
                        yield settled()
                        part, n = [], 0
    if n:
        yield settled()


def _merged(batches: Iterator[pa.RecordBatch]):
    """Of one partition of sorted suffixes: asked ones equal to a neighbour. Of
    equal ones that go on, one is held."""

    def look(rows, _, last):
        w, v, k1, k2, meta = rows
        head = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
        n = np.add.reduceat((meta >> 1) & 3, head)
        hit = np.repeat(n > 1, np.diff(np.append(head, len(w)))) & ((meta & 1) > 0)
        i = head[-1:]  # answered if it recurs; else it may still
        keep = (w[i], v[i], k1[i], k2[i], (meta[i] & ~7) | 4 if n[-1] > 1 else meta[i])
        return (k1[hit], k2[hit], meta[hit] >> 3), None if last else keep

    for out in _sorted_rows(batches, look, lambda meta: (meta & 7) == 0):
        k1, k2, at = out if len(out) == 3 else (out[2], out[3], out[4] >> 3)
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(at.astype(np.int32))], ["k1", "k2", "at"])


def _finished(batches: Iterator[pa.RecordBatch], length: int):
    back = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            raw = np.frombuffer(back.decompress(batch.column(2)[i].as_py(), max_output_size=1 << 31), np.uint8)
            l, r = np.frombuffer(batch.column(3)[i].as_py(), np.int32).reshape(2, -1).astype(np.int64)
            told = batch.column(4)[i]
            told = told.values.to_numpy(zero_copy_only=False).astype(np.int64) if told.is_valid else np.empty(0, np.int64)
            out.append(_kept(raw, np.concatenate([l, told]), np.concatenate([r, told]), length))
        n, s, kept = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(kept, pa.binary())], ["k1", "k2", "n_removed", "n_spans", "kept"])


def repeated_bytes(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """(k1, k2: key of a text by ``text_key``, n_removed, n_spans, kept) of
    every distinct text that loses bytes, or might have."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(*text_key(text), text.alias("text")).where(F.octet_length("text") >= length)
    told = (
        keyed.mapInArrow(partial(_sampled, length=length), "g long, t long, k1 long, k2 int, meta int")
        .repartition("g")
        .sortWithinPartitions("g", "t", "k1")
        .mapInArrow(_named, "k1 long, k2 int, meta int")
        .groupBy("k1", "k2")
        .agg(F.collect_set("meta").alias("told"))
    )
    once = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    state = once.join(told, ["k1", "k2"]).mapInArrow(
        partial(_applied, length=length), "k1 long, k2 int, n_removed long, n_spans long, kept binary, z binary, decided binary, show binary"
    )
    state = table(state, "repeats")
    found = (
        state.where("show is not null")
        .select("k1", "k2", "z", "show")
        .mapInArrow(partial(_suffixes, length=length), "w long, v int, k1 long, k2 int, meta long")
        .repartition("w")
        .sortWithinPartitions("w", "v")
        .mapInArrow(_merged, "k1 long, k2 int, at int")
        .groupBy("k1", "k2")
        .agg(F.collect_set("at").alias("at"))
    )
    rest = state.where("decided is not null").select("k1", "k2", "z", "decided").join(found, ["k1", "k2"], "left")
    rest = rest.mapInArrow(partial(_finished, length=length), "k1 long, k2 int, n_removed long, n_spans long, kept binary")
    return state.where("decided is null").select(*rest.columns).unionByName(rest)


def without_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts. A character
    that loses some of its bytes goes as a whole."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = repeated_bytes(docs, length, text_col).where("n_removed > 0")
    valid = F.try_validate_utf8(F.col("kept").cast("string"))
    # stray bytes at the cut edges become U+FFFD and go
    edges = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    keys = text_key(text)
    k1, k2, kept = hidden(docs, "k1", "k2", "kept").values()
    both = docs.withColumns({k1: keys[0], k2: keys[1]}).join(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.coalesce(valid, edges).alias(kept)), [k1, k2], "left")
    cut = F.coalesce(F.col(kept), F.col(f"`{text_col}`"))
    return both.withColumn(text_col, cut).select(*(F.col(f"`{c}`") for c in docs.columns))
