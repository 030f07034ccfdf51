"""Event-time frames.

A trailing frame [t - W, t] is a sum of signed events: a row enters at its time
and leaves just after t + W. Time is cut into slots, ``SLOTS`` a frame. What a
row adds to its own slot and to the starts of the few later ones that it lasts
into is dealt there, and within a slot all is a running sum. No group spans
more than a slot, so a busy instant or key is cut by time, whatever the keys;
work is linear in the rows. Sums are of whole numbers: nothing cancels. So it is
for sums (:func:`sliding_sums`); statistics of a frame's values (:func:`frame_stats`)
run along the rows of a key's bucket of time, and a task holds one frame of them.

Rows are written once to the shared folder, as several steps read them, and
counted there; shuffles are cut into partitions of ``DEALT`` of them, so that a
task holds no more of a larger table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowdetect.sources.shared import stored


def halo(df: DataFrame, width_us: int, ts: str = "ts_us", stretch: int = 1) -> DataFrame:
    """Rows dealt to time buckets of ``stretch`` times the frame's width; those
    in the last ``width_us`` of a bucket also to the next: every trailing frame
    then lies within one bucket, and no keyless window has to order the whole
    table in one task. Columns ``_b`` (bucket) and ``_own`` (the row's home)."""
    whole = width_us * stretch
    home = df.withColumn("_home", F.expr(f"{ts} DIV {whole}L"))
    dealt = home.withColumn("_b", F.explode(F.expr(f"if(({ts} + {width_us}L) DIV {whole}L > _home, array(_home, _home + 1), array(_home))")))
    return dealt.withColumn("_own", F.col("_b") == F.col("_home")).drop("_home")


def trailing(width_us: int, *keys: str, ts: str = "ts_us"):
    """Frame [t - width, t], peers of equal time included."""
    return Window.partitionBy(*keys).orderBy(ts).rangeBetween(-width_us, 0)


def last_rows(n: int, *keys: str, order: tuple[str, ...] = ("ts_us", "event_id")):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)


SLOTS = 2  # slots a frame
STRETCH = 8  # frames a bucket of time
CHUNK = 50_000  # rows measured at a time
DEALT = 50_000  # rows of a partition of a shuffle; each makes a few changes
BITS = 1 << 30  # fractions in which c * log2(c) is summed; exact to 2 ** 28 rows a frame


def _slot(t: str, slot_us: int) -> str:
    return f"(({t} - pmod({t}, {slot_us}L)) DIV {slot_us}L)"


def _keyed(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """``df`` with ``_g`` (its keys, never null itself) and ``_t``."""
    return df.withColumns({"_g": F.struct(*keys) if keys else F.struct(F.lit(0)), "_t": F.col(ts).cast("long")})


def _once(rows: DataFrame, keys: list[str], ts: str) -> tuple[DataFrame, int]:
    """``rows`` with ``_g`` and ``_t`` from the shared folder, and how many
    partitions they fill. Read from a file, ``_g`` is no constant to Spark, which
    would drop it from some steps and shuffle anew between them."""
    rows = stored(_keyed(rows, keys, ts), "frames")
    return rows, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // DEALT))


def sliding_sums(rows: DataFrame, keys: list[str], width_us: int, sums: dict[str, Column], ts: str = "ts_us") -> DataFrame:
    """Adds sums of whole numbers (name: column) over the frame [t - width, t]
    of every row, by ``keys``, peers of equal time included. A row travels with
    its own entry, so ``rows`` are computed and dealt once."""
    slot = width_us // SLOTS
    held, parts = _once(rows, keys, ts)
    d = held.withColumns({f"_v{i}": c for i, c in enumerate(sums.values())} | {"_sa": F.expr(_slot(f"cast({ts} AS bigint)", slot)), "_sb": F.expr(_slot(f"(cast({ts} AS bigint) + {width_us + 1})", slot))})
    row = "struct({})".format(", ".join(f"`{c}`" for c in rows.columns))
    none = f"if(true, NULL, {row})"
    later = ", ".join(f"struct(if(_sa + {j} <= _sb, _sa + {j}, NULL) AS _s, (_sa + {j}) * {slot} AS _at, 1 AS _w, {none} AS _row)" for j in range(1, SLOTS + 2))
    each = F.expr(f"inline(array(struct(_sa AS _s, _t AS _at, 1 AS _w, {row} AS _row), struct(_sb AS _s, _t + {width_us + 1} AS _at, -1 AS _w, {none} AS _row), {later}))")
    d = d.select("_g", *(f"_v{i}" for i in range(len(sums))), each).where("_s IS NOT NULL").repartition(parts, "_g", "_s")
    w = Window.partitionBy("_g", "_s").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    d = d.select("_row", *(F.sum(F.col(f"_v{i}") * F.col("_w")).over(w).alias(n) for i, n in enumerate(sums)))
    return d.where("_row IS NOT NULL").select("_row.*", *sums)


def frame_stats(rows: DataFrame, keys: list[str], width_us: int, values: list[str], span: str | None = None, ts: str = "ts_us", points: DataFrame | None = None) -> DataFrame:
    """Statistics of the frame [t - width, t] of every row, by ``keys``: ``_n``
    rows, ``_mean`` and ``_std`` of the gaps in seconds, for each of ``values``
    the number of distinct ones ``_d_`` and their entropy ``_h_``, and the range
    ``_span`` of one. Peers of equal time are in each other's frames. A null
    value counts as a value, and as 0 in ``_span``.

    ``points`` (keys, ts and any other columns): the frames that end there are
    measured, and the points whose frame has rows are returned with them.
    ``width_us`` is a multiple of ``SLOTS``.

    Rows are dealt to a key's time buckets (:func:`halo`) and sorted there; a
    task reads them in order of time and holds one frame (:func:`_measured`)."""
    if width_us % SLOTS or not values:
        raise ValueError(f"a frame takes a multiple of {SLOTS} microseconds and at least one value")
    base, parts = _once(rows, keys, ts)
    given = rows if points is None else points
    kinds = {f"_v{i}": F.col(v) for i, v in enumerate(values)} | ({"_v": F.coalesce(F.col(span), F.lit(0)).cast("long")} if span else {})
    whole = F.struct(*(F.col(f"`{c}`") for c in given.columns))

    def dealt(d: DataFrame, x: int, own: Column, row: Column, given: dict[str, Column]) -> DataFrame:
        return d.select(F.to_json("_g").alias("_g"), "_b", "_t", F.lit(x).alias("_x"), own.alias("_own"), row.alias("_row"), *(c.alias(n) for n, c in given.items()))

    near = halo(base.where("_t IS NOT NULL"), width_us, "_t", STRETCH)
    if points is None:
        met = dealt(near, 1, F.col("_own"), F.when(F.col("_own"), whole), kinds)
    else:
        at = _keyed(points, keys, ts).where("_t IS NOT NULL").withColumn("_b", F.expr(f"_t DIV {width_us * STRETCH}L"))
        none = F.lit(None).cast(at.select(whole.alias("r")).schema["r"].dataType)
        met = dealt(near, 1, F.lit(False), none, kinds)
        met = met.unionByName(dealt(at, 0, F.lit(True), whole, {n: F.lit(None).cast(met.schema[n].dataType) for n in kinds}))
    sums = ["_n", "_q", "_first", "_last", *(f"_{p}{i}" for i in range(len(values)) for p in "df"), *["_hi", "_lo"] * bool(span)]
    met = met.repartition(parts, "_g", "_b").sortWithinPartitions("_g", "_b", "_t")
    schema = StructType([met.schema["_row"], *(StructField(c, LongType()) for c in sums)])
    held = met.mapInArrow(lambda batches: _measured(batches, width_us, len(values), bool(span)), schema)
    held = held.selectExpr("*", "_n - 1 AS _k", "_last - _first AS _w")
    spread = "greatest(cast(_k AS decimal(20,0)) * cast(_q AS decimal(18,0)) - cast(_w AS decimal(18,0)) * _w, 0)"
    # of two gaps, whose deviation is half their difference, in the order of a plain loop over seconds
    a, b = (f"((_w {sign} round(sqrt(cast(2 * _q - _w * _w AS double)))) / 2 / 1e6D)" for sign in "+-")
    two = f"sqrt((power({a} - ({a} + {b}) / 2, 2) + power({b} - ({a} + {b}) / 2, 2)) / 2)"
    return held.selectExpr(
        "_row.*", "_n", "if(_k > 0, _w / _k / 1e6D, 0D) AS _mean", f"CASE WHEN _k = 2 THEN {two} WHEN _k > 0 THEN sqrt(cast({spread} AS double)) / _k / 1e6D ELSE 0D END AS _std",
        *(e for i, v in enumerate(values) for e in (f"cast(_d{i} AS int) AS `_d_{v}`", f"if(_d{i} > 1, greatest(log2(_n) - _f{i} / {BITS}D / _n, 0D), 0D) AS `_h_{v}`")),
        *["cast(_hi - _lo AS int) AS _span"] * bool(span),
    )


def _measured(batches: Iterator[pa.RecordBatch], width_us: int, kinds: int, span: bool, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Whole-number sums over the frames of rows sorted by group and time. Rows
    are taken ``chunk`` at a time, and as many as are held at least; the latest
    instant, which may go on, and its frame are held for the next ones."""
    held, fresh, done = [], 0, 0
    for batch in batches:
        held.append(batch)
        fresh += batch.num_rows
        if fresh >= max(chunk, done):
            t = pa.Table.from_batches(held).combine_chunks()
            upto, since = _latest(t, width_us)
            yield from _sums(t.slice(0, upto), done, width_us, kinds, span)
            held, fresh, done = t.slice(since).to_batches(), t.num_rows - upto, upto - since
    if fresh:
        yield from _sums(pa.Table.from_batches(held).combine_chunks(), done, width_us, kinds, span)


def _groups(t: pa.Table) -> np.ndarray:
    """Where a new group begins: true at its first row."""
    g, b = _codes(t["_g"]), t["_b"].to_numpy()
    return np.append(True, (g[1:] != g[:-1]) | (b[1:] != b[:-1]))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value; null is one."""
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _latest(t: pa.Table, width_us: int) -> tuple[int, int]:
    """Where the latest instant of the last group begins, and where its frame does."""
    first, at = int(np.flatnonzero(_groups(t))[-1]), t["_t"].to_numpy()
    own = at[first:]
    return first + int(np.searchsorted(own, own[-1])), first + int(np.searchsorted(own, own[-1] - width_us))


def _sums(t: pa.Table, done: int, width_us: int, kinds: int, span: bool) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of ``t`` from ``done`` on that are asked for."""
    at, x = t["_t"].to_numpy(), t["_x"].to_numpy() == 1
    new = _groups(t) if len(at) else np.zeros(0, bool)
    own = t["_own"].to_numpy() & (np.arange(len(at)) >= done)
    asked = np.flatnonzero(own)
    if not len(asked):
        return
    group = np.cumsum(new) - 1
    begin = at[new]
    far = int((at - begin[group]).max()) + 2 * width_us + 2  # no frame reaches into another group
    line = group * far + (at - begin[group])
    e, et, eg = line[x], at[x], group[x]  # the rows that count, in order
    n = len(e)
    if not n:
        return
    lo, hi = np.searchsorted(e, line[asked] - width_us), np.searchsorted(e, line[asked], "right")
    some = lo < hi
    asked, lo, hi = asked[some], lo[some], hi[some]
    same = np.append(False, eg[1:] == eg[:-1])
    gap = np.where(same, np.append(0, np.diff(et)), 0)
    squares = np.cumsum(gap * gap)  # may run over; differences are right
    out = {"_n": hi - lo, "_q": squares[hi - 1] - squares[lo], "_first": et[lo], "_last": et[hi - 1]}
    start = np.searchsorted(eg, group[asked])  # the first row held of the group
    since, until = np.searchsorted(e, e - width_us), np.searchsorted(e, e + width_us, "right")
    upto = lambda v: np.append(0, np.cumsum(v))
    for i in range(kinds):
        code = _codes(t[f"_v{i}"])[x] * (n + 1)
        order = np.argsort(code, kind="stable")
        place = (code + np.arange(n))[order]  # equal values in order of time
        j = np.arange(n)
        y_in = np.empty(n, np.int64)  # how many stand after a row enters, and before it leaves
        y_out = np.empty(n, np.int64)
        y_in[order] = j - np.searchsorted(place, (code + since)[order]) + 1
        y_out[order] = np.searchsorted(place, (code + until)[order]) - j
        share = np.arange(max(int(y_in.max()), int(y_out.max())) + 1, dtype=float)
        share[2:] *= np.log2(share[2:])
        share[:2] = 0
        share = np.floor(share * BITS + 0.5).astype(np.int64)
        for name, enters, leaves in ((f"_d{i}", y_in == 1, y_out == 1), (f"_f{i}", share[y_in] - share[y_in - 1], share[y_out] - share[y_out - 1])):
            ins, outs = upto(enters), upto(leaves)
            out[name] = ins[hi] - ins[start] - (outs[lo] - outs[start])
    if span:
        v = t["_v"].to_numpy()[x].astype(np.int64)
        out["_hi"], out["_lo"] = _extremes(v, lo, hi, np.maximum), _extremes(v, lo, hi, np.minimum)
    columns = [t["_row"].take(pa.array(asked)), *(pa.chunked_array([pa.array(np.asarray(c, np.int64))]) for c in out.values())]
    yield from pa.Table.from_arrays(columns, names=["_row", *out]).to_batches()


def _extremes(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, of) -> np.ndarray:
    """Of v[lo:hi], from those of two runs of a power of two that cover it."""
    power = np.frexp(hi - lo)[1] - 1
    out, run = np.empty(len(lo), np.int64), v
    for p in range(int(power.max(initial=0)) + 1):
        here = power == p
        out[here] = of(run[lo[here]], run[hi[here] - (1 << p)])
        run = of(run[: max(len(run) - (1 << p), 0)], run[1 << p :])
    return out
