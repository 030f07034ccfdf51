"""Hard-negative mining over an inverted multi-index, exact by certificate.

Two codebooks, one for each half of the dimensions, are fitted to a bounded
sample (``SAMPLE`` rows, ``SAMPLE_BYTES``); every row is put into the cell of
its nearest entry in each half. For an anchor q, no row of cell (i, j) scores
above ``q1.c1[i] + |q1| r1[i] + q2.c2[j] + |q2| r2[j]``, r being the radius
(largest distance of a member) of an entry. A multi-sequence heap visits the
cells in falling order of that sum. A window of scores is certified once its
k-th best row beats the bound of the next cell, or that bound lies below it.
Results are therefore those of a full scan, whatever the sample was; the index
saves the cells below the certificate.

Searches run in rounds: each anchor visits cells worth ``FIRST`` rows, then
``GROW`` times as many, until its windows are certified. Cells are packed into
shelves of ``SHELF`` rows (a larger cell fills several, so a hot one is cut),
and anchors into blocks; a shelf and a block of the anchors that visit it meet
in one group of bounded size. What Python holds on the driver is bounded: the
sample, the codebooks (``MOST`` entries a half) and the counts of their cells.

Edge cases: rows with a null label, a null vector or a null or non-finite
component take no part. Shorter vectors count as ending in zeros. A null id is
no anchor and comes last among ties. Rows that repeat an id are rows of their
own. Entries and scores beyond the range of a long are held at its ends.
Windows of a negative positive score are empty, those of zero hold zero. Empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import Tables, table

SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
MOST = 256  # codebook entries a half
CELL = 64  # rows a cell holds on average, while the codebooks may grow
SHELF, BLOCK = 2048, 2048
FIRST, GROW = 1 << 14, 16
LONG = 1 << 63

ANCHOR = "a long, id long, label long, v array<long>, lo array<long>, hi array<long>"
VISIT = f"{ANCHOR}, shelf long, cells array<int>, next double, skip long"
FOUND = "a long, w int, score long, id long, key long"


class Index(NamedTuple):
    """Codebooks (entries by dimensions of the half), radii, and of each cell
    the number of rows, its first shelf and its number of shelves."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    shelf: np.ndarray
    slices: np.ndarray


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list<int64> column as rows by ``dims``; short rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) * dims == len(flat):
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(axis=1) - 2 * (x @ book.T), axis=1)


def codebook(x: np.ndarray, size: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from seeded sample rows; an entry without rows stays.
    Without any rows, one entry of zeros."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    book = x[rng.permutation(len(x))[:size]].copy()
    for _ in range(rounds):
        own = nearest(x, book)
        n = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def _assigned(batches: Iterator[pa.RecordBatch], books, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = halves(matrix(batch.column("v"), dims))
        own = [nearest(h, b) for h, b in zip(x, books)]
        far = [np.sqrt(((h - b[o]) ** 2).sum(axis=1)) for h, b, o in zip(x, books, own)]
        cell = own[0] * len(books[1]) + own[1]
        extra = [pa.array(cell.astype(np.int32)), *(pa.array(o.astype(np.int32)) for o in own), *map(pa.array, far)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cell", "i", "j", "r1", "r2"])


def usable(rows: DataFrame, scale: float, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(key, id, label, v: floor(scale * x)) of the rows that take part."""
    x, label = F.col(f"`{vec_col}`").cast("array<double>"), F.col(f"`{label_col}`")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.where(label.isNotNull() & x.isNotNull() & fine)
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return kept.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))


def build(rows: DataFrame, tables: Tables, seed: int = 7) -> tuple[DataFrame, Index, int]:
    """(rows with their cells and shelves, index, dimensions)."""
    spark = rows.sparkSession
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = dims or 0
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(dims, 1))))
    part = math.ceil(min(1.0, 1.2 * most / max(n, 1)) * (1 << 20))
    sample = rows.where(F.expr(f"pmod(xxhash64(key), {1 << 20}) < {part}")).select("v").limit(most).toArrow()
    size = max(1, min(MOST, round(math.sqrt(n / CELL))))
    books = tuple(codebook(h, size, seed) for h in halves(matrix(sample.column("v"), dims)))
    schema = "key long, id long, label long, v array<long>, cell int, i int, j int, r1 double, r2 double"
    indexed = tables.add(rows.mapInArrow(partial(_assigned, books=books, dims=dims), schema), "cells")
    radii = []
    for entry, far, book in (("i", "r1", books[0]), ("j", "r2", books[1])):
        r = np.zeros(len(book))
        for own, most_far in indexed.groupBy(entry).agg(F.max(far)).collect():  # one row an entry
            r[own] = most_far
        radii.append(r)
    count = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for cell, held in indexed.groupBy("cell").count().collect():  # one row a cell
        count[cell] = held
    slices = np.maximum(1, -(-count // SHELF))
    shelf, at, full = np.zeros_like(count), 0, 0
    for cell in np.flatnonzero(count):
        if full and full + count[cell] > SHELF:
            at, full = at + 1, 0
        shelf[cell] = at
        full += count[cell]
        if slices[cell] > 1:
            at, full = at + int(slices[cell]), 0
    placed = [(int(c), int(shelf[c]), int(slices[c])) for c in np.flatnonzero(count)]
    places = F.broadcast(spark.createDataFrame(placed, "cell int, first long, slices long"))  # at most MOST * MOST rows
    dealt = indexed.join(places, "cell").select("key", "id", "label", "v", "cell", (F.col("first") + F.expr("pmod(xxhash64(key), slices)")).alias("shelf"))
    return dealt, Index(books, tuple(radii), count, shelf, slices), dims


def multi_sequence(u1: np.ndarray, u2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs of entries in falling order of ``u1[i] + u2[j]``."""
    o1, o2 = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
    s1, s2 = u1[o1].tolist(), u2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap = [(-(s1[0] + s2[0]), 0, 0)] if s1 and s2 else []
    while heap:
        low, i, j = heappop(heap)
        yield -low, o1[i], o2[j]
        if j + 1 < len(s2):
            heappush(heap, (-(s1[i] + s2[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heappush(heap, (-(s1[i + 1] + s2[0]), i + 1, 0))


def bounds(q: np.ndarray, index: Index) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each half the (upper, lower) bounds of its entries' scores, widened
    by far more than they can have lost to rounding."""
    out = []
    for h, book, radius in zip(halves(q[None, :]), index.books, index.radii):
        size = math.sqrt(float((h * h).sum()))
        middle, reach = book @ h[0], size * radius
        slack = 1e-9 * (np.abs(middle) + reach + size * np.sqrt((book * book).sum(axis=1))) + 1e-9
        out.append((middle + reach + slack, middle - reach - slack))
    return out


def _visits(batches: Iterator[pa.RecordBatch], index: Index, dims: int, budget: int) -> Iterator[pa.RecordBatch]:
    """For every anchor the cells it visits next, by shelf, and one row (shelf
    -1) with the number of cells done and the bound of the one after them."""
    wide, schema = len(index.books[1]), None
    for batch in batches:
        vectors = matrix(batch.column("v"), dims)
        for at, row in enumerate(batch.select(["lo", "hi", "skip"]).to_pylist()):
            open_ = [(a, b) for a, b in zip(row["lo"], row["hi"]) if a <= b]
            floor, top = (min(a for a, _ in open_), max(b for _, b in open_)) if open_ else (math.inf, -math.inf)
            (u1, l1), (u2, l2) = bounds(vectors[at], index)
            shelves: dict[int, list[int]] = {}
            seen, skip, after = 0, 0, -math.inf
            for bound, i, j in multi_sequence(u1, u2):
                cell = i * wide + j
                held = int(index.rows[cell])
                if bound < floor:
                    break
                if skip >= row["skip"] and held:
                    if seen >= budget:
                        after = bound
                        break
                    if l1[i] + l2[j] <= top:
                        seen += held
                        for s in range(int(index.shelf[cell]), int(index.shelf[cell] + index.slices[cell])):
                            shelves.setdefault(s, []).append(cell)
                skip += 1
            own = batch.slice(at, 1).select(["a", "id", "label", "v", "lo", "hi"])
            n = len(shelves) + 1
            columns = [c.take(pa.array(np.zeros(n, np.int64))) for c in own.columns]
            columns += [pa.array([*shelves, -1], pa.int64()), pa.array([*shelves.values(), []], pa.list_(pa.int32()))]
            columns += [pa.array([after] * n, pa.float64()), pa.array([skip] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own.schema.names, "shelf", "cells", "next", "skip"])


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the ends of a long."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    exact = [[sum(a * b for a, b in zip(u, w)) for w in x.tolist()] for u in q.tolist()]
    return np.array([[max(-LONG, min(LONG - 1, s)) for s in row] for row in exact], np.int64).reshape(len(q), len(x))


def best_of(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of positions ``at``, those of the ``k`` highest scores; earlier first among ties."""
    s = scores[at]
    if len(at) > k:
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = scores[at]
    return at[np.argsort(-s, kind="stable")[:k]]


def _meet(visits: pa.Table, rows: pa.Table, dims: int, k: int, same: bool) -> pa.Table:
    """The ``k`` best rows of a shelf for each window of the anchors that visit it."""
    names = ["a", "w", "score", "id", "key"]
    out: list[list] = [[] for _ in names]
    if len(visits) and len(rows):
        rows = rows.sort_by([("id", "ascending"), ("key", "ascending")])  # nulls last
        x, ids = matrix(rows.column("v"), dims), rows.column("id").to_pylist()
        label, key = rows.column("label").to_numpy(), rows.column("key").to_numpy()
        cells, of = np.unique(rows.column("cell").to_numpy(), return_inverse=True)
        q = matrix(visits.column("v"), dims)
        anchors = visits.select(["a", "label", "lo", "hi", "cells"]).to_pylist()
        for begin in range(0, len(q), 256):
            scores = inner(q[begin : begin + 256], x)
            for row, s in zip(anchors[begin : begin + 256], scores):
                open_ = np.isin(cells, row["cells"])[of]
                open_ &= (label == row["label"]) & (key != row["a"]) if same else label != row["label"]
                for w, (lo, hi) in enumerate(zip(row["lo"], row["hi"])):
                    for p in best_of(s, np.flatnonzero(open_ & (s >= lo) & (s <= hi)), k).tolist():
                        for to, value in zip(out, (row["a"], w, int(s[p]), ids[p], int(key[p]))):
                            to.append(value)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)


def search(anchors: DataFrame, rows: DataFrame, index: Index, dims: int, k: int, same: bool, tables: Tables, first: int = FIRST) -> DataFrame:
    """(a, w, score, id, key, rank) of the ``k`` best rows within each score
    window (lo[w] to hi[w]) of each anchor (columns ``ANCHOR``), among rows of
    the anchor's label (``same``, itself excepted) or of other labels."""
    name = "same" if same else "other"
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    open_, best, turn = anchors.withColumn("skip", F.lit(0).cast("long")), None, 0
    parts = max(1, math.ceil(anchors.count() / BLOCK))

    def meet(visits: pa.Table, shelf: pa.Table) -> pa.Table:
        return _meet(visits, shelf, dims, k, same)

    while True:
        visits = tables.add(open_.mapInArrow(partial(_visits, index=index, dims=dims, budget=first * GROW**turn), VISIT), f"visits-{name}{turn}")
        going = visits.where("shelf >= 0").select("*", F.expr(f"pmod(xxhash64(a), {parts})").alias("block"))
        met = rows.join(going.select("shelf", F.col("block").alias("of")).distinct(), "shelf")
        found = going.groupBy("shelf", "block").cogroup(met.groupBy("shelf", "of")).applyInArrow(meet, FOUND)
        found = found if best is None else best.drop("rank").union(found)
        best = tables.add(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"best-{name}{turn}")
        # a full window takes no rows below its last one from here on; a certified one takes none
        left = visits.where("shelf = -1 AND next > double('-Infinity')").select("a", "id", "label", "v", "lo", "hi", "skip", "next")
        full = best.groupBy("a", "w").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        windows = left.select("a", "next", F.posexplode(F.arrays_zip("lo", "hi")).alias("w", "s")).join(full, ["a", "w"], "left")
        windows = windows.selectExpr("a", "w", "next", "s.hi AS hi", f"if(n >= {k}, greatest(s.lo, least), s.lo) AS lo", f"coalesce(n >= {k} AND least > next, false) AS sure")
        windows = windows.selectExpr("a", "w", "lo <= hi AND next >= lo AND NOT sure AS wants", "lo", "hi")
        bounds_ = windows.groupBy("a").agg(F.max("wants").alias("wants"), F.sort_array(F.collect_list(F.expr("struct(w, if(wants, lo, 1) AS lo, if(wants, hi, 0) AS hi)"))).alias("s")).where("wants")
        open_ = left.drop("lo", "hi", "next").join(bounds_, "a").select("a", "id", "label", "v", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "skip")
        open_ = tables.add(open_, f"open-{name}{turn}")
        if open_.isEmpty():
            return best
        turn += 1


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", first: int = FIRST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). Anchors are the rows whose ``id`` satisfies ``anchor`` (a
    condition on column ``id``); scores are inner products of floor(scale * x).
    A negative's score is ``low`` to ``high`` percent of the positive's. Runs at
    once; what it wrote on the way is deleted, but for the result."""
    tables = Tables(rows.sparkSession)
    held = tables.add(usable(rows, scale, id_col, vec_col, label_col), "rows")
    dealt, index, dims = build(held, tables)
    dealt = tables.add(dealt, "shelves")
    ends = [F.array(F.lit(x)).alias(n) for n, x in (("lo", -LONG), ("hi", LONG - 1))]
    anchors = tables.add(held.where(anchor).select(F.col("key").alias("a"), "id", "label", "v", *ends), "anchors")
    same = search(anchors, dealt, index, dims, positives, True, tables, first)
    share = lambda percent, rounded: F.expr(f"cast({rounded}(cast(score AS decimal(20,0)) * {percent} / 100) AS bigint)")
    pairs = same.select("a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), share(low, "ceil").alias("lo"), share(high, "floor").alias("hi"))
    pairs = tables.add(pairs, "positives")
    lists = pairs.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("w", "lo", "hi"))).alias("s"))
    wanted = anchors.drop("lo", "hi").join(lists, "a").select("a", "id", "label", "v", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    other = search(tables.add(wanted, "wanted"), dealt, index, dims, negatives, False, tables, first)
    named = other.select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["a", "w"])
    out = named.join(anchors.select("a", F.col("id").alias("anchor_id")), "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    done = table(out, "hard_negatives")
    tables.drop()
    return done
