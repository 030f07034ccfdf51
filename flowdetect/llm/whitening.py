"""Embedding whitening by a Jacobi-Davidson eigensolver on distributed products.

Vectors become whole numbers x = floor(scale * c) + offset. The fit list holds
each distinct x once (n of them, sums S by dimension); its covariance is never
formed: a product with a block of vectors is one Spark job that sums
``y (y . block)`` over the centred y = (n * x - S) / n of all partitions, a row for
each dimension. The driver holds blocks of dimensions by a few tens of columns.

The solver keeps a search space of orthonormal vectors. Each turn takes the
Rayleigh-Ritz pairs of the space, locks the leading ones whose residuals have
reached double precision, and solves for each of the others the correction
equation, projected off the locked and current vectors, by a few steps of
MINRES; all equations share one distributed product a step. The solutions
extend the space, which restarts from its Ritz vectors when full.

Edge cases: rows with a null vector or a null or non-finite component are
dropped. Shorter vectors count as ending in zeros. Entries beyond the range of
a long are held at its ends; a deviation beyond it is null. Only components
with a variance above rounding are given, so there are fewer of them than asked for where the fit
list has few vectors or dimensions, and none where it has one. Null or repeated
ids and extra columns pass through; columns that clash with the added names are replaced.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.llm.common import Tables, hidden, table, without

ADDED = ("n", "deviation", "whitened", "explained", "identity_error")
EPS = np.finfo(np.float64).eps
GUARD = 4  # pairs sought beyond those asked for, so that none is passed over
INNER = 5  # steps of MINRES a turn, at most
TURNS = 200
LONG = 1 << 63
CHUNK = 1 << 21  # numbers centred at a time


class Centre(NamedTuple):
    n: int
    sums: list[int]


class Whitener(NamedTuple):
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    explained: np.ndarray
    identity_error: float


def rows_of(column: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """Runs of rows of a binary column of packed longs."""
    step = max(1, CHUNK // max(dims, 1))
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        yield np.frombuffer(b"".join(part.to_pylist()), np.int64).reshape(len(part), dims)


def differences(x: np.ndarray, centre: Centre) -> np.ndarray:
    """n * x - S, exact: longs, or Python numbers where those would not do."""
    reach = centre.n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, centre.sums), default=0)
    if reach < 1 << 61:
        return x * centre.n - np.array(centre.sums, np.int64)
    return x.astype(object) * centre.n - np.array(centre.sums, object)


def centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    return differences(x, centre).astype(np.float64) / centre.n


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(0)
        flat, ends = x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))
        rows = [part.tobytes() for part in np.split(flat, ends[:-1])] if len(x) else []
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    total, n = [0] * dims, 0
    for batch in batches:
        for x in rows_of(batch.column("x"), dims):
            n += len(x)
            low = (x & 0xFFFFFFFF).sum(axis=0)
            high = (x >> 32).sum(axis=0)
            total = [t + (int(h) << 32) + int(lo) for t, h, lo in zip(total, high, low)]
    values = pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims, dtype=np.int32)), values], names=["i", "s"])


def _summed(batches: Iterator[pa.RecordBatch], centre: Centre, block: np.ndarray, of: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (i, one column for each of the block's) of the sum of ``of(y, block)``."""
    total = None
    for batch in batches:
        for x in rows_of(batch.column("x"), len(block)):
            part = of(centred(x, centre), block)
            total = part if total is None else total + part
    if total is not None:
        columns = [pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(c) for c in total.T)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", *(f"p{j}" for j in range(total.shape[1]))])


def _product(y: np.ndarray, block: np.ndarray) -> np.ndarray:
    return y.T @ (y @ block)


def _moments(y: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sums of the products of whitened columns, of these columns, and of |y|^2."""
    w = y @ block
    below = np.zeros((2, block.shape[1]))
    below[0], below[1] = w.sum(axis=0), (y * y).sum()
    return np.vstack([w.T @ w, below])


def summed(fit: DataFrame, centre: Centre, block: np.ndarray, of: Callable, height: int) -> np.ndarray:
    """The sum over the fit list, by partial sums of each partition."""
    names = [f"p{j}" for j in range(block.shape[1])]
    parts = fit.mapInArrow(partial(_summed, centre=centre, block=block, of=of), "i int, " + ", ".join(f"{p} double" for p in names))
    got = parts.groupBy("i").agg(*(F.sum(p).alias(p) for p in names)).toArrow()
    out = np.zeros((height, len(names)))
    out[got.column("i").to_numpy()] = np.column_stack([got.column(p).to_numpy() for p in names])
    return out


def orthonormal(t: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``t``'s columns add to those of ``others``."""
    base = np.hstack(others) if others else np.zeros((len(t), 0))
    t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        t = t - base @ (base.T @ t)
    out = np.zeros((len(t), 0))
    for column in t.T:
        size = np.linalg.norm(column)
        for _ in range(2):
            column = column - out @ (out.T @ column) - base @ (base.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10 * max(size, 1e-6) and left > 1e-12 and base.shape[1] + out.shape[1] < len(t):
            out = np.column_stack([out, column / left])
    return out


def minres(apply: Callable, rhs: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Solves ``apply(x) = rhs``, columns on their own, until all residuals are
    below ``share`` of the start or ``steps`` are done; one ``apply`` a step."""
    beta = np.linalg.norm(rhs, axis=0)
    start, eta = beta.copy(), beta.copy()
    divided = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=np.abs(b) > 0)
    v, v_old = divided(rhs, np.broadcast_to(beta, rhs.shape)), np.zeros_like(rhs)
    w, w_old, x = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        after[after <= EPS * np.abs(alpha)] = 0
        delta, second, third = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        first = np.hypot(delta, after)
        c_old, c, s_old, s = c, divided(delta, first), s, divided(after, first)
        w, w_old = divided(v - third * w_old - second * w, np.broadcast_to(first, v.shape)), w
        x = x + c * eta * w
        eta = -s * eta
        v, v_old, beta = divided(p, np.broadcast_to(after, p.shape)), v, after
        if (np.abs(eta) <= share * start).all():
            break
    return x


def jacobi_davidson(product: Callable, dims: int, k: int, seed: int = 5, inner: int = INNER, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residual norms) of the ``k`` largest eigenpairs of a
    symmetric positive operator that is known by its products with blocks."""
    k = min(k, dims)
    want = min(dims, k + GUARD)
    most = min(dims, max(most or 4 * want, 2 * want))
    rng = np.random.default_rng(seed)
    space = orthonormal(rng.standard_normal((dims, want)))
    image = product(space)
    locked, values, residuals = np.zeros((dims, 0)), [], []
    for _ in range(TURNS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max([*values, *theta[:1], 0.0])
        left = image - space * theta
        left -= locked @ (locked.T @ left)
        size = np.linalg.norm(left, axis=0)
        done = 0
        while done < min(len(theta), want - len(values)) and size[done] <= 64 * EPS * np.sqrt(dims) * top:
            done += 1
        locked, values, residuals = np.hstack([locked, space[:, :done]]), [*values, *theta[:done]], [*residuals, *size[:done]]
        space, image, theta, left, size = space[:, done:], image[:, done:], theta[done:], left[:, done:], size[done:]
        need = want - len(values)
        if need <= 0:
            break
        if locked.shape[1] + space.shape[1] + need > most + len(values) and space.shape[1] > need:
            space, image = space[:, :need], image[:, :need]
        off = np.hstack([locked, space[:, :need]])
        shift = theta[:need]

        def projected(t: np.ndarray, off=off, shift=shift) -> np.ndarray:
            t = t - off @ (off.T @ t)
            t = product(t) - shift * t
            return t - off @ (off.T @ t)

        rhs = left[:, :need]
        fix = minres(projected, -(rhs - off @ (off.T @ rhs)), inner, 0.05)
        new = orthonormal(fix, locked, space)
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((dims, need)), locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"no convergence in {TURNS} turns")
    order = np.argsort(-np.array(values), kind="stable")[:k]
    return np.array(values)[order], locked[:, order], np.array(residuals)[order]


def fit_whitener(fit: DataFrame, dims: int, k: int, tables: Tables) -> Whitener:
    """``fit``: (x binary), distinct rows of ``dims`` packed longs."""
    got = dict(fit.mapInArrow(partial(_sums, dims=dims), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s")).collect())  # one row a dimension
    centre = Centre(int(got.get(-1, 0)), [int(got.get(i, 0)) for i in range(dims)])
    none = np.zeros(0)
    if centre.n < 2 or not dims:
        return Whitener(centre, none, np.zeros((dims, 0)), none, none, 0.0)
    values, vectors, residuals = jacobi_davidson(lambda block: summed(fit, centre, block, _product, dims) / centre.n, dims, k)
    kept = values > 64 * dims * EPS * max(values[0], 0.0)
    values, vectors, residuals = values[kept], vectors[:, kept], residuals[kept]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    vectors = vectors * sign
    if not len(values):
        return Whitener(centre, none, np.zeros((dims, 0)), none, none, 0.0)
    moments = summed(fit, centre, np.ascontiguousarray(vectors / np.sqrt(values)), _moments, len(values) + 2) / centre.n
    mean, trace = moments[-2], moments[-1, 0]
    error = float(np.abs(moments[:-2] - np.outer(mean, mean) - np.eye(len(values))).max())
    return Whitener(centre, values, vectors, residuals, values / trace, error)


def _whitened(batches: Iterator[pa.RecordBatch], model: Whitener, dims: int, names: list[str], x_col: str) -> Iterator[pa.RecordBatch]:
    turn = model.vectors / np.sqrt(model.values) if len(model.values) else model.vectors
    for batch in batches:
        flat = batch.column(x_col).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dims)
        deviation, w = [], np.zeros((batch.num_rows, turn.shape[1]))
        step = max(1, CHUNK // max(dims, 1))
        for at in range(0, batch.num_rows, step):
            d = differences(flat[at : at + step], model.centre)
            if d.dtype == np.int64 and float(np.abs(d).max(initial=0)) ** 2 * max(dims, 1) < 2**62:
                deviation += (d * d).sum(axis=1).tolist()
            else:
                exact = [sum(int(e) ** 2 for e in row) for row in d.tolist()]
                deviation += [e if e < LONG else None for e in exact]
            w[at : at + step] = d.astype(np.float64) / max(model.centre.n, 1) @ turn
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(deviation, pa.int64()), lists], names=[*names, "deviation", "whitened"])


def whiten(rows: DataFrame, k: int = 16, scale: float = 64, offset: int = 1_000_000, vec_col: str = "embedding") -> DataFrame:
    """``rows`` with n, deviation, whitened (array of up to ``k`` components by
    falling variance), explained (array, its share of the trace) and
    identity_error. Runs at once; what it wrote on the way is deleted, but for
    the result."""
    tables = Tables(rows.sparkSession)
    given = without(rows, ADDED)
    xc = hidden(rows, "x")["x"]
    c = F.col(f"`{vec_col}`").cast("array<double>")
    fine = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = rows.where(fine)
    dims = kept.agg(F.max(F.size(c))).first()[0] or 0
    last = F.lit(LONG - 1 - offset)
    x = F.transform(c, lambda e: F.least(F.floor(e * F.lit(float(scale))).cast("long"), last) + F.lit(offset).cast("long"))
    x = F.concat(x, F.array_repeat(F.lit(offset).cast("long"), F.lit(dims) - F.size(c)))
    kept = kept.select(*(F.col(f"`{g}`") for g in given), x.alias(xc))
    fit = tables.add(kept.select(xc).mapInArrow(_packed, "x binary").distinct(), "fit").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_whitener(fit, dims, k, tables)
    finally:
        fit.unpersist()
    fields = [f for f in kept.schema.fields if f.name != xc]
    schema = T.StructType([*fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    out = kept.mapInArrow(partial(_whitened, model=model, dims=dims, names=[f.name for f in fields], x_col=xc), schema)
    explained = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
    out = out.withColumns({"n": F.lit(model.centre.n).cast("long"), "explained": explained, "identity_error": F.lit(model.identity_error)})
    done = table(out.select(*(F.col(f"`{g}`") for g in given), *ADDED), "whitened")
    tables.drop()
    return done


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row for each row and component of :func:`whiten`'s result."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = whitened.select(id_col, "n", "deviation", "identity_error", each)
    return rows.select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
