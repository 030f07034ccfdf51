"""Helpers shared by the corpus operators: shared storage, text keys and
vectorised word / hash kernels over Arrow string buffers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow = {1: np.ones(1, U64), -1: np.ones(1, U64)}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``
    of the session. Only a session in one process (tests) may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file:///tmp/flowdetect-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, so
    that later steps start from files that survive lost executors."""
    return Tables(df.sparkSession).add(df, name)


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Tables:
    """Tables of one operator in the shared folder; ``drop`` deletes them when
    nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def add(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names or list(self.paths):
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def hidden(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(c.startswith(mark + n.lower()) for c in taken for n in names):
        mark += "_"
    return {n: mark + n for n in names}


def without(df: DataFrame, names) -> list[str]:
    """Columns of ``df`` other than ``names`` (case ignored)."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def map_arrow(df: DataFrame, run, fields: list[T.StructField], added: str) -> DataFrame:
    """``df.mapInArrow(run, ..)`` to columns ``fields`` and those ``added``. Columns go
    by place under plain names, so their own names may hold anything."""
    out = [*fields, *T._parse_datatype_string(added).fields]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(out)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, plain).toDF(*(f.name for f in out))


def text_key(text: Column) -> list[Column]:
    """Two columns (96 bits) that stand for a text."""
    return [F.xxhash64(text).alias("k1"), (F.crc32(text.cast("binary")) - (1 << 31)).cast("int").alias("k2")]


def powers(n: int, sign: int = 1) -> np.ndarray:
    """At least ``n`` powers of the hash multiplier (sign -1: of its inverse)."""
    if len(_pow[sign]) < n:
        size = 1 << int(n - 1).bit_length()
        p = np.full(size, _MUL if sign > 0 else _INV, U64)
        p[0] = 1
        _pow[sign] = np.multiply.accumulate(p)
    return _pow[sign]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64's constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _MUL)
_NEAR = 32


def _placed(code: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each (place in a word, byte)."""
    return mix(mix(code.astype(U64) * _MUL + U64(0x5851F42D4C957F2D)) ^ U64(0x2545F4914F6CDD1D))


_PLACED = _placed(np.arange(_NEAR << 8))
_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of whole rows of about ``most`` bytes:
    (first row, bytes, row offsets). Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:
        column = column.fill_null("")
        yield from chunks(column, most)
        return
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words_of(buf: np.ndarray, offs: np.ndarray, lower: bool = False):
    """(start, end, row, 64-bit hash) of every word ``[^\\x20\\x09-\\x0D]+``.
    The hash sums a pseudo-random number of every (place, byte): unlike powers
    of one multiplier, these have no pattern that some words could cancel."""
    empty = np.empty(0, np.int64)
    if not len(buf):
        return empty, empty, empty, empty.astype(U64)
    on = ~_IS_WS[buf]
    first = on.copy()
    first[1:] &= ~on[:-1]
    edges = offs[1:-1]
    edges = edges[edges < len(buf)]
    first[edges] |= on[edges]
    start = np.flatnonzero(first)
    if not len(start):
        return empty, empty, empty, empty.astype(U64)
    last = on.copy()
    last[:-1] &= ~on[1:]
    inner = offs[1:-1]
    inner = inner[inner > 0] - 1
    last[inner] |= on[inner]
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, "right") - 1
    which = np.cumsum(first) - 1
    at = np.arange(len(buf)) - start[np.maximum(which, 0)]
    at[~on] = 0
    low = _LOWER[buf] if lower else buf
    code = (np.minimum(at, _NEAR - 1) << 8) | low
    value = _PLACED[code]
    far = np.flatnonzero(at >= _NEAR)
    if len(far):
        value[far] = _placed((at[far] << 8) | low[far])
    value[~on] = 0
    return start, end, row, mix(np.add.reduceat(value, start) + (end - start).astype(U64))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)
