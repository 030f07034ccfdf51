"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by ranges of their id and sorted; every task encodes its
range and writes one Arrow IPC file. Ids of all its documents, each closed by an
end id, run through sequences of ``length`` ids without gaps: ``ids`` is a
fixed-size list of uint16 (uint32 for larger vocabularies), ``mask`` a fixed-size
list of booleans, false where the last sequence is padded. All record batches
but the last hold ``BATCH`` sequences, so id number i lies in batch i // (BATCH *
length) and is read from a memory map without copies. A second file lists the
documents with their place. Files carry unique names; the manifest names those of
the attempts that succeeded, so a lost executor's leavings are never read.

The files go to the shared folder through Arrow's file systems (``file:``,
``hdfs:``, ``s3:`` ...).

Words between ASCII white space are encoded by the tokenizers library once per
worker and looked up afterwards (bounded cache): the tokenizer drops white space
and none of its steps looks across it.

Edge cases: null and empty texts are the end id alone. A null id comes first;
ties of the id are ordered by text. Empty tables write no file. Long texts are
encoded whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import shared_dir, table

BATCH = 64
KEPT_WORDS, KEPT_CHARS = 1_000_000, 40  # a worker remembers so many words of up to so many characters
_WORDS = re.compile(r"[^ \t\n\r]+")
_state: dict = {}


def encode_texts(texts: list[str], path: str, kind) -> list[np.ndarray]:
    if (_state.get("path"), _state.get("kind")) != (path, kind):
        from tokenizers import Tokenizer

        _state.update(path=path, kind=kind, tokenizer=Tokenizer.from_file(path), known={})
    known, tokenizer = _state["known"], _state["tokenizer"]
    if len(known) > KEPT_WORDS:
        known = _state["known"] = {}
    parts = [_WORDS.findall(t) for t in texts]
    found = [list(map(known.get, p)) for p in parts]
    open_ = [i for i, f in enumerate(found) if None in f]
    new = list({w for i in open_ for w, f in zip(parts[i], found[i]) if f is None})
    for lo in range(0, len(new), 512):  # new words together, told apart by their offsets
        some = new[lo : lo + 512]
        e = tokenizer.encode(" ".join(some), add_special_tokens=False)
        ids = np.array(e.ids, kind)
        start = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        at = 0
        for w, to in zip(some, np.searchsorted(start, ends).tolist()):
            known[w] = ids[at:to].tobytes()
            at = to
    for i in open_:
        found[i] = map(known.__getitem__, parts[i])
    out = [np.frombuffer(b"".join(f), kind) for f in found]
    for w in new:
        if len(w) > KEPT_CHARS:
            del known[w]
    return out


def schema(length: int, kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """Packs ids into sequences and writes full batches of them."""

    def __init__(self, out, length: int, kind):
        self.length, self.kind, self.pending, self.n, self.total = length, kind, [], 0, 0
        self.file = pa.ipc.new_file(out, schema(length, kind))

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= BATCH * self.length:
            flat, at = np.concatenate(self.pending), 0
            while len(flat) - at >= BATCH * self.length:
                self._write(flat[at : at + BATCH * self.length], BATCH * self.length)
                at += BATCH * self.length
            self.pending, self.n = [flat[at:]], len(flat) - at

    def _write(self, flat: np.ndarray, valid: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < valid), self.length)
        self.file.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=schema(self.length, self.kind)))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.pending)
            self._write(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.file.close()


def _written(batches: Iterator[pa.RecordBatch], path: str, folder: str, length: int, end_id: int, kind):
    store, root = fs.FileSystem.from_uri(folder)
    name, writer, docs = f"{root}/{uuid.uuid4().hex}", None, None
    places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    for batch in batches:
        ids, texts = batch.column(0), pc.fill_null(batch.column(1), "").to_pylist()
        for lo in range(0, len(texts), 512):
            if writer is None:
                store.create_dir(root, recursive=True)
                out, index = store.open_output_stream(f"{name}.arrow"), store.open_output_stream(f"{name}.docs.arrow")
                writer, docs = Writer(out, length, kind), pa.ipc.new_file(index, places)
            start, n = [], []
            for e in encode_texts(texts[lo : lo + 512], path, kind):
                start.append(writer.total)
                n.append(len(e) + 1)
                writer.add(e)
                writer.add(np.array([end_id], kind))
            docs.write_batch(pa.RecordBatch.from_arrays([ids.slice(lo, 512), pa.array(start, pa.int64()), pa.array(n, pa.int64())], schema=places))
    if writer is not None:
        writer.close()
        docs.close()
        out.close()
        index.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "name": [name], "n_ids": pa.array([writer.total], pa.int64())})


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, store, name: str):
        local = isinstance(store, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(name) if local else store.open_input_file(name))
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.flat = None, None

    def batch(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.flat = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.flat

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = BATCH * self.length, []
        while n:
            k, at = divmod(start, size)
            part = self.batch(k)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _read(batches: Iterator[pa.RecordBatch], folder: str):
    store, _ = fs.FileSystem.from_uri(folder)
    for batch in batches:
        for row in batch.to_pylist():
            reader = Reader(store, row["name"] + ".arrow")
            with store.open_input_file(row["name"] + ".docs.arrow") as f:
                docs = pa.ipc.open_file(f)
                for k in range(docs.num_record_batches):
                    d = docs.get_batch(k)
                    start, n = d.column(1).to_numpy(), d.column(2).to_numpy()
                    crc = [zlib.crc32(reader.ids(int(s), int(m)).astype("<u4").tobytes()) for s, m in zip(start, n)]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(start + row["before"]), d.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, length: int = 2048, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """Writes the files and returns their manifest (part, name, n_ids, before:
    ids in earlier files), one row a file, and the folder as ``folder``."""
    folder = folder or f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    run = partial(_written, path=path, folder=folder, length=length, end_id=end_id, kind=np.dtype("<u4" if wide else "<u2"))
    files = table(rows.mapInArrow(run, "part long, name string, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"), F.lit(folder).alias("folder"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    first, n = manifest.select("folder").first(), manifest.count()
    files = manifest.repartitionByRange(max(n, 1), "part")  # a task for each file
    return files.mapInArrow(partial(_read, folder=first["folder"] if first else "file:///"), "doc_id long, start long, n_tokens long, ids_crc32 long")
