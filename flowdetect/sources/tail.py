"""Streaming source that tails growing line files.

A file's offset is the byte after the last whole line taken from it, so an open
line waits and nothing is read twice, across restarts too. What a batch takes is
cut into byte ranges that tasks read; only offsets and sizes are on the driver.
A file smaller than its offset was begun anew and is read from its start.

``maxRecords`` bounds the lines of a batch (with a short processing-time trigger
a batch then closes by count or by time). The end of a batch is noted under
``progress`` when the batch is planned, after Spark has logged it. Whatever is
logged but not noted is planned again first by a restart, so the bound is counted
from the last batch and holds for every batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LOOK = 1 << 16  # bytes looked at in one step for the end of a line


class Lines(InputPartition):
    """Lines of ``file`` that begin in [start, end)."""

    def __init__(self, file: str, start: int, end: int, first: int):
        self.file, self.start, self.end, self.first = file, start, end, first


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.part = int(options.get("partbytes", 32 << 20))
        self.most = int(options["maxrecords"]) if "maxrecords" in options else None
        self.progress = options.get("progress")
        if self.most is not None and not self.progress:
            raise ValueError("maxRecords needs a place for its progress")
        self.at = self._noted() if self.progress else {}

    def _files(self):
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def _noted(self) -> dict:
        fs, path = pyarrow.fs.FileSystem.from_uri(self.progress)
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return {}
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _note(self, at: dict) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(self.progress)
        with fs.open_output_stream(path + ".new") as f:
            f.write(json.dumps(at).encode())
        fs.move(path + ".new", path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = self._files()
        sizes = {f.path: f.size for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.is_file and f.base_name[0] not in "._"}
        left, end = self.most, {}
        for name in sorted(sizes):
            begin = self.at.get(name, 0)
            begin = begin if begin <= sizes[name] else 0
            if begin == sizes[name] or left == 0:
                end[name] = begin
                continue
            with fs.open_input_file(name) as f:
                if left is None:
                    end[name] = self._last(f, begin, sizes[name])
                else:
                    end[name], left = self._after(f, begin, sizes[name], left)
        return end

    @staticmethod
    def _last(f, begin: int, size: int) -> int:
        """The end of the last whole line, looked for from the file's end."""
        to = size
        while to > begin:
            since = max(begin, to - LOOK)
            f.seek(since)
            found = f.read(to - since).rfind(b"\n")
            if found >= 0:
                return since + found + 1
            to = since
        return begin

    @staticmethod
    def _after(f, begin: int, size: int, most: int) -> tuple[int, int]:
        """The end of ``most`` lines, or of as many as there are, and how many are left."""
        f.seek(begin)
        at, end = begin, begin
        while at < size and most:
            block = f.read(min(LOOK, size - at))
            place = block.find(b"\n")
            while place >= 0 and most:
                end, most = at + place + 1, most - 1
                place = block.find(b"\n", place + 1)
            at += len(block)
        return end, most

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        if self.progress:
            self._note(end)
        self.at, out = end, []
        for name, to in end.items():
            begin = start.get(name, 0)
            begin = begin if begin <= to else 0
            out += [Lines(name, at, min(at + self.part, to), begin) for at in range(begin, to, self.part)]
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        fs, _ = self._files()
        with fs.open_input_file(partition.file) as raw:
            at = partition.start
            if at > partition.first:  # a line that began before belongs to the range before
                raw.seek(at - 1)
                at += self._skip(raw) - 1
            raw.seek(at)
            rest, lines = b"", []
            while at < partition.end or rest:
                block = raw.read(LOOK)
                pieces = (rest + block).split(b"\n")
                rest = pieces.pop()
                for line in pieces:
                    if at < partition.end:
                        lines.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                if len(lines) >= 10_000:
                    yield self._batch(partition.file, lines)
                    lines = []
                if at >= partition.end or not block:
                    break
            if lines:
                yield self._batch(partition.file, lines)

    @staticmethod
    def _skip(raw) -> int:
        """Bytes up to and with the next end of a line."""
        n = 0
        while block := raw.read(LOOK):
            found = block.find(b"\n")
            if found >= 0:
                return n + found + 1
            n += len(block)
        return n

    @staticmethod
    def _batch(file: str, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(lines)], names=["file", "value"])


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, max_records: int | None = None, progress: str | None = None, part_bytes: int | None = None) -> DataFrame:
    """(file, value): the whole lines that files of the folder ``path`` have and
    get. With ``max_records`` a batch takes so many at most."""
    spark.dataSource.register(TailedLines)
    given = {"maxRecords": max_records, "progress": progress, "partBytes": part_bytes}
    d = spark.readStream.format("tailed_lines")
    for name, value in given.items():
        d = d if value is None else d.option(name, str(value))
    return d.load(path)


def tail_logs(spark: SparkSession, path: str, schema, **limits) -> DataFrame:
    """Rows of the JSON logs of a folder as they grow; lines that are no JSON of
    the schema are skipped."""
    lines = tail_lines(spark, path, **limits)
    return lines.select(F.from_json("value", schema).alias("v")).where("v IS NOT NULL").select("v.*")
