"""URL filter: host-and-path rules found by a sorted digest array.

A rule is a host and a path prefix (``example.net/en/``); it fits its host and
all subdomains where the url's path starts with the rule's. The longest rule
that fits wins (longest host, then longest path). The rules' 64-bit xxhash keys
are sorted in one file, which every worker maps into memory; the candidate
keys of a whole batch (host suffixes by the path lengths in use) are probed in
one vectorised binary search, and each hit is confirmed against the stored
full string, so a digest collision changes nothing. The file is sent to the
workers with the rules' strings. Beyond ``max_rules`` rules, or where the rules
are a DataFrame, candidates and rules are joined by Spark instead, with equal
results. Host suffixes and paths longer than any rule's are no candidates, so
the work is linear in the url's length.

Edge cases: a null url or one without ``://`` has an empty host and path, which
no rule fits. Urls that no rule fits get ``default``. Repeated urls are judged
alike; empty tables and an empty rule list work; a rule listed twice with
different verdicts is an error. Other columns pass through.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import hidden, map_arrow, table, without


def host_path(url: str) -> tuple[Column, Column]:
    """Host and path of a column of urls."""
    rest = F.expr(f"CASE WHEN contains(`{url}`, '://') THEN substr(`{url}`, instr(`{url}`, '://') + 3) END")
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


class Digests:
    """Sorted 64-bit keys in a memory-mapped file, with the strings they stand
    for and their verdicts. Keys that collide stand side by side."""

    def __init__(self, rules: dict[str, str]):
        names = sorted(rules, key=lambda r: (xxhash.xxh64_intdigest(r), r))
        self.names, self.verdicts = names, [rules[r] for r in names]
        self.data = np.array([xxhash.xxh64_intdigest(r) for r in names], np.uint64).tobytes()
        self.lengths = sorted({len(r) - r.index("/") for r in rules}, reverse=True)
        self.longest = max((r.index("/") for r in rules), default=0)
        self.keys = None

    def __getstate__(self):
        return {**self.__dict__, "keys": None}

    def map(self) -> np.ndarray:
        if self.keys is None:
            if not self.data:
                self.keys = np.empty(0, np.uint64)
                return self.keys
            fd, path = tempfile.mkstemp(prefix="digests-")
            try:
                os.write(fd, self.data)
                self.keys = np.frombuffer(mmap.mmap(fd, len(self.data), access=mmap.ACCESS_READ), np.uint64)
            finally:
                os.close(fd)
                os.unlink(path)  # the mapping stays valid
        return self.keys

    def find(self, names: list[str]) -> np.ndarray:
        """Index of each name's rule, or -1."""
        keys = self.map()
        want = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        at = np.searchsorted(keys, want)
        out = np.full(len(names), -1)
        for i in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, max(len(keys) - 1, 0))] == want) if len(keys) else np.zeros(len(names), bool)):
            k = at[i]
            while k < len(keys) and keys[k] == want[i]:
                if self.names[k] == names[i]:
                    out[i] = k
                    break
                k += 1
        return out


def candidates(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """Rule strings that would fit, the winning one first. Host suffixes are
    at most ``longest`` long."""
    if not host or not path:
        return []
    ends = [host] if len(host) <= longest else []
    at = host.find(".", max(len(host) - longest - 1, 0))
    while at >= 0:
        ends.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return [h + path[:n] for h in ends if h for n in lengths if n <= len(path)]


def _judged(batches: Iterator[pa.RecordBatch], digests, default: str):
    d: Digests = digests.value
    for batch in batches:
        hosts, paths = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
        known: dict[tuple[str, str], int] = {}
        per, flat = [], []
        for h, p in zip(hosts, paths):
            key = (h, p[: d.lengths[0]] if d.lengths else "")
            if key not in known:
                known[key] = len(per)
                names = candidates(h, p, d.lengths, d.longest)
                per.append((len(flat), len(flat) + len(names)))
                flat += names
        hit = d.find(flat)
        best = []
        for lo, hi in per:
            some = np.flatnonzero(hit[lo:hi] >= 0)
            best.append(int(hit[lo + some[0]]) if len(some) else -1)
        rule = [best[known[h, p[: d.lengths[0]] if d.lengths else ""]] for h, p in zip(hosts, paths)]
        cols = [pa.array([d.names[k] if k >= 0 else None for k in rule], pa.string()), pa.array([d.verdicts[k] if k >= 0 else default for k in rule], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [str(i) for i in range(batch.num_columns + 2)])


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Verdicts by a join of candidates with a table (rule, verdict)."""
    at = F.instr("rule", "/")
    sizes = rules.agg(F.coalesce(F.max(at - 1), F.lit(0)).alias("h"), F.collect_set(F.length("rule") - at + 1).alias("p")).first()
    names = hidden(parts, "key", "ends", "end", "n", "name", "best")
    key, ends, end, n, name, best = (f"`{names[x]}`" for x in ("key", "ends", "end", "n", "name", "best"))
    keyed = table(parts.withColumn(key[1:-1], F.monotonically_increasing_id()), "urls")
    split = "split(right(host, {0}), '[.]')".format(sizes["h"])
    # suffixes that begin at a dot, or the whole host if it is short enough
    first = f"CASE WHEN length(host) <= {sizes['h']} OR substr(host, -{sizes['h'] + 1}, 1) = '.' THEN 0 ELSE 1 END"
    cand = keyed.where("host <> '' AND path <> ''").select(F.expr(key), "host", "path", F.expr(f"{split} AS {ends}"))
    cand = cand.select(F.expr(key), "path", F.expr(f"explode(transform(sequence(0, size({ends}) - 1), i -> if(i < {first}, '', array_join(slice({ends}, i + 1, size({ends})), '.')))) AS {end}")).where(f"{end} <> ''")
    cand = cand.select(F.expr(key), F.expr(end), "path", F.explode(F.array(*(F.lit(x) for x in sizes["p"])).cast("array<int>")).alias(n[1:-1])).where(f"{n} <= length(path)")
    cand = cand.select(F.expr(key), F.expr(f"concat({end}, substr(path, 1, {n})) AS {name}"), F.expr(f"struct(length({end}) AS h, {n} AS p) AS {best}"))
    hit = cand.join(rules.select(F.col("rule").alias(name[1:-1]), F.col("verdict").alias("_verdict")), name[1:-1])
    won = hit.groupBy(F.expr(key).alias(key[1:-1])).agg(F.max_by(F.struct(F.expr(name).alias("rule"), "_verdict"), F.expr(best)).alias(best[1:-1]))
    out = keyed.join(won, key[1:-1], "left")
    given = [F.col("`" + c.replace("`", "``") + "`") for c in parts.columns]
    return out.select(*given, F.expr(f"{best}.rule AS rule"), F.coalesce(F.expr(f"{best}._verdict"), F.lit(default)).alias("verdict"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow", url_col: str = "url", max_rules: int = 5_000_000) -> DataFrame:
    """Adds host, path, rule and verdict. ``rules``: (rule, verdict)."""
    given = without(pages, ("host", "path", "rule", "verdict"))
    url = hidden(pages, "url")["url"]
    host, path = host_path(url)
    parts = pages.withColumn(url, F.col(f"`{url_col}`")).select(*(F.col("`" + c.replace("`", "``") + "`") for c in given), host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) > max_rules:
        rules = spark.createDataFrame(rules, "rule string, verdict string")
    if isinstance(rules, DataFrame):
        closed = rules.select(F.expr("CASE WHEN contains(rule, '/') THEN rule ELSE concat(rule, '/') END AS rule"), "verdict").distinct()
        twice = closed.groupBy("rule").count().where("count > 1").first()
        if twice:
            raise ValueError(f"two verdicts for {twice['rule']}")
        return _joined(parts, closed, default)
    known: dict[str, str] = {}
    for rule, verdict in rules:
        if known.setdefault(rule if "/" in rule else rule + "/", verdict) != verdict:
            raise ValueError(f"two verdicts for {rule}")
    digests = spark.sparkContext.broadcast(Digests(known))
    return map_arrow(parts, partial(_judged, digests=digests, default=default), parts.schema.fields, "rule string, verdict string")
