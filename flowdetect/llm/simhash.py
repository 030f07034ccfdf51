"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64
hashes have it. Two fingerprints within ``radius`` bits of each other have a
number between them that is within half the radius of both: every distinct
fingerprint is dealt to all numbers within half the radius (65 for radius 2),
and fingerprints that meet at a number are candidates, verified by their
distance. As fingerprints are distinct, at most one ball's worth of them can
meet at a number, however the texts are distributed: no hot groups arise.

With an even radius all that meet are within the radius of each other, so one
link from each to the least of them joins the same components as all pairs
would; ``every`` gives all pairs. Copies share a fingerprint and are grouped
(with partial sums) before anything is dealt.

Edge cases: a null or empty text, or one of whitespace only, has fingerprint
zero and is linked like any other; a text of fewer than ``k`` words is one
shingle. Texts are read in segments, so a very long one needs little more
memory than its bytes. A null id counts as the largest: a component has a null id only if
all its ids are null. Repeated ids and rows stay, each with its own row. An empty table gives an
empty result. Other columns stay; ones that clash with the added names are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowdetect.llm.common import Tables, hidden, table, without
from flowdetect.llm.components import components

ADDED = ("fingerprint", "component_id")
SEED = 42
SEGMENT = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """Runs of whole words of about ``size`` bytes."""
    at = 0
    while len(text) - at > size:
        space = _SPACE.search(text, at + size)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def fingerprint(text: bytes, k: int) -> int:
    """64-bit SimHash of a text's word shingles; zero without words."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in segments(text):
        words = carry + part.translate(_LOWER).split()
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        carry = words[-(k - 1) :] if k > 1 else []
        total += len(hashes)
        for at in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        return digest(b" ".join(carry), SEED) if carry else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _marked(batches: Iterator[pa.RecordBatch], k: int, text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text)
        found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t in batch.column(at)]
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*names, name])


def with_fingerprint(docs: DataFrame, k: int = 3, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` without its text and with ``name``, the fingerprint as a long."""
    kept = [f for f in docs.schema.fields if f.name not in (text_col, name)]
    given = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text_col}`").cast("string").alias(text_col))
    return given.mapInArrow(partial(_marked, k=k, text=text_col, name=name), T.StructType([*kept, T.StructField(name, T.LongType())]))


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2, every: bool = False) -> DataFrame:
    """(a, b), a > b, of fingerprints within ``radius`` bits of each other.
    ``prints``: (f long), distinct. Unless ``every`` pair is asked for, an even
    radius gives a spanning set of the pairs: one for each number at which a
    fingerprint is not the least."""
    masks = F.array(*(F.lit(m).cast("long") for m in ball((radius + 1) // 2)))
    met = prints.select("f", F.explode(masks).alias("m")).select((F.col("f").bitwiseXOR(F.col("m"))).alias("v"), "f")
    if every or radius % 2:
        groups = met.groupBy("v").agg(F.collect_list("f").alias("g")).where(F.size("g") > 1)
        pairs = groups.select(F.explode("g").alias("a"), "g").select("a", F.explode(F.filter("g", lambda x: x < F.col("a"))).alias("b"))
    else:
        pairs = met.select(F.col("f").alias("a"), F.min("f").over(Window.partitionBy("v")).alias("b")).where("a > b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (16 hexadecimal digits)
    and ``component_id``, the least id that links reach. Runs at once; what it
    wrote on the way is deleted, but for the result."""
    tables = Tables(docs.sparkSession)
    given = without(docs, [*ADDED, text_col])
    f, c = hidden(docs, "f", "c").values()
    docs = docs.select(*(F.col(f"`{x}`") for x in given), F.col(f"`{text_col}`"))
    docs = tables.add(with_fingerprint(docs, k, text_col, f), "fingerprints")
    classes = tables.add(docs.groupBy(F.col(f).alias("f")).agg(F.min(F.col(f"`{id_col}`")).alias("id")), "classes")
    found = tables.add(links(classes.select("f"), radius), "links")
    rooted = classes.join(components(found).withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    rooted = tables.add(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("f").alias(f), F.col("component_id").alias(c))
    out = docs.join(named, f).select(*(F.col(f"`{x}`") for x in given), F.lower(F.lpad(F.hex(f), 16, "0")).alias("fingerprint"), F.col(c).alias("component_id"))
    done = table(out, "simhash")
    tables.drop()
    return done
