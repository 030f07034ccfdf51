"""Exact Jaccard self-join of word-shingle sets by universe partition.

Two sets of sizes x <= y with Jaccard similarity of p percent or more differ
in at most H = (100 - p)(x + y) // (100 + p) shingles. Set sizes are cut into
bands. In a band every set is hashed into m segments; the set is indexed under
the hash of each segment's subset and, in an eighth of the segments, under the
subsets with one shingle deleted (one-deletion neighbourhood). A set looks its
partners up in its own band and the one below. It spends H + 1 units of effort
on the cheapest segments (cost-based allocation): one unit looks up a segment's
subset and finds partners equal there, two units look up its one-deletion
neighbourhood as well and find partners that differ there by one, none skips
it. Full segments are rare and cheap, empty ones are common and come last. By
the pigeonhole no partner is lost, and every candidate is verified exactly on
its texts.

Equal sets form one class, which is joined once. Within the sets that share a
signature only a star is verified first, around the set that shares most
signatures with others; then the pairs whose ends are still in different
components, so a group of r near copies costs about r checks and not r * r.
Pairs are dropped before their texts are read where the parities of their
shingle counts in 1,024 buckets differ in more than H places, which no similar
pair does. Set classes stand under 64-bit hashes of their shingles.

Entries travel in bundles, one row for each task's batch and bucket of
signatures. A signature that many sets of a batch share is settled there: one
witness goes on, so a signature that a third of all rows share stays a few rows
a batch. Sets of a signature that are still apart in the end are dealt out by
pairs of blocks.

Edge cases: null and empty texts have no shingles and link with nothing; a
text of fewer than ``k`` words is one shingle; repeated rows are one class; a
null id never becomes a component's id unless all ids are null; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import U64, Tables, as_long, chunks, mix, table, words_of
from flowdetect.llm.components import components

_SALT = [U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_RNG = U64(0xD6E8FEB86659FD93)
PARITIES = 1024


def shingles(buf: np.ndarray, offs: np.ndarray, k: int):
    """(row, hash) of the distinct shingles of each row, sorted by both."""
    _, _, row, h = words_of(buf, offs, lower=True)
    n = np.bincount(row, minlength=len(offs) - 1) if len(row) else np.zeros(len(offs) - 1, np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    parts = []
    if len(h) >= k:
        x = np.zeros(len(h) - k + 1, U64)
        for i in range(k):
            x = mix(x * _RNG + h[i : i + len(x)])
        ok = row[: len(x)] == row[k - 1 :]
        parts.append((row[: len(x)][ok], x[ok]))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        x = np.zeros(len(short), U64)
        for i in range(k - 1):
            more = n[short] > i
            x[more] = mix(x[more] * _RNG + h[at[short[more]] + i] + _SALT[0])
        parts.append((short, x))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, U64)
    row, x = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1])
    return row[new], x[new]


def classes(row: np.ndarray, x: np.ndarray, rows: int):
    """Per row: size of its set and the hash that stands for the set."""
    n = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    c = np.zeros(rows, U64)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        c[row[first]] = mix(np.add.reduceat(mix(x ^ _SALT[1]), first) + n[row[first]].astype(U64) * _SALT[2])
    return n, c


class Bands:
    """Size bands, their segments and the effort that a lookup needs."""

    def __init__(self, percent: int, largest: int):
        self.p = percent
        lo = [1]
        while lo[-1] <= largest:
            lo.append(max(lo[-1], lo[-1] * 100 // percent) + 1)
        self.lo = np.array(lo, np.int64)
        self.hi = np.append(self.lo[1:] - 1, np.iinfo(np.int32).max)
        self.m = self.differ(self.hi, self.hi * 100 // percent) + 1
        self.deleted = np.where(self.m > 1, self.m // 8 + 1, 0)

    def differ(self, x, y):
        return (100 - self.p) * (x + y) // (100 + self.p)

    def of(self, n):
        return np.searchsorted(self.lo, n, "right") - 1


def signatures(row: np.ndarray, x: np.ndarray, n: np.ndarray, bands: Bands, own: bool):
    """(signature, row, role) in the own band of each row (role 1: indexed,
    2: looked up, 3: both) or in the band below it (role 2)."""
    n_of = n[row]
    band = bands.of(n_of) - (0 if own else 1)
    keep = (band >= 0) & (n_of > 0)
    if not own:
        keep &= bands.hi[np.maximum(band, 0)] * 100 >= bands.p * n_of
    keep &= bands.m[np.maximum(band, 0)] > 1
    row, x, band, n_of = row[keep], x[keep], band[keep], n_of[keep]
    if not len(row):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sets, band1, n1 = row[first], band[first], n_of[first]
    m = bands.m[band1]
    base = np.concatenate([[0], np.cumsum(m)])
    which = np.repeat(np.arange(len(sets)), np.diff(np.append(first, len(row))))
    segment = (mix(x ^ (_SALT[0] + band.astype(U64))) % m[which].astype(U64)).astype(np.int64)
    cell = base[which] + segment
    value = mix(x + _SALT[2])
    order = np.argsort(cell, kind="stable")
    cell_s, value_s = cell[order], value[order]
    size = np.bincount(cell, minlength=base[-1])
    total = np.zeros(base[-1], U64)
    head = np.flatnonzero(np.concatenate([[True], cell_s[1:] != cell_s[:-1]]))
    total[cell_s[head]] = np.add.reduceat(value_s, head)
    owner = np.repeat(np.arange(len(sets)), m)
    seg = np.arange(base[-1]) - base[owner]
    salt = mix(seg.astype(U64) * _SALT[1] + band1[owner].astype(U64) * _SALT[0] + U64(1))
    # Effort: one unit in each of the fullest segments, then a second one where
    # deletions are indexed, then empty segments.
    need = bands.differ(np.minimum(bands.hi[band1], n1), n1) + 1
    by = np.lexsort((seg, -size, owner))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by)) - base[owner[by]]
    full = np.bincount(owner, weights=size > 0, minlength=len(sets)).astype(np.int64)
    effort = ((rank < need[owner]) & (size > 0)).astype(np.int64)
    lack = np.maximum(need - full, 0)
    if lack.any():
        can = (size > 0) & (seg < bands.deleted[band1][owner]) & (lack[owner] > 0)
        nth = np.cumsum(can) - np.concatenate([[0], np.cumsum(can)])[base[owner]]
        twice = can & (nth <= lack[owner])
        effort[twice] = 2
        lack = lack - np.bincount(owner, weights=twice, minlength=len(sets)).astype(np.int64)
        none = (size == 0) & (lack[owner] > 0)
        nth = np.cumsum(none) - np.concatenate([[0], np.cumsum(none)])[base[owner]]
        effort[none & (nth <= lack[owner])] = 1
    index = 1 if own else 0
    role = index + 2 * (effort > 0)
    out = [(mix(total + salt), sets[owner], role)]
    # One-deletion neighbourhoods.
    el_role = index * (seg < bands.deleted[band1][owner]) + 2 * (effort > 1)
    el = el_role[cell_s] > 0
    c = cell_s[el]
    out.append((mix(total[c] - value_s[el] + salt[c]), sets[owner[c]], el_role[c]))
    sig, rows, role = (np.concatenate(p) for p in zip(*out))
    keep = role > 0
    return sig[keep], rows[keep], role[keep]


def _parities(row: np.ndarray, x: np.ndarray, rows: int) -> list[bytes]:
    """Of each row: the parities of its shingle counts in ``PARITIES`` buckets."""
    bucket, out = (mix(x + _SALT[1]) % U64(PARITIES)).astype(np.int64), []
    for lo in range(0, rows, 1024):
        n = min(1024, rows - lo)
        i, j = np.searchsorted(row, (lo, lo + n))
        odd = np.bincount((row[i:j] - lo) * PARITIES + bucket[i:j], minlength=n * PARITIES) & 1
        out += [o.tobytes() for o in np.packbits(odd.astype(np.uint8).reshape(n, PARITIES), axis=1)]
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(id, n, c, compressed text, parities) of every document; of a class that
    the task has met already (as far as it remembers) without the text."""
    squeeze = zstandard.ZstdCompressor(level=1)
    met: set[int] = set()
    for batch in batches:
        for at, buf, offs in chunks(batch.column(1)):
            rows = len(offs) - 1
            row, x = shingles(buf, offs, k)
            n, c = classes(row, x, rows)
            odd = _parities(row, x, rows)
            if len(met) > 500_000:
                met.clear()
            raw, z = buf.tobytes(), [None] * rows
            for i, key in enumerate(c.tolist()):
                if n[i] and key not in met:
                    met.add(key)
                    z[i] = squeeze.compress(raw[offs[i] : offs[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, rows), pa.array(n, pa.int64()), pa.array(as_long(c), pa.int64(), mask=n == 0), pa.array(z, pa.binary()), pa.array([o if t else None for o, t in zip(odd, z)], pa.binary())],
                ["id", "n", "c", "z", "odd"],
            )


def _opened(z: pa.Array, most: int = 1 << 20):
    """The compressed texts in runs of about ``most`` bytes: (bytes, offsets)."""
    back, part, size = zstandard.ZstdDecompressor(), [], 0
    for x in z:
        part.append(back.decompress(x.as_py(), max_output_size=1 << 31))
        size += len(part[-1])
        if size >= most or len(part) == MEMBERS // 2:
            yield np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(p) for p in part])
            part, size = [], 0
    if part:
        yield np.frombuffer(b"".join(part), np.uint8), np.cumsum([0] + [len(p) for p in part])


# A bundle holds the entries of up to MEMBERS classes; 13 bits name the class in
# it, one marks a witness, two are the role.
MEMBERS = 1 << 13
WITNESS = 4
ENTRIES = 1_500_000
BUNDLE = "bucket int, settled boolean, sig binary, who binary, c binary, n binary"


def _bundles(sig: np.ndarray, who: np.ndarray, c: np.ndarray, n: np.ndarray, buckets: int, turn: int):
    """Entries (signature, class in the bundle * 8 + role) as one row for each
    bucket of signatures. Signatures that many classes here share are settled
    at once: their entries are dealt out anywhere, one witness goes to the
    bucket. Signatures are sorted and laid out byte by byte, which packs well."""
    order = np.argsort(sig, kind="stable")
    sig, who = sig[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(sig)))
    role = np.bitwise_or.reduceat(who & 3, first) if len(first) else size
    hot = (size >= 16) & (role == 3)
    own = np.repeat(hot, size)
    heads = first[hot]
    parts = [(sig[own], who[own], True), (np.concatenate([sig[~own], sig[heads]]), np.concatenate([who[~own], who[heads] | 3 | WITNESS]), False)]
    out = []
    for s, w, settled in parts:
        if settled:
            cuts = [(turn % buckets, 0, len(s))]
        else:
            order = np.argsort(s, kind="stable")
            s, w = s[order], w[order]
            where = (s >> U64(32)).astype(np.int64) * buckets >> 32
            at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(s) else np.empty(0, np.int64)
            cuts = [(int(where[i]), i, j) for i, j in zip(at.tolist(), np.append(at[1:], len(s)).tolist())]
        for bucket, i, j in cuts:
            if i == j:
                continue
            members, at = np.unique(w[i:j] >> 3, return_inverse=True)
            packed = np.ascontiguousarray(s[i:j].astype(">u8").view(np.uint8).reshape(-1, 8).T)
            out.append((bucket, settled, packed.tobytes(), ((at << 3) | (w[i:j] & 7)).astype(np.uint16).tobytes(), c[members].tobytes(), n[members].astype(np.uint32).tobytes()))
    if out:
        kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["bucket", "settled", "sig", "who", "c", "n"])


def _signed(batches: Iterator[pa.RecordBatch], k: int, percent: int, buckets: int):
    """Signatures of texts, each in both of its bands, in bundles."""
    parts, members, held, turn = [], [], 0, 0

    def flush():
        sig, who = (np.concatenate(x) for x in zip(*parts))
        c, n = (np.concatenate(x) for x in zip(*members))
        return _bundles(sig, who, c, n, buckets, turn)

    for batch in batches:
        for buf, offs in _opened(batch.column(0)):
            row, x = shingles(buf, offs, k)
            n, c = classes(row, x, len(offs) - 1)
            bands = Bands(percent, int(n.max(initial=1)))
            if parts and (held > ENTRIES or sum(len(m[0]) for m in members) + len(n) > MEMBERS):
                turn = turn or int(c[0] >> U64(40))
                yield from flush()
                parts, members, held, turn = [], [], 0, turn + 1
            before = sum(len(m[0]) for m in members)
            members.append((c, n))
            for own in (True, False):
                sig, rows, role = signatures(row, x, n, bands, own)
                parts.append((sig, (rows + before) << 3 | role))
                held += len(sig)
    if parts:
        turn = turn or int(members[0][0][0] >> U64(40))
        yield from flush()


def _shared(batches: Iterator[pa.RecordBatch]):
    """The entries of signatures that an indexed and a looking-up set share,
    with the number of sets that do. Bundles come in the order of buckets; one
    bucket at a time is held."""
    held, bucket = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            b, settled, s, w, c, n = (col[i].as_py() for col in batch.columns)
            sig = np.ascontiguousarray(np.frombuffer(s, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(U64)
            w = np.frombuffer(w, np.uint16).astype(np.int64)
            entry = (as_long(sig), np.frombuffer(c, np.int64)[w >> 3], np.frombuffer(n, np.uint32).astype(np.int64)[w >> 3] * 8 + (w & 7))
            if settled:
                yield from _told(*entry, True)
                continue
            if b != bucket and held:
                yield from _told(*(np.concatenate(x) for x in zip(*held)), False)
                held = []
            bucket = b
            held.append(entry)
    if held:
        yield from _told(*(np.concatenate(x) for x in zip(*held)), False)


def _told(sig: np.ndarray, c: np.ndarray, meta: np.ndarray, settled: bool):
    order = np.lexsort((c, sig))
    sig, c, meta = sig[order], c[order], meta[order]
    witness = (meta & WITNESS) > 0
    # a set that holds a signature more than once
    same = np.concatenate([[False], (sig[1:] == sig[:-1]) & (c[1:] == c[:-1]) & ~witness[1:] & ~witness[:-1]])
    head = np.flatnonzero(~same)
    role = np.bitwise_or.reduceat(meta & 3, head)
    sig, c, n, witness = sig[head], c[head], meta[head] >> 3, witness[head]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    some = np.bitwise_or.reduceat(role, first)
    keep = np.repeat(((size > 1) & (some == 3)) | settled, size) & ~witness
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, c, n * 4 + role, np.repeat(size, size))], ["sig", "c", "meta", "size"])


def _in_order(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows in pieces of about ``most`` rows; rows with the
    same first column stay together."""
    held, rows = [], 0

    def columns():
        return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= most:
            cols = columns()
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield [x[:cut] for x in cols]
                last = held[-1]
                rest = rows - cut
                if rest <= last.num_rows:
                    held, rows = [last.slice(last.num_rows - rest)], rest
                else:
                    kept, need = [], rest
                    for b in reversed(held):
                        take = min(need, b.num_rows)
                        kept.append(b.slice(b.num_rows - take))
                        need -= take
                        if not need:
                            break
                    held, rows = kept[::-1], rest
    if rows:
        yield columns()


def _across(batches: Iterator[pa.RecordBatch], percent: int):
    """The pairs of a group whose ends are in different components, sizes,
    roles and sides permitting. Rows come sorted by group."""
    for group, c, meta, root, side, odd in _in_order(batches):
        order = np.lexsort((root, group))
        group, c, meta, root, side = (x[order] for x in (group, c, meta, root, side))
        odd = np.frombuffer(b"".join(odd[order]), np.uint64).reshape(len(group), -1)
        n, role = meta >> 2, meta & 3
        first = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        seen: set[tuple[int, int]] = set()
        for lo, hi in zip(first[:-1], first[1:]):
            if root[lo] == root[hi - 1]:
                continue
            for i in range(lo, hi):
                j = np.arange(i + 1, hi)
                ok = (root[j] != root[i]) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
                ok &= ((role[i] & 1) & (role[j] >> 1) | (role[i] >> 1) & (role[j] & 1)).astype(bool)
                ok &= (side[j] == 0) | (side[j] != side[i])
                j = j[ok]
                j = j[np.bitwise_count(odd[j] ^ odd[i]).sum(1) <= (100 - percent) * (n[i] + n[j]) // (100 + percent)]
                seen.update((min(c[i], x), max(c[i], x)) for x in c[j].tolist())
                if len(seen) > 100_000:
                    yield _pairs(seen)
                    seen = set()
        yield _pairs(seen)


def _pairs(seen):
    a, b = zip(*seen) if seen else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], k: int, percent: int):
    """Pairs with their texts: those whose sets are similar enough. Hashes
    rule out, the shingles themselves confirm."""
    back = zstandard.ZstdDecompressor()
    last: dict[int, list] = {}

    def of(key, z):
        if key not in last:
            if len(last) > 64:
                last.clear()
            raw = back.decompress(z, max_output_size=1 << 31)
            last[key] = [raw, shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), k)[1], None]
        return last[key]

    def real(entry) -> set[bytes]:
        if entry[2] is None:
            w = entry[0].lower().split()
            entry[2] = {b" ".join(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)}
        return entry[2]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ok = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b)):
            p, q = of(x, batch.column(2)[i].as_py()), of(y, batch.column(3)[i].as_py())
            both = len(np.intersect1d(p[1], q[1], assume_unique=True))
            if 100 * both >= percent * (len(p[1]) + len(q[1]) - both):
                s, t = real(p), real(q)
                both = len(s & t)
                ok[i] = 100 * both >= percent * (len(s) + len(t) - both)
        yield batch.select([0, 1]).filter(pa.array(ok))


BLOCK = 2048  # sets of a signature that meet in one task


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of ``docs``: the size
    of its shingle set and the least id that similarity links reach. Runs at
    once; what it wrote on the way is deleted, but for the result."""
    spark = docs.sparkSession
    tables = Tables(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = tables.add(found.mapInArrow(partial(_sets, k=k), f"id {kind}, n long, c long, z binary, odd binary"), "sets")
    held = found.where("z is not null")
    entries = (
        held.select("z")
        .mapInArrow(partial(_signed, k=k, percent=percent, buckets=buckets), BUNDLE)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_shared, "sig long, c long, meta long, size long")
    )
    entries = tables.add(entries, "entries")
    nodes = tables.add(entries.groupBy("c").agg(F.sum("size").alias("degree")), "nodes")
    # one text for each class that shares a signature
    texts = held.select("c", "z", "odd").join(nodes, "c", "left_semi").groupBy("c").agg(F.first(F.struct("z", "odd")).alias("t"))
    texts = tables.add(texts.select("c", "t.*"), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("c").alias("a"), F.col("z").alias("za")), "a")
        both = both.join(texts.select(F.col("c").alias("b"), F.col("z").alias("zb")), "b").select("a", "b", "za", "zb")
        return both.mapInArrow(partial(_verified, k=k, percent=percent), "a long, b long")

    def star(of: DataFrame) -> DataFrame:
        """Each set against the hub of one of its signatures: the one that
        most of its signatures have as the hub."""
        hubs = of.join(nodes, "c").groupBy("sig").agg(F.max_by(F.struct("c", "root"), F.struct("degree", "c")).alias("h"))
        pairs = of.join(hubs, "sig").where("root <> h.root").groupBy("c", F.col("h.c").alias("b")).count()
        return pairs.groupBy("c").agg(F.max_by("b", F.struct("count", "b")).alias("b")).select(F.col("c").alias("a"), "b")

    def across(of: DataFrame) -> DataFrame:
        """All pairs within the signatures; large groups of sets are cut into
        blocks, and every two blocks meet in a task of their own."""
        sizes = of.groupBy("sig").agg(F.count("*").alias("k")).withColumn("k", F.ceil(F.col("k") / BLOCK).cast("int"))
        cut = of.join(sizes, "sig").withColumn("own", F.expr("pmod(xxhash64(c), k)")).withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
        cut = cut.join(texts.select("c", "odd"), "c").select(
            F.expr("CASE WHEN k = 1 THEN sig ELSE xxhash64(sig, least(own, other), greatest(own, other)) END AS grp"), "c", "meta", "root",
            F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END AS side"), "odd",
        )
        return cut.repartition("grp").sortWithinPartitions("grp").mapInArrow(partial(_across, percent=percent), "a long, b long").distinct()

    links = tables.add(verify(star(entries.withColumn("root", F.col("c")))), "links0")
    for turn in range(1, rounds + 1):
        rooted = entries.join(components(links).withColumnRenamed("node", "c"), "c", "left").select("sig", "c", "meta", F.coalesce("root", "c").alias("root"))
        open_ = rooted.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("sig")
        rooted = tables.add(rooted.join(open_, "sig", "left_semi"), f"rooted{turn}")
        links = links.union(tables.add(verify(across(rooted) if turn == rounds else star(rooted)), f"links{turn}"))
    roots = components(links).withColumnRenamed("node", "c")
    by_class = found.where("c is not null").groupBy("c").agg(F.min("id").alias("id"))
    by_class = by_class.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    by_root = by_class.groupBy("root").agg(F.min("id").alias("component_id"))
    named = by_class.join(by_root, "root").select("c", "component_id")
    some = found.where("c is not null").join(named, "c").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    none = found.where("c is null").select("id", "n", F.col("id").alias("component_id"))
    out = some.union(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    done = table(out, "classes")
    tables.drop()
    return done
