"""Steps of the suffix dedup hold a bounded number of rows, whatever their partition has."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard

from flowdetect.llm import suffix_dedup


def fed(rows, names, kinds, step, read):
    """Batches of ``step`` rows; ``read`` counts those taken."""
    for i in range(0, len(rows), step):
        read[0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + step]), kinds)], names)


def told(batches, read, all_):
    """Rows that come out, and whether any came before all batches were read."""
    out, early = [], False
    for b in batches:
        early |= read[0] < all_
        out += zip(*(c.to_pylist() for c in b.columns))
    return sorted(out), early


def test_runs_of_a_sorted_partition_are_read_along(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 16, raising=False)
    rng = random.Random(3)
    for step in (1, 7, 40):
        rows, k = [], 0
        for g in range(60):
            for t in range(rng.choice([1, 1, 2, 3, 60])):
                for _ in range(rng.choice([1, 2, 2, 50]) if g % 3 else 2):
                    k += 1
                    rows.append((g, t, k, k % 7, k % 11 * 4 + rng.choice([1, 1, 2])))
                    if rng.random() < 0.1:
                        rows.append((g, t, -k, 1, 8))  # decided: dealt by its text, not told apart by name
        want, groups = [], defaultdict(lambda: defaultdict(list))
        for g, t, k1, k2, meta in rows:
            if meta & 3:
                groups[g][t].append((k1, k2, meta))
            else:
                want.append((k1, k2, (meta >> 2) * 4 + suffix_dedup.DECIDED))
        for names in groups.values():
            twice = {t: sum(m & 3 for _, _, m in own) > 1 for t, own in names.items()}
            some = len(names) > 1 and not all(twice.values())
            for t, own in names.items():
                for i, (k1, k2, meta) in enumerate(own):
                    flag = (suffix_dedup.SHOWN if some and not i else suffix_dedup.DECIDED) if twice[t] else suffix_dedup.ASKED if some else 0
                    if flag:
                        want.append((k1, k2, (meta >> 2) * 4 + flag))
        read = [0]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        got, early = told(suffix_dedup._named(fed(rows, ["g", "t", "k1", "k2", "meta"], kinds, step, read)), read, -(-len(rows) // step))
        assert got == sorted(want) and early


def test_suffixes_of_a_sorted_partition_are_read_along(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HELD", 16, raising=False)
    rng = random.Random(4)
    for step in (1, 7, 40):
        rows, want = [], []
        for w in range(400):
            own = []
            for _ in range(rng.choice([1, 1, 2, 3, 70])):
                k = len(rows) + len(own)
                own.append((w, w % 5, k, k % 7, k * 8 + rng.choice([2, 3, 3, 4])))
            n = sum(m >> 1 & 3 for *_, m in own)
            want += [(k1, k2, m >> 3) for _, _, k1, k2, m in own if n > 1 and m & 1]
            rows += own
            if w % 9 == 0:
                rows.append((w, w % 5, -w, 2, w * 8))
                want.append((-w, 2, w))
        read = [0]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        got, early = told(suffix_dedup._merged(fed(rows, ["w", "v", "k1", "k2", "meta"], kinds, step, read)), read, -(-len(rows) // step))
        assert got == sorted(want) and early


def test_suffixes_of_a_batch_are_settled_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", 500, raising=False)
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 123, 900).astype(np.uint8).tobytes() for _ in range(20)]
    texts += texts[:4]
    ask = np.array([[0, 300], [250, 650], [1, 1]], np.int32).tobytes()  # 251 and 351 suffixes, asked
    z = [zstandard.ZstdCompressor().compress(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([1] * len(texts), pa.int32()), pa.array(z, pa.binary()), pa.array([ask] * len(texts), pa.binary())], ["k1", "k2", "z", "show"])
    parts = list(suffix_dedup._suffixes(iter([batch]), 200))
    assert max(p.num_rows for p in parts) <= 2 * 500 + 602
    rows = sorted(r for p in parts for r in zip(*(c.to_pylist() for c in p.columns)))
    rows.sort(key=lambda r: (r[0], r[1]))
    got = defaultdict(set)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    for b in suffix_dedup._merged(fed(rows, ["w", "v", "k1", "k2", "meta"], kinds, 1000, [0])):
        for k1, _, at in zip(*(c.to_pylist() for c in b.columns)):
            got[k1].add(at)
    all_ = {*range(251), *range(300, 651)}
    assert got == {i: all_ for i in (0, 1, 2, 3, 20, 21, 22, 23)}
