"""SimHash fingerprints, ball hashing and components against plain loops."""

import random
import re

import pytest
import xxhash

from flowdetect.llm import simhash

BASE = " ".join(f"w{i}" for i in range(300))


def plain_print(text, k=3):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, f) in enumerate(rows):
        for j in range(i):
            if (f ^ rows[j][1]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))]


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "one", "One Two", "ONE two", "é ß  x y\x0bz", "a b c"]
    for at in range(40):
        words = BASE.split()
        for _ in range(at % 5):
            words[rng.randrange(300)] = f"v{rng.randrange(9)}"
        out.append(" ".join(words))
    return out + [" ".join(rng.choices(BASE.split(), k=rng.randrange(1, 60))) for _ in range(60)] + [BASE] * 30


def test_fingerprints_and_components(spark):
    rows = [(i * 7 % 139 if i % 11 else None, t, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FINGERPRINT int").withColumnRenamed("FINGERPRINT", "_f").selectExpr("*", "1 AS `Component_ID`", "2 AS `a b`")
    got = {r["_f"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_print(t) for _, t, _ in rows]
    assert [got[i].fingerprint for i in range(len(rows))] == [f"{f:016x}" for f in prints]
    assert [got[i].component_id for i in range(len(rows))] == plain_components([(d, f) for (d, _, _), f in zip(rows, prints)], 2)
    assert len({r.component_id for r in got.values()}) < len(set(prints)) and all(r["a b"] == 2 for r in got.values())


def test_segments_do_not_change_prints():
    text = (BASE.upper() + "\n").encode() * 4
    whole = simhash.fingerprint(text, 3)
    was, simhash.SEGMENT = simhash.SEGMENT, 50
    try:
        parts = list(simhash.segments(text, 50))
        assert b"".join(parts) == text and len(parts) > 50
        assert [w for p in parts for w in p.split()] == text.split()
    finally:
        simhash.SEGMENT = was
    assert whole == plain_print(text.decode())
    long = b"x" * (3 << 20) + b" y z " + b"q r " * 600_000
    assert simhash.fingerprint(long, 3) == plain_print(long.decode())


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_are_complete(spark, radius):
    rng = random.Random(radius)
    prints = {0, 1, 3, 7, 1 << 63, (1 << 64) - 1}
    for _ in range(12):
        f = rng.getrandbits(64)
        prints |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(8)}
    prints = sorted(prints)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "f long")
    want = {(max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
    got = [tuple(r) for r in simhash.links(df, radius, every=True).collect()]
    assert set(got) == want and len(got) == len(want)
    some = {tuple(r) for r in simhash.links(df, radius).collect()}
    assert some <= want
    ids = [(f, f % (1 << 64)) for f in signed]

    def groups(pairs):
        root = {f: f for f in signed}
        for _ in signed:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert groups(some) == groups(want) and len(ids) == len(set(prints))


def test_empty_and_null_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(None, None), (None, "x"), (4, None)], "doc_id long, text string")
    got = sorted((r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("0" * 16, "4"), ("0" * 16, "4"), (f"{xxhash.xxh64_intdigest(b'x', 42):016x}", "None")])
