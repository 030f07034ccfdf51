"""Names that clash, null, repeated and far ids, long texts, empty tables."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from flowdetect.llm import common, hmm, imatch, licenses, mixing, ngram_join, pieces, quality, suffix_dedup, token_files, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the woods where nobody can see it any more"


def docs_of(spark, texts, ids=None, source="s1"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in zip(ids, texts)], DOC)


def test_quality_names_and_languages(spark):
    docs = docs_of(spark, [PROSE, None, PROSE]).selectExpr("*", "7 AS _w", "8 AS N_WORDS", "'x' AS __t", "1 AS _refs", "2 AS _hist")
    got = quality.quality_rules(docs).collect()
    assert {r.n_words for r in got} == {len(PROSE.split()), 0} and all(r["_w"] == 7 and r["__t"] == "x" for r in got)
    odd = " ".join(f"#%&!{i}{i}{i}" for i in range(300))
    rows = [(0, " ".join([PROSE] * 3), "en"), (1, odd, None), (2, odd, "sw")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[1] and got[2]


def test_mixing_names_nulls_and_reruns(spark):
    docs = docs_of(spark, [PROSE, PROSE, None, "a b", PROSE], [1, 1, None, None, 5]).selectExpr("*", "1 AS _h", "2 AS _z", "3 AS SIZE", "4 AS __k")
    runs = [sorted((str(r.doc_id), r.size, r.taken, r["_h"], r["_z"], r["__k"]) for r in mixing.mix(docs).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 5 and all(r[3:] == (1, 2, 4) for r in runs[0])
    assert [c.lower() for c in mixing.mix(docs).columns].count("size") == 1
    assert set(mixing.repeat(mixing.mix(docs)).columns) == set(docs.columns) - {"SIZE"}


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i * 7 % 23)), "en", f"s{i % 4}", 1) for i in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, DOC), digits=1).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 28 for s in target)


def test_far_and_null_ids(spark):
    ids = [-(2**63), 5, 2**63 - 1, 7, None, None, 6]
    texts = [f"{PROSE} number {i}" for i in range(len(ids))]
    docs = docs_of(spark, texts, ids)
    got = sorted(imatch.fingerprints(docs, least=0.01, most=1.0, min_df=1).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    order = [texts[2], texts[3], texts[6], texts[1], texts[0], texts[4], texts[5]]
    import hashlib

    want = []
    for t, nxt in zip(order, order[1:] + order[:1]):
        want.append(hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest())
    assert [r.edited_sha256 for r in got] == want
    groups = {(r.doc_id, r.n_shingles) for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    assert len(groups) == 6
    assert token_files.read_documents(token_files.write_tokens(docs, common.tokenizer_file("word_bpe_49k.json"))).count() == 7
    assert hmm.scores(docs, states=2, rounds=1).where("score < 0").count() == 7


def test_one_row_and_ties(spark):
    docs = docs_of(spark, [PROSE] * 3, [4, 4, 4])
    got = imatch.fingerprints(docs, least=0.01, most=1.0, min_df=1).collect()
    assert len(got) == 3 and {r.near_next for r in got} == {1.0}
    assert {r.near_next for r in imatch.fingerprints(docs_of(spark, [PROSE]), 0.01, 1.0, 1).collect()} == {1.0}
    assert {r.component_id for r in ngram_join.near_duplicates(docs, 4, 85).collect()} == {4}


URLS = ["https://a.Example.NET/en/1", "http://x.net", "http://x.net/", "ftp://example.com/de/?q", "nothing", None, "http://notnet/", "http://m.b.org/fr/x#y", "http://.net/", "http://" + "a." * 20_000 + "org/fr/1", "x://" + "b" * 50_000 + "net/"]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_url_filter_long_hosts_and_join(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, _url int")
    a = {tuple(r) for r in url_filter.url_filter(pages, RULES).collect()}
    b = {tuple(r) for r in url_filter.url_filter(pages, RULES, max_rules=2).collect()}
    assert a == b and len(a) == len(URLS)
    assert {r[0]: r[-2] for r in a} == {0: "example.net/en/", 1: None, 2: "net/", 3: "example.com/de/", 4: None, 5: None, 6: None, 7: "org/fr/", 8: "net/", 9: "org/fr/", 10: None}
    assert len(url_filter.candidates("a." * 20_000 + "org", "/fr/1", [4, 1], 11)) <= 14
    none = pages.limit(0)
    assert url_filter.url_filter(none, RULES).count() == 0 == url_filter.url_filter(none, RULES, max_rules=0).count()
    empty = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in url_filter.url_filter(pages, empty).collect()} == {"allow"}


def test_empty_license_table(spark):
    assert licenses.scan(docs_of(spark, [])).count() == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_cancel_powers_differ(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    h = common.words_of(raw, np.array([0, len(raw)]))[3]
    assert h[0] != h[1]
    docs = docs_of(spark, [f"{a} one two three", f"{b} one two three"])
    assert {r.component_id for r in ngram_join.near_duplicates(docs, 4, 85).collect()} == {0, 1}


def test_suffix_segments(monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 103, 5000).astype(np.uint8)
    whole = suffix_dedup.Block(raw, np.array([0, len(raw)]), 200)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    cut = suffix_dedup.Block(raw, np.array([0, len(raw)]), 200)
    for b in (whole, cut):
        assert np.array_equal(suffix_dedup._spread(b.l, b.r), np.arange(len(raw) - 199))
    # runs that no edge cuts are named alike
    assert len(set(whole.t.tolist()) & set(cut.t.tolist())) > len(whole.t) - 2 * 8


def test_suffix_digests(spark, tmp_path):
    import hashlib

    from flowdetect.llm import queries

    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefg "), n))
    passage = word(260)
    texts = [word(300) + passage + word(50), passage + word(400) + passage[10:250], word(150), None, "é" * 120, "x" * 401]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    n = Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    for r in queries.op6_suffix_dedup(spark, str(tmp_path)).collect():
        t = raw[r.doc_id]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone[: len(t)].sum()), spans, hashlib.sha256(kept).hexdigest())


def brute_pieces(text, v):
    """Best segmentation by trying all, as (score, ids)."""
    raw = (" " + text).encode()
    known = {}

    def best(at):
        if at == len(raw):
            return 0.0, []
        if at not in known:
            options = [(v.scores[i] + best(at + len(p))[0], [i, *best(at + len(p))[1]]) for p, i in pairs if raw.startswith(p, at)]
            wide = next(n for n in range(1, 5) if at + n == len(raw) or raw[at + n] & 0xC0 != 0x80)
            if not any(len(p) == wide and raw.startswith(p, at) for p, _ in pairs):
                options.append((v.worst + best(at + wide)[0], [*(int(v.bytes[b]) for b in raw[at : at + wide]), *best(at + wide)[1]]))
            known[at] = max(options, key=lambda x: x[0])
        return known[at]

    pairs = [(v.spelled[i], i) for i in v.trie.value[v.trie.value >= 0].tolist()]
    return best(0)


def test_pieces_are_the_best():
    v = pieces.Vocabulary(common.tokenizer_file("piece_bpe_32k.model"))
    shares = np.exp([v.scores[i] for i in v.trie.value[v.trie.value >= 0]])
    assert shares.sum() == pytest.approx(1)
    texts = ["unbelievable things", "zzz日é", "a  b", "tokenisation\nof words", "▁x"]
    for text, ids in zip(texts, pieces.encode_texts(texts, v)):
        ids = np.frombuffer(ids, np.int32).tolist()
        score, want = brute_pieces(text, v)
        assert pieces.decode_ids(np.array(ids), v).decode() == text
        spelled = set(v.bytes.tolist())
        n_bytes = [i for i in ids if i in spelled]
        if not n_bytes:
            assert sum(v.scores[i] for i in ids) == pytest.approx(score)
        assert ids == want, text
    long = "ab" * 300
    assert np.array_equal(np.frombuffer(pieces.encode_texts([long], v)[0], np.int32), brute_pieces(long, v)[1])


def test_expected_counts_are_exact(monkeypatch):
    rng = np.random.default_rng(1)
    m = hmm.Model(np.array([0.2, 0.3, 0.5]), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)

    def brute(s):
        total, start, move, emit = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        for q in product(range(3), repeat=len(s)):
            p = m.start[q[0]] * m.emit[s[0], q[0]]
            for t in range(1, len(s)):
                p *= m.move[q[t - 1], q[t]] * m.emit[s[t], q[t]]
            total += p
            start[q[0]] += p
            for t in range(1, len(s)):
                move[q[t - 1], q[t]] += p
            for t in range(len(s)):
                emit[s[t], q[t]] += p
        return np.log10(total), start / total, move / total, emit / total

    seqs = [np.array(x) for x in ([1], [0, 4, 2], [3, 3, 1, 0], [2, 2, 1, 0, 4, 1, 2, 3, 3])]
    want = [brute(s) for s in seqs]
    assert np.allclose(m.forward(seqs), [w[0] for w in want])
    for got, k in zip(m.expected(seqs), (1, 2, 3)):
        assert np.allclose(got, sum(w[k] for w in want))
    monkeypatch.setattr(hmm, "BLOCK", 4)  # long texts by blocks
    for s, w in zip(seqs, want):
        assert np.allclose(m.forward([s])[0], w[0])
        assert all(np.allclose(x, y) for x, y in zip(m.expected([s]), w[1:]))


def test_scores_against_a_plain_model(spark):
    """With one state the model is a unigram of symbols: its score is known."""
    texts = [f"{PROSE} {'rare' + str(i)}" for i in range(20)]
    got = {r.doc_id: r for r in hmm.scores(docs_of(spark, texts), states=1, rounds=2, symbols=60).collect()}
    train = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in [*texts[i].split(), None])
    n = sum(c.values())
    often = {w for w in c if w is None or c[w] > n / 60}
    raw = {w: np.frombuffer(w.encode(), np.uint8) for t in texts for w in t.split()}
    kind = {w: int(hmm._words(b, np.array([0, len(b)]))[2][0]) for w, b in raw.items()}
    totals, distinct = Counter(), Counter()
    for w in c:
        if w not in often:
            totals[kind[w]] += c[w]
            distinct[kind[w]] += 1
    size = len(often) + hmm.CLASSES
    count = lambda w: c[w] if w in often else totals[kind[w]]
    for i, t in enumerate(texts):
        want = 0.0
        for w in [*t.split(), None]:
            p = (count(w) + 1) / (n + size)
            e = (count(w) + p) / (n + 1)
            want += np.log10(e)
            if w not in often:
                want += np.log10((c[w] + 1) / (totals[kind[w]] + distinct[kind[w]] + 1))
        assert got[i].score == pytest.approx(want, rel=1e-6)
