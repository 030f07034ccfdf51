import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowdetect.llm import hmm, imatch, licenses, mixing, ngram_join, pieces, quality, suffix_dedup, token_files, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab, n))
    base, passage = prose(300), prose(70)
    near = base.split()
    near[150] = "changed"
    out = [base, base, " ".join(near), passage + " " + prose(90), prose(50) + "\n" + passage, "", None, "one two", "One TWO", "x" * 5000, "De " * 400, "日本語 é😀 ▁ a\t\nb", prose(3000)]
    return [(i, t, ["en", None, "xx"][i % 3], ["s1", "s2", None][i % 3], len(t or "")) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def sets(rows, k):
    out = {}
    for r in rows:
        w = WORDS.findall((r[1] or "").lower())
        out[r[0]] = {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def test_near_duplicates(docs, none, rows):
    s = sets(rows, 4)
    root = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                if s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 4, 85).collect()}
    assert got == {i: (len(s[i]), root[i]) for i in s}
    assert ngram_join.near_duplicates(none).count() == 0


def brute_cut(rows, size=200):
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    n = Counter(t[i : i + size] for t in texts.values() for i in range(len(t) - size + 1))
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if n[t[i : i + size]] > 1:
                gone[i : i + size] = True
        out[d] = bytes(b for b, g in zip(t, gone) if not g)
    return out


def test_suffix_dedup(spark, docs, none, rows):
    want = brute_cut(rows)
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert {d: (t or "").encode() for d, t in got.items()} == want
    assert suffix_dedup.without_repeats(none).count() == 0


def test_quality_rules(docs, none, rows):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert len(got) == len(rows) and not got[5].kept and got[6].base_failed and got[10].base_failed and got[12].kept
    assert got[10].n_words == 400 == got[10].n_repeat_words
    assert got[6].text is None and quality.quality_rules(none).count() == 0
    odd = " ".join(["#%&!" + str(i) * 3 for i in range(300)])
    assert not [r for r in quality.quality_rules(docs.union(docs.sparkSession.createDataFrame([(99, odd, "en", "s1", 1)], DOC))).collect() if r.doc_id == 99][0].kept


def test_mixing(docs, none, rows):
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in got:
        assert r.size == len(WORDS.findall(r.text or "")) and r.taken <= 2 * r.size
        size[r.source] += r.size
    left, open_, target = 1.5 * sum(size.values()), dict(zip(["s1", "s2", None], (5, 2, 1))), {}
    while True:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            del open_[s]
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    assert all(r.target == pytest.approx(target[r.source]) for r in got)
    assert mixing.repeat(mixing.mix(docs)).count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix(none).count() == 0


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def test_pieces(docs, none, rows):
    got = pieces.encode(docs, VOCABULARY).collect()
    assert all(r.decoded == (r.text or "") for r in got)
    v = pieces.Vocabulary(VOCABULARY)
    assert [v.spelled[i] for i in next(r.pieces for r in got if r.doc_id == 7)][0].startswith(b" ")
    assert all(r.round_trip for r in pieces.encode(docs, VOCABULARY, digest=True).collect()) and pieces.encode(none, VOCABULARY).count() == 0


def test_url_filter(spark):
    urls = ["https://a.Example.NET/en/1", "http://x.net", "http://x.net/", "ftp://example.com/de/?q", "nothing", None, "http://notnet/", "http://m.b.org/fr/x#y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    got = [(r.host, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).orderBy("page_id").collect()]
    assert got == [("a.example.net", "example.net/en/", "allow"), ("x.net", None, "allow"), ("x.net", "net/", "block"), ("example.com", "example.com/de/", "block"), ("", None, "allow"), ("", None, "allow"), ("notnet", None, "allow"), ("m.b.org", "org/fr/", "allow")]
    assert {r.verdict for r in url_filter.url_filter(pages, []).collect()} == {"allow"}


def test_licenses(spark):
    d = spark.createDataFrame([(1, "prose here\nReleased under the MIT license!\nmore"), (2, "prose"), (3, None), (4, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(d).collect()} == {1: "mit", 2: None, 3: None, 4: "apache-2.0"}


def test_imatch(docs, none, rows):
    got = {r.doc_id: r for r in imatch.fingerprints(docs, least=0.05, most=0.9, min_df=1).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    order = sorted(texts, reverse=True)
    for d, nxt in zip(order, order[1:] + order[:1]):
        n = len(texts[d])
        edited = texts[d][: n - n // 2] + texts[nxt][: n // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1 and got[6].near_next == 1
    assert imatch.fingerprints(none).count() == 0


def test_token_files(docs, none, rows):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/word_bpe_49k.json"
    got = {r.doc_id: r for r in token_files.read_documents(token_files.write_tokens(docs, path, length=64)).collect()}
    t, at = Tokenizer.from_file(path), 0
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_documents(token_files.write_tokens(none, path)).count() == 0


def test_hmm(docs, none, rows):
    got = {r.doc_id: r for r in hmm.scores(docs, states=2, rounds=1).collect()}
    words = {r[0]: [*WORDS.findall((r[1] or "").lower()), None] for r in rows}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n = sum(c.values())
    for d, ws in words.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[d].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws)) and got[d].score < 0
    assert hmm.scores(none).count() == 0


def test_forward_is_exact():
    from itertools import product

    rng = np.random.default_rng(1)
    m = hmm.Model(np.array([0.2, 0.3, 0.5]), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    for s in ([1], [0, 4, 2], [3, 3, 1, 0]):
        p = sum(m.start[q[0]] * m.emit[s[0], q[0]] * np.prod([m.move[q[t - 1], q[t]] * m.emit[s[t], q[t]] for t in range(1, len(s))]) for q in product(range(3), repeat=len(s)))
        assert m.forward([np.array(s)])[0] == pytest.approx(np.log10(p))


def test_pipeline_keeps_clean_documents(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {0, 3, 4, 12} and all(r.decoded == r.text for r in got)
