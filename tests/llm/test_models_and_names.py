"""Model types, user-defined pieces and byte fallback against the library;
columns whose names clash or hold odd characters; the pipeline row by row."""

import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from flowdetect.llm import licenses, oracles, pieces, suffix_dedup, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, scored, kind=1, given=(), fallback=True):
    """A model written out by hand: pieces with scores, no training."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(g, 0.0, 4) for g in given]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    rows += [(p, s, 1) for p, s in scored]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in rows)
    data += field(2, field(3, kind) + field(35, int(fallback))) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(data)
    return str(path)


def unigrams(total):
    names = ["▁", *"abcdenrst", "▁a", "an", "and", "▁and", "st", "er", "ter", "▁st", "ne", "t▁", "ate"]
    share = np.linspace(9, 1, len(names))
    return [(n, float(np.log(total * x / share.sum()))) for n, x in zip(names, share)]


@pytest.mark.parametrize("total,given", [(0.96, ()), (0.5, ()), (0.9, ("<br>", "ers"))])
def test_unigram_models_keep_their_scores(tmp_path, total, given):
    path = model_file(tmp_path / "m.model", unigrams(total), given=given)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Vocabulary(path)
    ids = {library.id_to_piece(i): i for i in range(library.get_piece_size())}
    assert all(own.scores[ids[p]] == pytest.approx(s, abs=1e-6) for p, s in unigrams(total))
    rng = np.random.default_rng(1)
    texts = ["and then", "a", "", "banners", "é and ü", "a  b", "stater<br>ands ers", "ersers<b"]
    texts += ["".join(rng.choice(list("abcdenrst  <>é"), rng.integers(1, 30))) for _ in range(300)]
    got = [np.frombuffer(b, np.int32).tolist() for b in pieces.encode_texts(texts, own)]
    assert got == [library.encode(t) for t in texts]


def test_numbered_models_get_ranks(tmp_path):
    numbered = [(p, -float(i)) for i, (p, _) in enumerate(unigrams(1))]
    bpe, unigram = model_file(tmp_path / "b.model", numbered, kind=2), model_file(tmp_path / "u.model", numbered)
    assert pieces.model_type(bpe) == 2 and pieces.model_type(unigram) == 1
    v = pieces.Vocabulary(bpe)
    assert np.exp(v.scores[-len(numbered) :]).sum() == pytest.approx(1) and pieces.Vocabulary(unigram).scores[-1] == -(len(numbered) - 1)


def test_names_with_backticks_and_clashes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "and a stater", 7)], "doc_id long, text string, `a``b` int")
    path = model_file(tmp_path / "m.model", unigrams(0.9))
    assert pieces.encode(docs, path).first()["a`b"] == 7 and pieces.encode(docs, path, digest=True).first()["a`b"] == 7
    assert licenses.scan(docs).first()["a`b"] == 7
    pages = spark.createDataFrame([(1, "http://x.net/a", 7)], "page_id long, url string, `a``b` int")
    got = url_filter.url_filter(pages, [("net/", "block")]).first()
    assert got["a`b"] == 7 and got.verdict == "block"
    names = spark.createDataFrame([("x " * 300, 5, 6, 8), ("y " + "x " * 300, 5, 6, 8)], "text string, _k1 int, _k2 int, kept int")
    assert {tuple(r)[1:] for r in suffix_dedup.without_repeats(names).collect()} == {(5, 6, 8)}


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return 100 * len(a & b) >= 80 * len(a | b) if a and b else False


def plain_cut(texts, length=200):
    """Texts without the bytes of strings of ``length`` that start twice."""
    raw, starts = [t.encode() for t in texts], Counter()
    for t in raw:
        starts.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode())
    return out


def test_pipeline_row_by_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = ["the", "of", "and", "to", "in", "is", "that", "for", *("".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 8))) for _ in range(300))]
    prose = lambda n: " ".join(rng.choice(words, n, p=[0.05] * 8 + [0.6 / 300] * 300))
    texts = [prose(int(n)) for n in rng.integers(60, 200, 30)]
    shared = prose(60)
    texts += [texts[0], texts[1].replace(texts[1].split()[40], "changed", 1), prose(80) + " " + shared, shared + " " + prose(90), "too short", None, "# % & | " * 200, prose(20) * 9]
    rows = [(i * 7 % 101, t, "en", "s{}".format("aab"[i % 3]), len(t or ""), f"row{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC + ", _row string, kept string, size string".replace(", kept string, size string", ""))
    docs = docs.selectExpr("*", "'k' AS kept", "'z' AS SIZE", "'h' AS _hist")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(docs.columns) < set(got[0].asDict()) and {(r.kept, r.SIZE, r["_hist"]) for r in got} == {("k", "z", "h")}

    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    fine = {r[0] for r in db.execute(f"SELECT doc_id FROM ({oracles.OP1}) WHERE kept").fetchall()}
    left = sorted(r for r in rows if r[0] in fine)
    root = {r[0]: r[0] for r in left}
    for _ in left:
        for a in left:
            for b in left:
                if a[1] == b[1] or jaccard(a[1], b[1]):
                    root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    left = [r for r in left if root[r[0]] == r[0]]
    assert 25 < len(left) < len(fine) < len(rows)
    cut = plain_cut([r[1] for r in left])
    assert cut != [r[1] for r in left]
    left = [(r[0], t, *r[2:4], len(t), *r[5:]) for r, t in zip(left, cut)]
    db.execute("DELETE FROM documents")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r[:5] for r in left])
    times = {i: taken // size for i, size, taken in db.execute(f"SELECT doc_id, size, taken FROM ({oracles.OP3}) WHERE size > 0").fetchall()}
    want = Counter({r: times.get(r[0], 0) for r in left})
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r["_row"]) for r in got) == +want and max(want.values()) == 2
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.tokenizer_file(corpus_pipeline.VOCABULARY))
    assert all(r.decoded == r.text and "".join(library.id_to_piece(i) for i in r.pieces).replace("▁", " ").strip() == r.text.strip() for r in got if "\n" not in r.text)
