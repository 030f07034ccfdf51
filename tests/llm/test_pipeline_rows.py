import numpy as np
import pytest

import corpus_pipeline
from flowdetect.llm.common import table

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(400)]
    out = [" ".join(rng.choice(vocab, 300)) for _ in range(5)]
    near = out[2].split()
    near[150] = "changed"
    return [*out, " ".join(near)]


def test_each_group_keeps_one_row(spark, texts, tmp_path):
    a, b, c, d, e, near_c = texts
    # a: a repeated row; b: a copy without an id; c: a near copy shares an id with d; e: two copies, both without an id
    rows = [(1, a), (1, a), (2, b), (None, b), (3, c), (4, near_c), (4, d), (None, e), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in rows], DOC)
    want = sorted([(1, a), (2, b), (3, c), (4, d), (None, e)], key=str)
    kept = table(corpus_pipeline.near_duplicates(spark, docs, ""), "kept")
    assert kept.columns == docs.columns and sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == want
    cut = corpus_pipeline.repeated_passages(spark, kept, "")
    assert sorted([(r.doc_id, r.text) for r in cut.collect()], key=str) == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(want)
