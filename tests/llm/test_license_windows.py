import random

from flowdetect.llm import licenses

GPL = licenses.TEMPLATES["gpl-3.0-notice"]
GRANT = licenses.TEMPLATES["mit-grant"]
MIT = f"""{GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: the above copyright notice shall be included."""


def wrapped(text, width=7, sign="# "):
    w = text.split()
    return "\n".join(sign + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def brute(text, least=0.8):
    words = licenses.normal(text)
    tops = {}
    for name, t in licenses.TEMPLATES.items():
        g = licenses.bigrams(licenses.normal(t))
        b = g.total()
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 2 * b + 2) + 1):
                score = 2 * (licenses.bigrams(words[i:j]) & g).total() / (j - i - 1 + b)
                if score >= least:
                    tops[name] = max(tops.get(name, (0, 0)), (score, b))
    if not tops:
        return None, 0.0
    name = min(tops, key=lambda x: (-tops[x][0], -tops[x][1], x))
    return name, round(tops[name][0], 6)


def test_notices_within_texts(spark):
    code = "\n".join(f"int f{i}(int x) {{ return x + {i}; }}" for i in range(60))
    texts = [
        f"{wrapped(GPL)}\n{code}",
        f"/*\n{wrapped(GRANT, 9, ' * ')}\n */\n{code}",
        f"Copyright A. Author\n\n{MIT}\n{code}",
        f"Some words come first, and then this paragraph goes on: released under the MIT license, as it says, and more words follow it here.\n{code}",
        "Released under the MIT License.\nother\nReleased under the MIT License.",
        code,
        "under the " * 300,
        licenses.TEMPLATES["apache-2.0-notice"],
        "released under",
        "the MIT License",
        None,
    ]
    rng = random.Random(4)
    pool = [w for t in licenses.TEMPLATES.values() for w in t.split()[:6]]
    for t in licenses.TEMPLATES.values():
        w = t.split()
        for _ in range(2):
            texts.append(" ".join([*rng.choices(pool, k=20), *(x for x in w if rng.random() > 0.06), *rng.choices(pool, k=20)]))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(11)] == ["gpl-3.0-notice", "mit-grant", "mit-grant", "mit", "mit", None, None, "apache-2.0-notice", None, None, None]
    assert [got[i].n_matches for i in range(6)] == [1, 1, 1, 1, 2, 0]
    for i, t in enumerate(texts):
        assert (got[i].license, got[i].score) == brute(t or ""), i
