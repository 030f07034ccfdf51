"""License scan: word windows of texts against licence templates by the Dice
coefficient of their word bigrams.

Text is normalised (A-Z lower-cased, runs of characters other than letters and
digits, line ends too, become one space). Candidates are all windows of
consecutive words. The Dice coefficient of a window of a bigrams with a template
of b is 2 |A and B| / (a + b); it can reach ``least`` only if a and |A and B|
are at least least * b / (2 - least) and a at most (2 - least) * b / least. The
best window starts and ends with a bigram of the template, so windows grow from
one such bigram to the next, only where enough of them stand close together,
with counts kept up to date from step to step.

Edge cases: a null or empty text has no candidates: no licence, score 0. Ties
between templates go to the longer one, then to the first by name. Repeated rows
are scanned alike, long texts as a whole; empty tables give empty results; other
columns pass through, ones that clash with the added names are replaced.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from flowdetect.llm.common import map_arrow

# Notices as they stand in files.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> list[str]:
    return _OTHER.sub(" ", text.lower()).split()


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Templates:
    def __init__(self, texts: dict[str, str], least: float):
        self.least = least
        grams = [(name, bigrams(normal(t))) for name, t in texts.items()]
        # the first of equal scores wins
        self.grams = sorted(((name, g) for name, g in grams if g), key=lambda x: (-x[1].total(), x[0]))
        self.word = {w: k for k, w in enumerate(sorted({w for _, g in self.grams for pair in g for w in pair}), 1)}
        pairs = sorted({pair for _, g in self.grams for pair in g})
        self.gram = np.zeros((len(self.word) + 1,) * 2, np.int16)
        for k, (v, w) in enumerate(pairs, 1):
            self.gram[self.word[v], self.word[w]] = k
        self.count = [[0, *(g[pair] for pair in pairs)] for _, g in self.grams]
        self.has = np.array(self.count, bool).reshape(len(self.grams), -1)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words, 0 for words that no template has and at the end."""
        return np.fromiter(map(self.word.get, [*words, ""], repeat(0)), np.int16, len(words) + 1)

    def windows(self, numbers: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[float, int, int, int]]]:
        """Of texts laid end to end: by text, the best window of each start as
        (-score, template, first word, last word)."""
        kinds = self.gram[numbers[:-1], numbers[1:]]
        at = np.flatnonzero(kinds)
        kinds, rows, out = kinds[at], np.searchsorted(offs, at, "right") - 1, {}
        for t, (_, g) in enumerate(self.grams):
            b, some = g.total(), self.has[t][kinds]
            need, most = math.ceil(self.least * b / (2 - self.least) - 1e-9), math.floor((2 - self.least) * b / self.least + 1e-9)
            need = max(need, 1)
            p, y, r = at[some], kinds[some], rows[some]
            n = len(p) - need + 1
            if n <= 0:
                continue
            for i in np.flatnonzero((p[need - 1 :] - p[:n] < most) & (r[need - 1 :] == r[:n])).tolist():
                end = int(np.searchsorted(p, p[i] + most))
                left, m, top = self.count[t].copy(), 0, None
                for q, k, row in zip(p[i:end].tolist(), y[i:end].tolist(), r[i:end].tolist()):
                    if row != r[i]:
                        break
                    if left[k]:
                        left[k] -= 1
                        m += 1
                        score = 2 * m / (q - int(p[i]) + 1 + b)
                        if score >= self.least and (top is None or -score < top[0]):
                            top = (-score, t, int(p[i]), q + 1)
                if top is not None:
                    out.setdefault(int(r[i]), []).append(top)
        return out


def _disjoint(windows: list[tuple[float, int, int, int]]) -> int:
    """Windows that share no word, taken best first."""
    starts, ends = [], []
    for _, _, lo, hi in sorted(windows):
        k = bisect.bisect_left(starts, lo)
        if (k == 0 or ends[k - 1] < lo) and (k == len(starts) or hi < starts[k]):
            starts.insert(k, lo)
            ends.insert(k, hi)
    return len(starts)


def _scanned(batches: Iterator[pa.RecordBatch], templates: Templates, at: int):
    for batch in batches:
        found: list[tuple[str | None, float, int]] = []
        part, words = [], 0

        def flush():
            hits = templates.windows(np.concatenate(part), np.cumsum([0] + [len(x) for x in part])) if part else {}
            for k in range(len(part)):
                top = min(hits[k]) if k in hits else None
                found.append((templates.grams[top[1]][0], round(-top[0], 6), _disjoint(hits[k])) if top else (None, 0.0, 0))

        for text in pc.fill_null(batch.column(at), "").to_pylist():
            part.append(templates.numbers(normal(text)))
            words += len(part[-1])
            if words > 1 << 20:
                flush()
                part, words = [], 0
        flush()
        name, score, hits = zip(*found) if found else ((), (), ())
        cols = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(hits, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, [str(i) for i in range(len(cols))])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with license (best template or null), score
    and n_matches (windows that match and share no word, taken best first)."""
    docs = docs.drop("license", "score", "n_matches")
    given = [f for f in docs.schema.fields if f.name != text_col]
    run = partial(_scanned, templates=Templates(templates, least), at=docs.columns.index(text_col))
    return map_arrow(docs, run, given, "license string, score double, n_matches long")
