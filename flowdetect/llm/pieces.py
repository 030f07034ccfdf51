"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array
trie of pieces with log probabilities, byte fallback, whitespace-marker decoding.

Spaces become the marker U+2581 and one marker is put in front. The best
segmentation has the greatest sum of scores; between equal sums the piece that
starts earlier wins at each end. A character that is no piece by itself may
become its UTF-8 bytes, at ``min score - 10`` a character. A marker that the text
itself contains is always spelled in bytes, so decoding restores every text.

No piece spans a space that follows another character, nor a line break, so
the Viterbi search runs on the chunks between; each worker keeps short chunks it
has met (a bounded number) and searches new ones together, position by position, in
arrays. Trie and scores come from a vocabulary file of fixed size and are sent
to the workers once.

Edge cases: a null text is encoded as an empty one: no pieces. Long texts are
encoded whole. Repeated rows are encoded alike, empty tables give empty
results. Extra columns pass through; ones that clash with the added names are
replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import map_arrow, without

MARK = "▁"
UNKNOWN = -10.0


class Trie:
    """Double-array trie over bytes: node s has child ``base[s] + byte`` if
    ``check`` there is s; ``value`` is the id of the piece that ends there."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        todo, free, top = [(0, 0, len(keys), 0)], 1, 1
        while todo:
            node, lo, hi, depth = todo.pop()
            if len(keys[lo][0]) == depth:
                value[node] = keys[lo][1]
                lo += 1
            kids, starts = [], []
            for i in range(lo, hi):
                if not kids or keys[i][0][depth] != kids[-1]:
                    kids.append(keys[i][0][depth])
                    starts.append(i)
            if not kids:
                continue
            while check[free] >= 0:
                free += 1
            offsets = np.array(kids)
            if top + 1024 > len(check):
                base, check, value = (np.concatenate([x, np.full(len(x), f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
            if len(kids) == 1 and free > kids[0]:
                at = free - kids[0]
            else:  # the first fit near the end of what is taken
                near = np.arange(max(1, top - 256 - kids[0]), max(1, top - kids[0]) + 1)
                at = int(near[(check[near[:, None] + offsets] < 0).all(1).argmax()])
            top = max(top, at + kids[-1] + 1)
            base[node] = at
            check[at + offsets] = node
            for k, s, e in zip(kids, starts, [*starts[1:], hi]):
                todo.append((at + k, s, e, depth + 1))
        self.base, self.check, self.value = base, check, value


UNIGRAM = 1  # fixed value: the model type of a trainer's specification


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte, at = data[at], at + 1
            out, shift = out | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


def model_type(path: str) -> int:
    """The type that the model file's trainer specification (field 2) names in
    its field 3; unigram where it names none."""
    with open(path, "rb") as f:
        spec = next((v for k, v in _fields(f.read()) if k == 2), b"")
    return next((v for k, v in _fields(spec) if k == 3), UNIGRAM)


def rank_scores(scores: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law over the ranks of pieces that a model
    numbers (0, -1, -2 ..) in place of scoring them."""
    rank = np.empty(len(scores))
    rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
    share = 1 / (rank + 2.7)
    return np.log(share / share.sum())


def _given(path: str, n: int) -> set[int]:
    """Ids of the user-defined pieces (field 3 of a piece is 4)."""
    with open(path, "rb") as f:
        kinds = [dict(_fields(v)).get(3, 1) for k, v in _fields(f.read()) if k == 1]
    return {i for i in range(n) if kinds[i] == 4}


class Vocabulary:
    """Pieces, scores and trie of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        given = _given(path, n)
        normal = [i for i in plain if i not in given]
        if model_type(path) != UNIGRAM:
            scores[normal] = rank_scores(scores[normal])
        for i in given:  # as in the library: near the score of certainty, so that they win over what they hold
            scores[i] = len(names[i].encode()) * max(scores[normal].max(), 0.0) - 0.1
        self.bytes = np.full(256, model.unk_id(), np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(names[i][3:-1], 16)] = i
        self.digest = zlib.crc32("\n".join(names).encode(), n)
        self.build({names[i]: i for i in plain}, scores, float(scores[normal].min()), [b"" if model.is_control(i) else bytes([int(names[i][3:-1], 16)]) if model.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)])

    def build(self, pieces: dict[str, int], scores: np.ndarray, least: float, spelled: list[bytes]) -> None:
        self.scores, self.spelled = scores, spelled
        # Trie keys are spelled with spaces: texts then need no rewriting, and a
        # marker in a text matches nothing.
        self.trie = Trie([(p.replace(MARK, " ").encode(), i) for p, i in pieces.items()])
        self.longest = max(len(p.replace(MARK, " ").encode()) for p in pieces)
        self.worst = least + UNKNOWN
        spaces = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        lines = any("\n" in p for p in pieces)
        self.cut = "(?s).+" if spaces else " *[^ ]+| +" if lines else " *[^ \n]+| +|\n"


def _search(words: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Best segmentation of each of a few words of like length."""
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    n, most = len(words), max(map(len, words))
    size = np.array([len(w) for w in words])
    text = np.zeros((n, most + 1), np.uint8)
    text[:, :most] = np.array(words, f"S{most}").view(np.uint8).reshape(n, most)
    best = np.full((n, most + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, most + 1), np.int32)
    piece = np.full((n, most + 1), -1, np.int32)
    lead = (text & 0xC0) != 0x80
    for p in range(most):
        row = np.flatnonzero((p < size) & lead[:, p] & (best[:, p] > -np.inf))
        if not len(row):
            continue
        byte = text[row, p]
        wide = 1 + (byte >= 0xC0).astype(np.int64) + (byte >= 0xE0) + (byte >= 0xF0)
        here, alone = best[row, p], np.zeros(len(row), bool)
        node, live = np.zeros(len(row), np.int64), np.arange(len(row))
        for d in range(1, min(v.longest, most - p) + 1):
            step = base[node] + text[row[live], p + d - 1]
            ok = (check[step] == node) & (p + d <= size[row[live]])
            live, node = live[ok], step[ok]
            if not len(live):
                break
            ids = value[node]
            end = ids >= 0
            alone[live[end]] |= wide[live[end]] == d
            gain = here[live[end]] + v.scores[ids[end]]
            r = row[live[end]]
            up = gain > best[r, p + d]
            best[r[up], p + d], back[r[up], p + d], piece[r[up], p + d] = gain[up], p, ids[end][up]
        lost = np.flatnonzero(~alone)
        r, e = row[lost], p + wide[lost]
        gain = here[lost] + v.worst
        up = gain > best[r, e]
        r, e = r[up], e[up]
        best[r, e], back[r, e], piece[r, e] = gain[up], p, -1
    # Walk back from the ends, all words at once; the last pieces come first.
    steps, at, rows = [], size.copy(), np.arange(n)
    while len(rows):
        steps.append(np.full(n, -2, np.int32))
        steps[-1][rows] = piece[rows, at[rows]]
        at[rows] = back[rows, at[rows]]
        rows = rows[at[rows] > 0]
    ids = np.stack(steps[::-1], 1)
    used = (ids != -2).sum(1)
    spelled = (ids == -1).any(1)
    return [_spell(w, back[i], piece[i], v) if spelled[i] else ids[i, len(steps) - used[i] :] for i, w in enumerate(words)]


def _spell(w: bytes, back, piece, v: Vocabulary) -> np.ndarray:
    ids, at = [], len(w)
    while at:
        ids.extend([piece[at]] if piece[at] >= 0 else (v.bytes[b] for b in reversed(w[back[at] : at])))
        at = back[at]
    return np.array(ids[::-1], np.int32)


def _search_long(w: bytes, v: Vocabulary) -> np.ndarray:
    """The same for one long word, in time linear in its length."""
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    best, back, piece = [-np.inf] * (len(w) + 1), [0] * (len(w) + 1), [-1] * (len(w) + 1)
    best[0] = 0.0
    for p, byte in enumerate(w):
        if byte & 0xC0 == 0x80 or best[p] == -np.inf:
            continue
        wide = 1 + (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
        node, alone = 0, False
        for d in range(p, min(p + v.longest, len(w))):
            step = base[node] + w[d]
            if check[step] != node:
                break
            node = step
            if value[node] >= 0:
                alone |= d + 1 - p == wide
                gain = best[p] + v.scores[value[node]]
                if gain > best[d + 1]:
                    best[d + 1], back[d + 1], piece[d + 1] = gain, p, value[node]
        if not alone and best[p] + v.worst > best[p + wide]:
            best[p + wide], back[p + wide], piece[p + wide] = best[p] + v.worst, p, -1
    return _spell(w, back, piece, v)


# What a worker remembers of one vocabulary: chunks of up to KEPT_BYTES bytes,
# KEPT_WORDS of them at most.
_memory: dict = {"digest": None, "known": {}}
KEPT_WORDS, KEPT_BYTES = 250_000, 48
LONG = 256


def encode_texts(texts: list[str], v: Vocabulary) -> list[bytes]:
    """Ids (little-endian int32) of each text."""
    if _memory["digest"] != v.digest or len(_memory["known"]) > KEPT_WORDS:
        _memory.update(digest=v.digest, known={})
    known = _memory["known"]
    cut = re.compile(v.cut)
    parts = [cut.findall(" " + t) if t else [] for t in texts]
    found = [list(map(known.get, p)) for p in parts]
    open_ = [i for i, f in enumerate(found) if None in f]
    new = sorted({w for i in open_ for w, f in zip(parts[i], found[i]) if f is None}, key=len)
    i = 0
    while i < len(new):
        raw = [new[i].encode()]
        if len(raw[0]) > LONG:
            known[new[i]] = _search_long(raw[0], v).tobytes()
            i += 1
            continue
        k = i + 1
        while k < len(new) and k - i < 8192 and len(new[k]) <= len(new[i]) + 2:
            raw.append(new[k].encode())
            k += 1
        for w, ids in zip(new[i:k], _search(raw, v)):
            known[w] = ids.tobytes()
        i = k
    for k in open_:
        found[k] = map(known.__getitem__, parts[k])
    out = list(map(b"".join, found))
    for w in new:
        if len(w) > KEPT_BYTES:
            del known[w]
    return out


def decode_ids(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text's bytes: pieces with markers as spaces, bytes as they are,
    less the space in front."""
    return b"".join(map(v.spelled.__getitem__, ids.tolist()))[1:]


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary, at: int, digest: bool):
    v = vocabulary.value
    is_byte = np.zeros(len(v.scores), bool)
    is_byte[v.bytes] = True
    for batch in batches:
        texts = pc.fill_null(batch.column(at), "").to_pylist()
        for lo in range(0, len(texts), 512):
            part = texts[lo : lo + 512]
            ids = [np.frombuffer(b, np.int32) for b in encode_texts(part, v)]
            back = [decode_ids(i, v) for i in ids]
            cols = [c.slice(lo, len(part)) for c in batch.columns]
            if digest:
                del cols[at]
                cols += [pa.array([len(i) for i in ids], pa.int64()), pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
                cols.append(pa.array([b == t.encode() for b, t in zip(back, part)]))
            else:
                cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32), np.concatenate(ids)))
                cols.append(pa.array([b.decode() for b in back]))
            yield pa.RecordBatch.from_arrays(cols, [str(i) for i in range(len(cols))])


def encode(docs: DataFrame, path: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """Adds ``pieces`` (array<int>) and ``decoded``, the text read back from
    them; or with ``digest`` n_pieces, n_byte_pieces, ids_crc32 and round_trip
    in place of the text."""
    added = "n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean" if digest else "pieces array<int>, decoded string"
    docs = docs.select(*(F.col("`" + c.replace("`", "``") + "`") for c in without(docs, [a.split()[0] for a in added.split(", ")])))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    given = [f for f in docs.schema.fields if not (digest and f.name == text_col)]
    return map_arrow(docs, partial(_encoded, vocabulary=vocabulary, at=docs.columns.index(text_col), digest=digest), given, added)
