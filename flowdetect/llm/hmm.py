"""Hidden Markov language model over words.

Observations: frequent words (more than 1 / ``symbols`` of all training tokens,
so fewer than ``symbols`` words whatever the corpus), the end of a text, and 256
classes of other words by their last letters. Within a class a word has
probability (c + 1) / (C + D + 1), c its count, C the class's tokens, D its
distinct words; all unseen words of a class share the last 1. Model and class
factor together give exact probabilities of whole texts.

Counts of words come from all training tokens. Baum-Welch runs over all training
texts: every task computes expected transition and emission counts by scaled
forward and backward recursions, vectorised across its texts; Spark sums them
by symbol; the driver holds the model alone, whose size is fixed. The likelihood
of a text is its scaled forward recursion, carried over its whole length. Texts
of like length advance together; a very long one goes by blocks, whose states at
the edges are carried over, so its counts and score are exact as well.

Words stand under 64-bit hashes. Texts are turned to symbols once, into a table
in the shared folder. Rare words are joined with their counts by Spark; frequent
ones are broadcast (bounded as above).

Edge cases: null and empty texts are the end alone. Without training texts the
model is uniform and the base score is that of zero counts. A null id counts as
an empty one in the split. Repeated rows are scored alike; empty tables give
empty results; extra columns are ignored; long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import _BYTE, _LOWER, U64, as_long, chunks, mix, table, words_of

END = np.int64(0x7E4D5F3C2B1A0918)
CLASSES = 256


def _words(buf: np.ndarray, offs: np.ndarray):
    """(row, hash, class) of the words of each row."""
    start, end, row, h = words_of(buf, offs, lower=True)
    if not len(start):
        return row, as_long(h), row
    last = _LOWER[buf]
    a, b = last[end - 1].astype(U64), last[np.maximum(end - 2, start)].astype(U64)
    return row, as_long(h), (mix(_BYTE[last[end - 1]] + a * U64(3) + b * U64(769)) % U64(CLASSES)).astype(np.int64)


def _total(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    w, z, n = (np.concatenate(x) for x in zip(*parts))
    w, at, back = np.unique(w, return_index=True, return_inverse=True)
    return w, z[at], np.bincount(back, weights=n, minlength=len(w)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], most: int = 1_000_000):
    """(word, class, count) of a task's texts; added up before they leave,
    as far as a bounded table allows."""
    kept: list = []
    held = 0
    for batch in batches:
        for _, buf, offs in chunks(batch.column(0)):
            _, w, z = _words(buf, offs)
            kept.append((np.append(w, END), np.append(z, -1), np.append(np.ones(len(w)), len(offs) - 1)))
            held += len(w)
            if held > most:
                kept = [_total(kept)]
                held = len(kept[0][0])
                if held > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], ["w", "z", "n"])
                    kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _total(kept)], ["w", "z", "n"])


class Lexicon:
    """Frequent words in hash order; symbols 0 .. F-1, then the classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, v: int):
        order = np.argsort(words)
        self.words, self.counts, self.n, self.v = words[order], counts[order], n, v
        self.end = int(np.searchsorted(self.words, END))
        self.size = len(self.words) + CLASSES

    def symbols(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at, len(self.words) + z)


def _symbolised(batches: Iterator[pa.RecordBatch], lexicon):
    """Of each text: its symbols, its rare words with their numbers, and the
    base score of the others."""
    lex: Lexicon = lexicon.value
    f = len(lex.words)
    base = np.append(np.log10((lex.counts + 1) / (lex.n + lex.v + 1)), np.zeros(CLASSES))
    seen = np.append(lex.counts > 0, np.zeros(CLASSES, bool))
    kind = np.uint16 if lex.size < 1 << 16 else np.uint32
    for batch in batches:
        for at, buf, offs in chunks(batch.column(2)):
            rows = len(offs) - 1
            row, w, z = _words(buf, offs)
            s = lex.symbols(w, z)
            n = np.bincount(row, minlength=rows)
            to = np.concatenate([[0], np.cumsum(n)])
            rare = np.flatnonzero(s >= f)
            order = rare[np.lexsort((w[rare], row[rare]))]
            new = np.concatenate([[True], (w[order][1:] != w[order][:-1]) | (row[order][1:] != row[order][:-1])]) if len(order) else np.empty(0, bool)
            head = np.flatnonzero(new)
            times = np.diff(np.append(head, len(order)))
            r_row, r_w, r_z = row[order[head]], w[order[head]], z[order[head]]
            r_to = np.concatenate([[0], np.cumsum(np.bincount(r_row, minlength=rows))])
            sums = np.bincount(row, weights=base[s], minlength=rows) + base[lex.end]
            known = np.bincount(row, weights=seen[s], minlength=rows) + seen[lex.end]
            s = s.astype(kind)
            end = np.array([lex.end], kind).tobytes()
            cols = [c.slice(at, rows) for c in batch.columns[:2]]
            cols.append(pa.array([s[to[i] : to[i + 1]].tobytes() + end for i in range(rows)], pa.binary()))
            for x, t in ((r_w, pa.int64()), (r_z.astype(np.int16), pa.int16()), (times.astype(np.int32), pa.int32())):
                cols.append(pa.ListArray.from_arrays(r_to.astype(np.int32), pa.array(x, t)))
            cols += [pa.array(n + 1, pa.int64()), pa.array(known.astype(np.int64)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "sym", "rw", "rz", "rn", "n_tokens", "known", "base"])


SCALE = 8  # steps between two rescalings
BLOCK = 200_000  # symbols of a long text whose states are held at a time


class Model:
    """Emissions are kept as ratios to each symbol's own share ``p``, so sums
    stay near 1 and need rescaling only now and then."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, p: np.ndarray | None = None):
        p = emit.mean(1) if p is None else p
        self.start, self.move, self.ratio, self.log_p = start, move, emit / p[:, None], np.log10(p)

    def _steps(self, seen: np.ndarray, live: np.ndarray, off: np.ndarray, alpha: np.ndarray, first: bool):
        """Forward over emissions laid out step by step: alphas, the scale that
        each was divided by, log10 likelihood by row, last alphas."""
        path, log = np.empty_like(seen), np.zeros(len(alpha))
        scales, one = np.ones(len(seen)), np.ones(seen.shape[1])
        last = alpha.copy()
        for t in range(len(live)):
            a, o = live[t], off[t]
            here = path[o : o + a]
            if t == 0 and first:
                np.multiply(alpha[:a], seen[o : o + a], out=here)
            else:
                np.matmul(alpha[:a], self.move, out=here)
                here *= seen[o : o + a]
            if t % SCALE == SCALE - 1:
                scale = np.matmul(here, one, out=scales[o : o + a])
                here /= scale[:, None]
                log[:a] += np.log10(scale)
            alpha = here
            b = live[t + 1] if t + 1 < len(live) else 0
            if b < a:
                last[b:a] = here[b:]
        total = last.sum(1)
        return path, scales, log + np.log10(total), last / total[:, None]

    @property
    def emit(self) -> np.ndarray:
        return self.ratio * 10 ** self.log_p[:, None]

    @staticmethod
    def _laid(sym: list[np.ndarray]):
        """Sequences, longest first, laid out step by step."""
        n = np.array([len(s) for s in sym])
        order = np.argsort(-n, kind="stable")
        size = n[order]
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        off = np.concatenate([[0], np.cumsum(live)])
        flat = np.concatenate([sym[i] for i in order]).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        by_step = np.empty(len(flat), np.int64)
        by_step[off[step] + row] = flat
        return order, by_step, live, off

    def forward(self, sym: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence, exactly."""
        out = np.empty(len(sym))
        if len(sym) == 1 and len(sym[0]) > BLOCK:
            s, alpha, out[0] = sym[0].astype(np.int64), self.start[None], 0.0
            for lo in range(0, len(s), BLOCK):
                part = s[lo : lo + BLOCK]
                _, _, log, alpha = self._steps(np.take(self.ratio, part, axis=0), np.ones(len(part), np.int64), np.arange(len(part)), alpha, lo == 0)
                out[0] += log[0] + self.log_p[part].sum()
            return out
        order, flat, live, off = self._laid(sym)
        _, _, log, _ = self._steps(np.take(self.ratio, flat, axis=0), live, off, np.tile(self.start, (len(sym), 1)), True)
        out[order] = log
        return out + np.array([np.take(self.log_p, s).sum() for s in sym])

    def _counts(self, flat, live, off, alpha, first, beta):
        """Expected starts, moves and emissions of a block; ``beta`` stands
        behind its last step (``beta``: what follows the block's end)."""
        k = len(self.start)
        one, turn = np.ones(k), np.ascontiguousarray(self.move.T)
        right = np.take(self.ratio, flat, axis=0)
        path, scales, _, _ = self._steps(right, live, off, alpha, first)
        gamma = np.empty_like(path)
        beta = beta.copy()
        for t in range(len(live) - 1, -1, -1):
            a, o = live[t], off[t]
            if t + 1 < len(live):
                b, ahead = live[t + 1], off[t + 1]
                now = np.matmul(right[ahead : ahead + b], turn, out=beta[:b])
                if t % SCALE == 0:
                    now /= (now @ one)[:, None]
            np.multiply(path[o : o + a], beta[:a], out=gamma[o : o + a])
            right[o : o + a] *= beta[:a]
        norm = gamma @ one
        gamma /= norm[:, None]
        # a step's row is the same row one step on
        ahead = np.arange(live[0], len(flat))
        behind = ahead - np.repeat(live[:-1], live[1:])
        before = np.take(path, behind, axis=0)
        before /= (norm[live[0] :] * scales[live[0] :])[:, None]
        move = before.T @ right[live[0] :] * self.move
        emit = np.stack([np.bincount(flat, weights=gamma[:, j], minlength=len(self.ratio)) for j in range(k)], 1)
        return (right[: live[0]], gamma[: live[0]]), move, emit

    def expected(self, sym: list[np.ndarray]):
        """Expected counts: starts, moves, emissions (symbol x state)."""
        k = len(self.start)
        if len(sym) == 1 and len(sym[0]) > BLOCK:
            s = sym[0].astype(np.int64)
            cuts = [s[lo : lo + BLOCK] for lo in range(0, len(s), BLOCK)]
            alphas = [self.start[None]]
            for i, part in enumerate(cuts[:-1]):
                alphas.append(self._steps(np.take(self.ratio, part, axis=0), np.ones(len(part), np.int64), np.arange(len(part)), alphas[-1], i == 0)[3])
            beta, move, emit = np.ones((1, k)), np.zeros((k, k)), np.zeros_like(self.ratio)
            for i in range(len(cuts) - 1, -1, -1):
                one = np.ones(len(cuts[i]), np.int64)
                (right, gamma), m, e = self._counts(cuts[i], one, np.arange(len(one)), alphas[i], i == 0, beta)
                move, emit = move + m, emit + e
                if i:  # the move from the block before
                    joint = alphas[i].T @ right * self.move
                    move += joint / joint.sum()
                    beta = right @ self.move.T
                    beta /= beta.sum()
            return gamma.sum(0), move, emit
        _, flat, live, off = self._laid(sym)
        (_, gamma), move, emit = self._counts(flat, live, off, np.tile(self.start, (len(sym), 1)), True, np.ones((len(sym), k)))
        return gamma.sum(0), move, emit


def _groups(batches: Iterator[pa.RecordBatch], kind, most: int = 250_000, window: int = 4_000_000):
    """Sequences of like length in groups of about ``most`` symbols, out of a
    window of sequences; a very long one goes alone."""
    held, n = [], 0

    def dealt():
        held.sort(key=lambda x: -len(x[0]))
        part, size = [], 0
        for x in held:
            if part and size + len(x[0]) > most:
                yield [s for s, _, _ in part], [(b, i) for _, b, i in part]
                part, size = [], 0
            part.append(x)
            size += len(x[0])
        if part:
            yield [s for s, _, _ in part], [(b, i) for _, b, i in part]

    for batch in batches:
        col = batch.column(batch.schema.get_field_index("sym"))
        for i in range(batch.num_rows):
            held.append((np.frombuffer(col[i].as_py(), kind), batch, i))
            n += len(held[-1][0])
            if n > window:
                yield from dealt()
                held, n = [], 0
    if held:
        yield from dealt()


def _expected(batches: Iterator[pa.RecordBatch], model, kind):
    m: Model = model.value
    total = None
    for sym, _ in _groups(batches, kind):
        got = m.expected(sym)
        total = got if total is None else tuple(x + y for x, y in zip(total, got))
    if total is not None:
        k = len(m.start)
        rows = np.concatenate([total[2], total[1], total[0][None]])
        at = np.concatenate([np.arange(len(total[2])), -1 - np.arange(k), [-1 - k]])
        some = rows.sum(1) > 0
        yield pa.RecordBatch.from_arrays([pa.array(at[some].astype(np.int32)), *(pa.array(rows[some, j].astype(np.float32)) for j in range(k))], ["at", *(f"s{j}" for j in range(k))])


def _scored(batches: Iterator[pa.RecordBatch], model, kind):
    m: Model = model.value
    for sym, rows in _groups(batches, kind):
        log = m.forward(sym)
        cols = []
        for name in ("doc_id", "held_out", "key", "n_tokens", "known", "base"):
            cols.append(pa.array([b.column(b.schema.get_field_index(name))[i].as_py() for b, i in rows], rows[0][0].schema.field(name).type))
        yield pa.RecordBatch.from_arrays([*cols, pa.array(log)], ["doc_id", "held_out", "key", "n_tokens", "known", "base", "model"])


def _fitted(n: np.ndarray, counts, smooth: float = 1.0) -> Model:
    start, move, emit = counts
    p = (n + 1) / (n + 1).sum()
    emit = (emit + smooth * p[:, None]) / (emit.sum(0) + smooth)
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1)[:, None], emit, p)


def scores(docs: DataFrame, states: int = 6, rounds: int = 3, symbols: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held, F.col(f"`{text_col}`").alias("text"))
    counts = texts.where("NOT held_out").select("text").mapInArrow(_counted, "w long, z long, n long")
    counts = table(counts.groupBy("w").agg(F.min("z").alias("z"), F.sum("n").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    often = counts.where((F.col("c") > total.n / symbols) & (F.col("w") != int(END))).select("w", "c").toPandas()
    end = counts.where(F.col("w") == int(END)).select("c").first()
    words, c = np.append(often["w"].to_numpy(np.int64), END), np.append(often["c"].to_numpy(np.int64), end.c if end else 0)
    lex = Lexicon(words, c, total.n, total.v)
    kind = np.dtype(np.uint16 if lex.size < 1 << 16 else np.uint32)
    sent = spark.sparkContext.broadcast(lex)
    rare = counts.where((F.col("c") <= total.n / symbols) & (F.col("w") != int(END)))
    classes = np.zeros((CLASSES, 2), np.int64)
    for r in rare.groupBy("z").agg(F.sum("c").alias("n"), F.count("*").alias("d")).collect():  # 256 rows at most
        classes[r.z] = r.n, r.d
    shape = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, sym binary, rw array<long>, rz array<smallint>, rn array<int>, n_tokens long, known long, base double"
    read = texts.mapInArrow(partial(_symbolised, lexicon=sent), shape).withColumn("key", F.monotonically_increasing_id())
    read = table(read, "symbols")

    # Start: every state has its own taste for words, and states last.
    n = np.append(lex.counts, classes[:, 0]).astype(float)
    rng = np.random.default_rng(7)
    taste = n[:, None] * np.exp(1.5 * rng.standard_normal((len(n), states)))
    move = np.full((states, states), 1.0) + 40.0 * states * np.eye(states)
    model = _fitted(n, (np.ones(states), move * 1000, taste))
    train = read.where("NOT held_out").select("sym")
    for _ in range(rounds if total.n else 0):
        m = spark.sparkContext.broadcast(model)
        cols = [f"s{j}" for j in range(states)]
        got = train.mapInArrow(partial(_expected, model=m, kind=kind), "at int, " + ", ".join(f"{c} float" for c in cols))
        got = got.groupBy("at").agg(*(F.sum(c).alias(c) for c in cols)).toPandas()  # one row a symbol and state at most
        at, val = got["at"].to_numpy(), got[cols].to_numpy(float)
        emit, move, start = np.zeros((len(n), states)), np.zeros((states, states)), np.zeros(states)
        emit[at[at >= 0]] = val[at >= 0]
        inner = (at < 0) & (at >= -states)
        move[-1 - at[inner]] = val[inner]
        if (at == -1 - states).any():
            start = val[at == -1 - states][0]
        model = _fitted(n, (start, move, emit))
    m = spark.sparkContext.broadcast(model)
    scored = read.select("doc_id", "held_out", "key", "n_tokens", "known", "base", "sym").mapInArrow(
        partial(_scored, model=m, kind=kind), f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, key long, n_tokens long, known long, base double, model double"
    )
    # rare words: their counts by join, their class's totals from an array of 256
    words = read.select("key", F.explode(F.arrays_zip("rw", "rz", "rn")).alias("r")).select("key", F.col("r.rw").alias("w"), F.col("r.rz").alias("rz"), F.col("r.rn").alias("times"))
    sums = F.array(*(F.lit(float(a + b + 1)) for a, b in classes))
    words = words.join(rare.select("w", "c"), "w", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    extra = words.groupBy("key").agg(
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(total.n + total.v + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.element_at(sums, F.col("rz").cast("int") + 1))).alias("rare_score"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0)
    return scored.join(extra, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("model") + F.coalesce("rare_score", zero)).alias("score"),
    )
