"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's character classes and its common words are turned into
histograms. For each language they are compared with the corpus' own
histograms of that language (sums over all documents that carry the language
tag) by Jensen-Shannon distance (base 2, 0 to 1). A document is rejected when
it is far from every language, in characters or in words. Texts too short for
a histogram to mean anything are exempt (minimum-length guards).

Languages are those that ``common`` has word lists for (a parameter; four are
built in).

Edge cases: a null text counts as empty: 0 words, so ``base_failed``. A null
``lang`` adds nothing to the references; the document is judged against all of
them. A ``lang`` without a word list is no reference and is judged by the base
limits alone. A language without documents is no reference; without any
reference the method rejects nothing. Empty tables give empty results. Extra
columns pass through; ones named like the added columns, ``_hist`` or ``_refs``
(case ignored) are replaced. Repeated rows are judged alike, each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowdetect.llm.common import hidden, without

WS = r"[\\x20\\x09-\\x0D]+"
CLASSES = ("lower", "space", "upper", "digit", "wide", "punct")
# Eight common words of each language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los"),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
HIST, REFS = "_hist", "_refs"


def vocabulary(common: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(w for ws in common.values() for w in ws))


def stats(docs: DataFrame, common: dict[str, tuple[str, ...]] = COMMON) -> DataFrame:
    """Adds the base counts and the histogram columns to ``docs``."""
    names = without(docs, (*STATS, HIST))
    given = [F.col(f"`{c}`") for c in names]
    mark = hidden(docs, "")[""]
    vocab = vocabulary(common)

    def sql(text: str) -> Column:
        """SQL with @ for the mark of helper columns."""
        return F.expr(text.replace("@", mark))

    # Common words count in lower case and capitalised. What follows holds every array that a lambda looks into as a column of its own.
    d = docs.select(*given, F.coalesce(F.col("text"), F.lit("")).alias(f"{mark}t"))
    d = d.withColumn(f"{mark}w", sql(f"array_remove(split(@t, '{WS}'), '')"))
    d = d.withColumn(
        f"{mark}h",
        sql("transform(slice(@w, 1, greatest(size(@w) - 4, 0)), (x, i) -> xxhash64(x, @w[i + 1], @w[i + 2], @w[i + 3], @w[i + 4]))"),
    ).withColumn(f"{mark}j", sql("array_join(@w, '')"))
    d = d.withColumn(
        f"{mark}s",
        sql("CASE WHEN size(array_distinct(@h)) < size(@h) THEN array_sort(transform(@h, (x, i) -> struct(x AS h, i AS i))) END"),
    ).withColumn(f"{mark}r1", sql("regexp_replace(@j, '[a-z]+', '')"))
    # equal hashes are confirmed by the words themselves
    same = "@s[k {0} 1].h = e.h AND slice(@w, @s[k {0} 1].i + 1, 5) = slice(@w, e.i + 1, 5)"
    d = d.withColumn(
        f"{mark}p",
        sql(f"CASE WHEN @s IS NOT NULL THEN array_sort(transform(filter(@s, (e, k) -> (k > 0 AND {same.format('-')}) OR (k + 1 < size(@s) AND {same.format('+')})), e -> e.i)) END"),
    ).withColumn(f"{mark}r2", sql("regexp_replace(@r1, '[A-Z]+', '')"))
    d = d.withColumn(f"{mark}r3", sql("regexp_replace(@r2, '[0-9]+', '')"))
    d = d.withColumn(f"{mark}r4", sql(r"regexp_replace(@r3, '[^\\x00-\\x7F]+', '')"))
    known = ", ".join(f"'{w}', '{w.capitalize()}'" for w in vocab)
    words = ", ".join(f"'{w}'" for w in vocab)
    d = d.withColumn(f"{mark}k", sql(f"filter(@w, x -> x IN ({known}))"))
    d = d.withColumn(f"{mark}l", sql(r"filter(split(@t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    return d.select(
        *given,
        sql("cast(size(@w) AS bigint) AS n_words"),
        sql("cast(length(@j) AS bigint) AS word_chars"),
        sql("cast(length(@r4) - length(regexp_replace(@r4, '[#*$%&|<>]+', '')) AS bigint) AS n_symbols"),
        sql("cast(size(@l) - size(array_distinct(@l)) AS bigint) AS n_dup_lines"),
        sql("cast(coalesce(aggregate(zip_with(@p, slice(@p, 2, size(@p)), (a, b) -> least(5, coalesce(b - a, 5))), 0, (s, x) -> s + x), 0) AS bigint) AS n_repeat_words"),
        sql(
            "cast(concat(array(length(@j) - length(@r1), length(@t) - length(@j), length(@r1) - length(@r2), length(@r2) - length(@r3), length(@r3) - length(@r4), length(@r4)),"
            f" transform(array({words}), v -> 2 * size(@k) - size(array_remove(@k, v)) - size(array_remove(@k, concat(upper(left(v, 1)), substr(v, 2)))))) AS array<bigint>)"
        ).alias(HIST),
    )


def references(measured: DataFrame, common: dict[str, tuple[str, ...]] = COMMON) -> DataFrame:
    """One row ``_refs``: map of language to its summed histogram, with the
    number of words as the last bin. Its size is fixed."""
    bins = (
        measured.where(F.col("lang").isin(*common))
        .select("lang", F.posexplode(F.concat(HIST, F.array("n_words"))).alias("bin", "n"))
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
    )
    return bins.groupBy().agg(
        F.map_from_arrays(
            F.array(*(F.lit(x) for x in common)),
            F.array(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("lang") == x, F.struct("bin", "n")))), lambda e: e["n"]) for x in common)),
        ).alias(REFS)
    )


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance (base 2) of two count arrays, as SQL."""
    total = "aggregate({}, 0L, (s, x) -> s + x)".format
    term = "if({0} > 0, {0} * ln(2 * {0} / (a + b)), 0D)".format
    of = f"zip_with(transform({p}, x -> x / {total(p)}), transform({q}, x -> x / {total(q)}), (a, b) -> {term('a')} + {term('b')})"
    return f"CASE WHEN {total(p)} > 0 AND {total(q)} > 0 THEN sqrt(greatest(0D, aggregate({of}, 0D, (s, x) -> s + x) / (2 * ln(2D)))) END"


def _distances(common: dict[str, tuple[str, ...]]) -> tuple[str, str]:
    """SQL of the least distance to any language, in characters and in words."""
    chars, words = [], []
    n, vocab = len(CLASSES), vocabulary(common)
    for lang, own_words in common.items():
        ref = f"{REFS}['{lang}']"
        chars.append(_distance(f"slice({HIST}, 1, {n})", f"slice({ref}, 1, {n})"))
        at = ", ".join(str(n + 1 + vocab.index(w)) for w in own_words)
        own, theirs = (f"transform(array({at}), i -> element_at({h}, i))" for h in (HIST, ref))
        rest = "concat({0}, array({1} - aggregate({0}, 0L, (s, x) -> s + x)))".format
        there = f"size({ref}) > 0 AND n_words > 0"
        words.append(f"CASE WHEN {there} THEN {_distance(rest(own, 'n_words'), rest(theirs, f'element_at({ref}, -1)'))} END")
    least = lambda d: f"least({', '.join(d)})" if len(d) > 1 else d[0]
    return f"round({least(chars)}, 6)", f"round({least(words)}, 6)"


def judge(
    measured: DataFrame, refs: DataFrame, max_char: float = 0.25, max_word: float = 0.27, min_chars: int = 200, min_words: int = 100,
    common: dict[str, tuple[str, ...]] = COMMON,
) -> DataFrame:
    """Adds char_distance, word_distance, base_failed and kept to what
    :func:`stats` returned. ``refs`` is the row of :func:`references`: its
    broadcast has a fixed size."""
    added = ("char_distance", "word_distance", "base_failed", "kept")
    given = without(measured, (*added, HIST, REFS))
    char, word = _distances(common)
    base = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    far = f"coalesce(word_chars >= {min_chars} AND char_distance > {max_char}, false) OR coalesce(n_words >= {min_words} AND word_distance > {max_word}, false)"
    both = measured.select(*(F.col(f"`{c}`") for c in (*given, HIST))).crossJoin(F.broadcast(refs))
    both = both.withColumns({"char_distance": F.expr(char), "word_distance": F.expr(word)})
    judged = F.col("lang").isNull() | F.col("lang").isin(*common)
    kept = ~F.expr(base) & ~(judged & F.expr(far))
    return both.select(*(F.col(f"`{c}`") for c in given), "char_distance", "word_distance", F.expr(base).alias("base_failed"), kept.alias("kept"))


def quality_rules(docs: DataFrame, common: dict[str, tuple[str, ...]] = COMMON, **limits) -> DataFrame:
    """``docs`` with counts, distances and verdict; reads ``docs`` twice.

    The rows pass through a generator: a filter on the verdict stays above it.
    Pushed below, it would hold every step above as one nested expression."""
    measured = stats(docs, common)
    judged = judge(measured, references(measured, common), common=common, **limits)
    return judged.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in judged.columns)))))
