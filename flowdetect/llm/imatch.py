"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

The lexicon holds the terms (lower-cased words) whose document frequency lies in
a band, that is, within a band of inverse document frequency. A document keeps
its distinct lexicon terms; they are sorted (by a 60-bit hash of each) and the
sorted list is hashed. This is done for the whole lexicon and for random subsets of
it at several rates, so that documents of any length have subsets that hold a
few of their terms. The likeness of two fingerprints is the share of equal hashes
among the subsets in which either has a term.

The lexicon's broadcast is bounded: a term in ``least`` of N documents uses up
least * N of the N * d (document, term) pairs, d distinct terms a document on
average, so there are at most d / least terms, whatever N is. They are counted
all the same, and beyond ``most_terms`` the join is left to Spark.

Edge cases: null and empty texts have no terms and the empty fingerprint; two
documents without lexicon terms have likeness 1 if their texts are equal, else
0. Ties of the id are ordered by text; rows that repeat both are interchangeable.
A null id comes last, such rows in order of
text. Ids may lie anywhere in the range of a long. Long texts are used whole. A single document is its own
next one. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.llm.common import table

# (rate, subsets): each subset holds 1 / rate of the lexicon
SCALES = ((1, 1), (4, 4), (16, 8), (64, 8), (256, 8))
SUBSETS = sum(n for _, n in SCALES)
CUTS, ID_RANGE = 256, 4096  # quantiles of the ids; documents in a range of ids, about


def terms(text: str) -> str:
    return f"array_distinct(array_remove(split(lower({text}), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))"


def lexicon(docs: DataFrame, least: float, most: float, min_df: int) -> DataFrame:
    """(term, h) of the terms in the band; ``docs`` has (text)."""
    n = docs.agg(F.count("*").alias("docs"))
    df = docs.select(F.explode(F.expr(terms("text"))).alias("term")).groupBy("term").count()
    band = (F.col("count") >= F.greatest(F.lit(min_df), F.col("docs") * least)) & (F.col("count") <= F.col("docs") * most)
    return df.crossJoin(F.broadcast(n)).where(band).select("term", F.expr("cast(conv(substr(md5(term), 1, 15), 16, 10) AS bigint)").alias("h"))


def with_next(docs: DataFrame) -> DataFrame:
    """(b, rn: row key, doc_id, text, next, nb, nrn: key of the next row) in
    descending order of doc_id, the first after the last. Ranges of ids are the
    windows; only one row per range meets in the window over ranges."""
    share = [i / CUTS for i in range(CUTS)]
    cuts, n = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, 10_000), F.count("*")).first()
    cuts = sorted(set(cuts or [0]))
    parts = max(1, n // (CUTS * ID_RANGE))
    wide = [max(float(hi) - float(lo), 1.0) / parts for lo, hi in zip(cuts, [*cuts[1:], cuts[-1] + 1])]
    x, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    # the quantile that an id lies in, and its place between this one and the next
    i = F.greatest(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= x)), F.lit(1))
    low, width = (F.element_at(F.array(*map(F.lit, v)), i) for v in (cuts, wide))
    place = F.floor((x.cast("double") - low.cast("double")) / width)
    b = i.cast("long") * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), place))
    lead = F.coalesce(F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 2)), 16, 10).cast("long"), F.lit(0))
    d = docs.select("doc_id", text.alias("text"), F.when(x.isNotNull(), b).otherwise(-1 - lead).alias("b"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    w = Window.partitionBy("b").orderBy(*order)
    heads = d.groupBy("b").agg(F.min_by("text", F.struct(F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))), F.col("text"))).alias("head"))
    ranges = Window.orderBy(F.desc("b"))
    follow = heads.select("b", F.coalesce(F.lead("b").over(ranges), F.max("b").over(ranges)).alias("nb"))
    follow = follow.join(heads.select(F.col("b").alias("nb"), "head"), "nb")
    d = d.withColumns({"rn": F.row_number().over(w), "_in": F.lead("text").over(w)}).join(follow, "b")
    inside = F.col("_in").isNotNull()
    return d.select(
        "b", "rn", "doc_id", "text", F.coalesce("_in", "head").alias("next"),
        F.when(inside, F.col("b")).otherwise(F.col("nb")).alias("nb"), F.when(inside, F.col("rn") + 1).otherwise(F.lit(1)).alias("nrn"),
    )


def _members() -> str:
    """SQL: the subsets that hold the term with hash h."""
    parts, first = [], 0
    for k, (rate, n) in enumerate(SCALES):
        parts.append(f"CASE WHEN (h DIV {1000 ** k}) % {rate} < {n} THEN {first} + (h DIV {1000 ** k}) % {rate} END")
        first += n
    return f"array_compact(array({', '.join(parts)}))"


def _likeness(a: str, b: str, same: str) -> str:
    pairs = f"zip_with({a}, {b}, (x, y) -> CASE WHEN x = '' AND y = '' THEN null ELSE cast(x = y AS int) END)"
    known = f"filter({pairs}, x -> x IS NOT NULL)"
    return f"CASE WHEN size({known}) = 0 THEN CASE WHEN {same} THEN 1D ELSE 0D END ELSE aggregate({known}, 0, (s, x) -> s + x) / cast(size({known}) AS double) END"


def fingerprints(docs: DataFrame, least: float = 0.001, most: float = 0.1, min_df: int = 2, most_terms: int = 1_000_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next; see the module's text."""
    docs = docs.select("doc_id", "text")
    words = table(lexicon(docs.select(F.coalesce("text", F.lit("")).alias("text")), least, most, min_df), "lexicon")
    words = F.broadcast(words) if words.count() <= most_terms else words
    rows = with_next(docs).withColumn("n", F.length("text")).withColumn("edited", F.expr("concat(substr(text, 1, n - n DIV 2), substr(next, 1, n DIV 2))"))
    # narrow rows: (row, position in both lists of terms); the position tells the text
    flat = rows.select("b", "rn", F.expr(terms("text")).alias("own"), F.expr(terms("edited")).alias("ed"))
    flat = flat.select("b", "rn", F.size("own").alias("k"), F.posexplode(F.concat("own", "ed")).alias("p", "term"))
    held = flat.join(words, "term").select("b", "rn", (F.col("p") >= F.col("k")).cast("int").alias("tag"), "h")
    held = held.select("b", "rn", "tag", "h", F.explode(F.expr(_members())).alias("s"))
    sets = held.groupBy("b", "rn", "tag", "s").agg(F.sort_array(F.collect_list("h")).alias("x"))
    entry = F.struct((F.col("tag") * SUBSETS + F.col("s")).cast("int").alias("at"), F.expr("substr(md5(array_join(x, ',')), 1, 8)").alias("f"))
    maps = table(sets.groupBy("b", "rn").agg(F.map_from_entries(F.collect_list(entry)).alias("m")), "imatch")
    base = rows.select(
        "b", "rn", "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), "nb", "nrn",
        (F.col("text") == F.col("edited")).alias("same_edited"), (F.col("text") == F.col("next")).alias("same_next"),
    )
    parts = [f"transform(sequence(0, {SUBSETS - 1}), i -> coalesce(try_element_at(m, i + {of}), ''))" for of in (0, SUBSETS)]
    per = base.join(maps, ["b", "rn"], "left").withColumns({"own": F.expr(parts[0]), "ed": F.expr(parts[1])}).drop("m")
    after = maps.select(F.col("b").alias("nb"), F.col("rn").alias("nrn"), F.expr(parts[0]).alias("nxt"))
    per = per.join(after, ["nb", "nrn"], "left").withColumn("nxt", F.coalesce("nxt", F.array_repeat(F.lit(""), SUBSETS)))
    text = "array_join(transform({}, x -> if(x = '', '-', x)), '')".format
    return per.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.expr(text("own")).alias("fingerprint"), F.expr(text("ed")).alias("edited_fingerprint"),
        F.expr(_likeness("own", "ed", "same_edited")).alias("near_edited"), F.expr(_likeness("own", "nxt", "same_next")).alias("near_next"),
    )
