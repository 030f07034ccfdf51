"""Cleaning pipeline over the documents table: quality rules, near duplicates,
repeated passages, source mix, tokens. Every stage works on all rows that its
predecessor kept, and its rows are written to the shared folder and read back;
tables that nothing reads any more go.

Rows, not ids, are kept or dropped: ids may be null or repeat. A null text
counts as empty (the quality rules reject it); a null source is a source of its
own; languages without references are judged by the base limits. Empty tables
give empty results. Extra columns pass through all stages, whatever their names,
but for those that the operators add (``pieces``, ``decoded``), which are replaced.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdetect.llm import mixing, ngram_join, pieces, quality, suffix_dedup
from flowdetect.llm.common import Tables, hidden, table, tokenizer_file

VOCABULARY = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the divergence rules accept. An empty
    table gives an empty one; a column named like an added count stays as it was."""
    own = hidden(docs, *docs.columns)
    renamed = docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text", "lang") else own[c]) for c in docs.columns))
    kept = quality.quality_rules(renamed).where("kept")
    return kept.select(*(F.col(f"`{c if c in ('doc_id', 'text', 'lang') else own[c]}`").alias(c) for c in docs.columns))


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a key of each row: its place in the files it is read from.
    Rows that come from no files are written first."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select("*", place.alias(key))
    except AnalysisException:
        return table(docs, "keyed").select("*", place.alias(key))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) one row:
    that with the least id, null ids last, then the first in the files. Texts
    without words are linked with nothing."""
    key = hidden(docs, "row")["row"]
    rows = keyed(docs, key)
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.col(key).alias("key"))
    groups = ngram_join.near_duplicates(rows.select(rank.alias("rank"), "text"), k=5, percent=80, id_col="rank")
    gone = table(groups.where("rank.key <> component_id.key").select(F.col("rank.key").alias(key)), "near")
    return rows.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 200-byte strings repeat; n_chars follows
    them. A null text stays null."""
    cut = suffix_dedup.without_repeats(docs, 200)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one without words
    adds nothing to the mix and goes."""
    own = hidden(docs, *mixing.ADDED)
    clash = {c: own[c.lower()] for c in docs.columns if c.lower() in mixing.ADDED}
    renamed = docs.withColumnsRenamed(clash)
    return mixing.repeat(mixing.mix(renamed)).withColumnsRenamed({v: k for k, v in clash.items()}).select(*(F.col(f"`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces and the text read back from these; a null
    text has none and reads as an empty one."""
    return pieces.encode(docs, tokenizer_file(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("SentencePiece", tokens),
]

# Near duplicates, repeated passages and pieces are beyond SQL; a test holds
# the rows, with their repetitions, against a plain version of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark), None
    for name, stage in STAGES[:-1]:
        name = name.split()[0].lower()
        docs = tables.add(stage(spark, docs, sf_dir), name)
        if last:
            tables.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
