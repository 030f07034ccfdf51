"""Registered corpus queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowdetect.llm import hard_negatives, hmm, imatch, licenses, mixing, ngram_join, pieces, quality, simhash, suffix_dedup, token_files, url_filter, whitening
from flowdetect.llm.common import table, text_key, tokenizer_file


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    measured = table(quality.stats(docs).drop("text"), "op1")
    return quality.judge(measured, quality.references(measured)).drop("lang")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_join.near_duplicates(docs, k=4, percent=85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), digest=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = table(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n")), "op3")
    return mixing.mix(sized, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.url_filter(pages, RULES).drop("url")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licenses.scan(docs)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", *text_key(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    cut = suffix_dedup.repeated_bytes(docs, 200).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut"))
    zero = F.lit(0).cast("long")
    return own.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut", "own").alias("kept_sha256")
    )


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_files.read_documents(token_files.write_tokens(docs, tokenizer_file("word_bpe_49k.json")))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.by_component(whitening.whiten(rows, k=16))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("id") % 100 == 0)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.near_duplicates(docs, k=3, radius=2)


QUERIES = (
    op1_quality_rules, op2_sentencepiece, op3_mixing, op4_url_filter, op5_license_scan, op6_suffix_dedup,
    op7_ngram_join, op8_imatch, op9_token_files, op10_hmm, op11_whitening, op12_hard_negatives, op13_simhash,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    from flowdetect.llm import oracles

    return {"op1_quality_rules": oracles.OP1, "op3_mixing": oracles.OP3, "op4_url_filter": oracles.OP4, "op6_suffix_dedup": oracles.OP6, "op7_ngram_join": oracles.OP7, "op8_imatch": oracles.OP8}
