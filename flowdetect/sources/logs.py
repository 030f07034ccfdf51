"""Readers and writers of logs, captures, blacklists and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _S, _L = T.DoubleType(), T.StringType(), T.LongType()
LOG = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("ts", _D), ("uid", _S), ("id.orig_h", _S), ("id.orig_p", _S), ("id.resp_h", _S), ("id.resp_p", _S), ("proto", _S), ("conn_state", _S), ("orig_bytes", _S), ("resp_bytes", _S),
        ("orig_pkts", _S), ("resp_pkts", _S), ("duration", _S), ("query", _S), ("qtype_name", _S), ("answers", _S), ("ja3", _S), ("ja3s", _S), ("ja4", _S), ("ja4s", _S), ("version", _S),
        ("server_name", _S), ("sizes", T.ArrayType(_L)), ("gaps", T.ArrayType(_D)))]
)


def read_log_with_errors(spark: SparkSession, path: str, schema: T.StructType = LOG) -> DataFrame:
    """JSON lines with ``_bad``: the text of malformed lines, else null."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType = LOG) -> DataFrame:
    # Spark refuses scans that need the corrupt column alone (such as a count)
    first = F.coalesce(F.col(f"`{schema[0].name}`").cast("string"), F.lit(""))
    return read_log_with_errors(spark, path, schema).where(F.col("_bad").isNull() & (first != "\x00")).drop("_bad")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.expr("try_parse_json(value) IS NULL")).alias("malformed"))


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_truth_triples(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, header=True).where(F.lower("Label").contains("botnet"))
    return d.select(F.col("SrcAddr").alias("src_ip"), F.col("DstAddr").alias("dst_ip"), F.expr("try_cast(Dport AS int)").alias("dst_port")).dropna().distinct()


def read_truth_tuples(spark: SparkSession, path: str) -> DataFrame:
    """Positional flows (3, 4, 6, 7: source, port, destination, port), both ways."""
    d = spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(8)), enforceSchema=True)
    d = d.selectExpr("c3 AS a", "try_cast(c4 AS int) AS ap", "c6 AS b", "try_cast(c7 AS int) AS bp").dropna()
    return d.union(d.select("b", "bp", "a", "ap")).distinct().toDF("src_ip", "src_port", "dst_ip", "dst_port")


def read_intel_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """CSV whose header line is a comment."""
    return spark.read.csv(path, comment="#", schema=columns)


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of fingerprint to {family, severity}; a missing file is empty."""
    try:
        text = spark.read.text(path, wholetext=True)
    except Exception as e:  # only a missing path is tolerated
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "hash string, family string, severity string")
    d = text.select(F.explode(F.from_json("value", "map<string, struct<family: string, severity: string>>")).alias("hash", "v"))
    return d.select("hash", "v.family", "v.severity")


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """(label, ts, file, place): the marks of each file's array with their place
    in it; starts and ends are paired by these (``dataset.pair_marks``)."""
    d = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    marks = F.from_json("value", "array<struct<label: string, ts: double>>")
    return d.select("file", F.posexplode(marks).alias("place", "m")).select("m.label", "m.ts", "file", "place")


def read_manifests(spark: SparkSession, path: str, marks: DataFrame) -> DataFrame:
    """Manifests whose marks file was read too."""
    d = spark.read.schema("scenario_id string, session_id string, split string, victim_ips array<string>, attacker_ips array<string>, configuration string").json(path, multiLine=True)
    named = marks.select(F.regexp_replace("file", r"^sessions_|\.json$", "").alias("scenario_id")).distinct()
    return d.join(named, "scenario_id", "left_semi")


def read_words(spark: SparkSession, path: str, low: int = 3, high: int = 1 << 20) -> DataFrame:
    w = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return w.where(F.length("word").between(low, high))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("detector string, precision double, recall double, f1 double, fpr double, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    return d.where("detector IS NOT NULL").drop("_bad")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("seq_sizes", "seq_gaps", "seq_mask", "label", "provenance", "grp")


def write_sequences(rows: DataFrame, path: str) -> None:
    rows.select("seq_sizes", "seq_gaps", "seq_mask", "label", "provenance", "grp").write.mode("overwrite").parquet(path)


def write_dataset(train: DataFrame, unseen: DataFrame, path: str) -> None:
    """Two separate places, so that unseen rows are never filtered by habit."""
    train.write.mode("overwrite").parquet(f"{path}/split=train")
    unseen.write.mode("overwrite").parquet(f"{path}/split=unseen_test")
