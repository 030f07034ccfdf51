"""SIEM exports: CEF lines, STIX indicators, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
LABELS = {"ddos": "denial-of-service", "recon": "reconnaissance", "c2": "command-and-control", "dga": "malicious-activity", "tls": "malicious-activity", "exfil": "exfiltration", "MULTI_VECTOR": "multi-vector-attack", "MULTI_VECTOR_ANOMALY": "multi-vector-attack"}
VENDOR, PRODUCT, VERSION = "FlowDetect", "ThreatPipeline", "1.0"
CSV_COLUMNS = (
    "timestamp", "flow_id", "threat_class", "threat_label", "severity", "confidence", "calibrated", "detection_method", "src_ip", "src_port", "dst_ip", "dst_port", "detector", "seq", "record_hash",
)


def _or(alerts: DataFrame, column: str, kind: str = "string", otherwise: str = "null") -> str:
    """The column, or where the alerts have none a constant."""
    return column if column in alerts.columns else f"cast({otherwise} AS {kind})"


def _header(c: str) -> str:
    return rf"replace(replace({c}, '\\', '\\\\'), '|', '\\|')"


def _value(c: str) -> str:
    return rf"replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '=', '\\='), '\r\n', '\\n'), '\n', '\\n'), '\r', '\\n')"


def cef(alerts: DataFrame) -> DataFrame:
    """(seq, line): one CEF:0 line an alert; null extensions are left out."""
    severity = "cast(CASE severity WHEN 'CRITICAL' THEN 9 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 5 END AS string)"
    label = _or(alerts, "threat_label", "string", "threat_class")
    head = f"concat_ws('|', 'CEF:0', '{VENDOR}', '{PRODUCT}', '{VERSION}', {_header('threat_class')}, {_header(label)}, {severity})"
    evidence = "evidence_json" if "evidence_json" in alerts.columns else "evidence"
    ext = {
        "src": "src_ip", "dst": "dst_ip", "dpt": "cast(dst_port AS string)", "rt": _or(alerts, "timestamp"), "cn1": "cast(cast(round(confidence * 100) AS int) AS string)",
        "cn1Label": "'confidencePercent'", "cs1": evidence, "cs1Label": "'evidence'", "cs2": "flow_id", "cs2Label": "'flowId'",
    }
    pairs = ", ".join(f"concat('{k}=', {_value(v)})" for k, v in ext.items())
    return alerts.selectExpr("seq", f"concat({head}, '|', concat_ws(' ', {pairs})) AS line")


def stix(alerts: DataFrame) -> DataFrame:
    """Indicator columns without the random id and the clock."""
    label = "CASE threat_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE 'malicious-activity' END"
    ip = """concat("[ipv4-addr:value = '", {}, "']")""".format
    pattern = f"concat_ws(' AND ', {ip('src_ip')}, {ip('dst_ip')}, concat('[network-traffic:dst_port = ', dst_port, ']'))"
    return alerts.selectExpr("seq", f"{pattern} AS pattern", f"{label} AS label", "threat_class", "cast(round(confidence * 100) AS bigint) AS confidence", "flow_id AS x_flow_id", "severity AS x_severity")


def indicators(alerts: DataFrame) -> DataFrame:
    """Whole indicator objects, but for ids and times of writing."""
    more = {
        "name": _or(alerts, "threat_label", "string", "threat_class"), "x_detector": _or(alerts, "detector"), "x_calibrated": _or(alerts, "calibrated", "boolean", "false"),
        "x_event_ts": _or(alerts, "event_ts", "double"), "x_evidence": "evidence_json" if "evidence_json" in alerts.columns else _or(alerts, "evidence"),
    }
    rest = alerts.selectExpr("seq AS _seq", *(f"{v} AS {k}" for k, v in more.items()))
    d = stix(alerts).join(rest, F.col("seq") == F.col("_seq")).drop("_seq")
    labels = F.array("label", "threat_class")
    return d.withColumns({"labels": labels, "type": F.lit("indicator"), "spec_version": F.lit("2.1"), "pattern_type": F.lit("stix")}).drop("label", "threat_class")


def bundles(alerts: DataFrame) -> DataFrame:
    """JSON lines of indicator objects, with ids and times."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    d = indicators(alerts).withColumns({"id": F.concat(F.lit("indicator--"), F.expr("uuid()")), "created": now, "modified": now, "valid_from": now})
    one = F.struct(F.lit("bundle").alias("type"), F.concat(F.lit("bundle--"), F.expr("uuid()")).alias("id"), F.array(F.struct(*(c for c in d.columns if c != "seq"))).alias("objects"))
    return d.select(F.to_json(one).alias("value"))


def write_cef(alerts: DataFrame, path: str) -> None:
    cef(alerts).select("line").write.mode("append").text(path)


def write_stix(alerts: DataFrame, path: str) -> None:
    bundles(alerts).write.mode("append").text(path)


def write_csv(alerts: DataFrame, path: str) -> None:
    """All fifteen columns; what the alerts lack is empty."""
    alerts.selectExpr(*(f"{_or(alerts, c)} AS {c}" for c in CSV_COLUMNS)).write.mode("overwrite").csv(path, header=True, escape='"')
