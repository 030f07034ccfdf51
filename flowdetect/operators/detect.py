"""Detectors: normalized flows in, alerts in the unified schema out.

``REGISTRY`` maps names to functions ``flows -> alerts``; ``register`` adds one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.functions import expr as x
from flowdetect.operators import features, gates

REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


ALERT = (
    "timestamp", "event_ts", "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "threat_class", "threat_label", "severity", "confidence", "calibrated", "evidence_json", "detector",
    "window_seconds", "detection_method", "feature_contributions",
)
# Labels of the classes.
LABELS = {"ddos": "DDoS / SYN Flood", "recon": "Reconnaissance", "c2": "C2 Beaconing", "dga": "DGA / DNS Tunnelling", "tls": "TLS Malware (JA3/JA4)", "exfil": "Data Exfiltration"}
NOW = "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"


def make_alert(rows: DataFrame, threat_class: str, severity: str, confidence: str, evidence: str, window: int, method: str = "rule_based", calibrated: str = "false") -> DataFrame:
    """Rows that fired, in the unified alert schema (SQL text per field). What
    the rows lack (ports, ``feature_contributions``) is null."""
    kinds = {"src_port": "int", "dst_ip": "string", "dst_port": "int", "feature_contributions": "array<struct<feature:string,value:double,importance:double>>"}
    own = {c: c if c in rows.columns else f"cast(null AS {t})" for c, t in kinds.items()}
    fields = {
        "timestamp": NOW, "event_ts": "ts_us / 1e6", "flow_id": "uid", "src_ip": "src_ip", **own, "threat_class": f"'{threat_class}'", "threat_label": f"'{LABELS[threat_class]}'",
        "severity": severity, "confidence": x.confidence(confidence), "calibrated": calibrated, "evidence_json": f"to_json({evidence})", "detector": f"'{threat_class}_detector'",
        "window_seconds": str(window), "detection_method": method if method.startswith("CASE") else repr(method),
    }
    return rows.selectExpr(*(f"{fields[c]} AS {c}" for c in ALERT))


def slow_rows(flows: DataFrame, least: int = 25) -> DataFrame:
    hits = features.slow_conns(flows.where("proto IN ('tcp', 'udp')")).where(F.col("slow_count") >= least)
    return gates.cooldown(hits, ["dst_ip", "dst_port"], 30)


@register("slow_http")
def slow_http(flows: DataFrame) -> DataFrame:
    return make_alert(slow_rows(flows), "ddos", "'HIGH'", "least(0.95D, 0.6D + slow_count / 100D)", "array(concat('Connections of this shape: ', slow_count))", 300)


@register("flood_rule")
def flood_rule(flows: DataFrame) -> DataFrame:
    """Rows of slow-exhaustion alerts never enter the flood window."""
    rows = flows.where("proto IN ('tcp', 'udp')")
    rows = rows.join(slow_rows(flows).select("event_id"), "event_id", "left_anti")
    hits = features.entropy_baseline(features.flood_features(rows)).where("anomalous")
    evidence = ("array_compact(array(concat('Packet rate: ', packet_rate), concat('Unique destination ports: ', unique_dst_ports), "
                "CASE WHEN unique_src_ips > 50 THEN concat('Supporting evidence: ', unique_src_ips, ' unique sources exceeds 50') END, "
                "CASE WHEN unique_src_ips > 1 THEN 'Several sources' END))")  # fmt: skip
    return make_alert(gates.cooldown(hits, ["src_ip"], 30), "ddos", "CASE WHEN packet_rate > 600 THEN 'CRITICAL' ELSE 'HIGH' END", "0.6D + least(sigma / 10, 0.35D)", evidence, 10, "rule_fallback_no_model")


@register("scan_rule")
def scan_rule(flows: DataFrame) -> DataFrame:
    hits = features.scan_features(flows).where("unique_ports > 15 OR unique_hosts > 10")
    evidence = "array(concat('Unique destination ports: ', unique_ports), concat('Unique destination hosts: ', unique_hosts))"
    return make_alert(gates.cooldown(hits, ["src_ip"], 20), "recon", "CASE WHEN unique_ports <= 30 THEN 'MEDIUM' ELSE 'HIGH' END", "0.6D + least(unique_ports / 15D * 0.3D, 0.35D)", evidence, 60, "rule_fallback_no_model")


BEACON = "observations >= 5 AND mean_interval BETWEEN 3 AND 600 AND cv <= 0.35"


@register("beacon_rule")
def beacon_rule(flows: DataFrame) -> DataFrame:
    hits = gates.first_only(features.beacon_features(flows).where(BEACON), ["src_ip", "dst_ip", "dst_port"])
    return make_alert(hits, "c2", "'HIGH'", "0.6D + least((0.35D - cv) / 0.35D * 0.35D, 0.35D)", "array(concat('Repeated connections: ', observations))", 0, "rule_fallback_no_model")


def dns_gate(dns: DataFrame) -> DataFrame:
    d = dns.withColumn("query", F.expr(r"regexp_replace(query, '[.]+$', '')"))
    return d.where("length(query) >= 10 AND qtype_name <> 'PTR' AND NOT (query LIKE '%.local' OR query LIKE '%.internal' OR query LIKE '%.arpa')")


def dns_tunnel_rows(dns: DataFrame) -> DataFrame:
    d = dns_gate(dns).withColumn("t", F.expr(x.tunnel_ratio("query", "answers")))
    return d.where("qtype_name IN ('TXT', 'NULL') AND length(query) > 50 AND t.ratio > 3")


def _at_port_53(dns: DataFrame) -> DataFrame:
    """Port 53 where the record itself names none."""
    return dns if "dst_port" in dns.columns else dns.withColumn("dst_port", F.lit(53))


@register("dns_tunnel")
def dns_tunnel(dns: DataFrame) -> DataFrame:
    return make_alert(_at_port_53(dns_tunnel_rows(dns)), "dga", "'HIGH'", "least(0.97D, 0.6D + length(query) / 200D + t.ratio / 20)", "named_struct('detection_path', 'TUNNEL', 'payload_ratio', round(t.ratio, 3), 'tunnel_direction', t.direction)", 0)


def exfil_gate(flows: DataFrame) -> DataFrame:
    return flows.where(f"NOT ({x.is_internal('src_ip')} AND {x.is_internal('dst_ip')}) AND orig_bytes >= 1000")


def exfil_pattern(flows: DataFrame) -> DataFrame:
    """The pattern stage alone, at 0.70. It is no registered detector: without a
    model no exfiltration alert is due."""
    rows = features.exfil_features(exfil_gate(flows)).withColumn("pattern", F.expr(features.EXFIL_PATTERN)).where("pattern IS NOT NULL")
    return make_alert(rows, "exfil", "CASE WHEN pattern = 'ICMP_COVERT' THEN 'CRITICAL' ELSE 'MEDIUM' END", "0.70D", "named_struct('pattern', pattern, 'byte_ratio', round(byte_ratio, 4))", 0)


def tls_gate(joined: DataFrame, min_duration: float = 0.1, min_bytes: int = 100) -> DataFrame:
    return joined.where(f"NOT {x.is_internal('dst_ip')} AND duration >= {min_duration} AND orig_bytes + resp_bytes >= {min_bytes}")


def blacklisted(joined: DataFrame, blacklist: DataFrame) -> DataFrame:
    """JA3 hits before JA4 hits; empty fingerprints never match. A hash listed
    more than once counts once, with the least of its families."""
    listed = blacklist.where("hash <> ''").groupBy("hash").agg(F.min("family").alias("family"))
    b3 = listed.select(F.col("hash").alias("ja3"), F.col("family").alias("f3"), F.lit(True).alias("h3"))
    b4 = listed.select(F.col("hash").alias("ja4"), F.col("family").alias("f4"), F.lit(True).alias("h4"))
    d = joined.join(b3, "ja3", "left").join(b4, "ja4", "left")
    return d.where("h3 OR h4").withColumns({"family": F.expr("if(h3, f3, f4)"), "matched": F.expr("if(h3, 'ja3', 'ja4')")}).drop("f3", "f4", "h3", "h4")


@register("tls_blacklist")
def tls_blacklist(joined: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    rows = blacklisted(tls_gate(joined), blacklist)
    return make_alert(rows, "tls", "'HIGH'", "0.95D", "named_struct('family', family, 'matched', matched)", 0, "CASE WHEN matched = 'ja3' THEN 'ja3_blacklist' ELSE 'ja4_blacklist' END")


def model_alerts(rows: DataFrame, p: str, threat_class: str, threshold: float, severity: str, calibrated: bool = True, method: str = "ml") -> DataFrame:
    """Model path: rows whose score column passes the threshold."""
    return make_alert(rows.where(f"{p} > {threshold}"), threat_class, severity, p, f"named_struct('probability', round({p}, 4))", 0, method, str(calibrated).lower())


def tls_flow(scored: DataFrame, p: str = "p") -> DataFrame:
    """Tier 1 of encrypted flows."""
    return model_alerts(scored, p, "tls", 0.72, f"CASE WHEN {p} > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END", method="flow_stats_ml")


def tls_tier2_alerts(decided: DataFrame, p: str = "p") -> DataFrame:
    """Alerts of what :func:`tls_tier2` holds malicious; the second score counts
    where there is one."""
    own = decided.where("malicious").withColumn("_p", F.expr(f"coalesce(p2, {p})"))
    evidence = "CASE WHEN p2 IS NOT NULL THEN named_struct('tier2_invoked', true, 'tier2_confidence', round(p2, 4)) END"
    return make_alert(own, "tls", "CASE WHEN _p > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END", "_p", evidence, 0, "CASE WHEN p2 IS NOT NULL THEN 'flow_stats_ml+tier2_seq' ELSE 'flow_stats_ml' END", "true")


def flood_ml(scored: DataFrame, p: str = "p") -> DataFrame:
    """Model path of floods: one alert a source in 30 s."""
    hits = gates.cooldown(scored.where(f"{p} > 0.5"), ["src_ip"], 30)
    return model_alerts(hits, p, "ddos", 0.5, "CASE WHEN packet_rate > 600 THEN 'CRITICAL' ELSE 'HIGH' END")


def scan_ml(scored: DataFrame, p: str = "p") -> DataFrame:
    """Model path of scans: one alert a source in 20 s."""
    hits = gates.cooldown(scored.where(f"{p} > 0.5"), ["src_ip"], 20)
    return model_alerts(hits, p, "recon", 0.5, "CASE WHEN unique_ports <= 30 THEN 'MEDIUM' ELSE 'HIGH' END")


def dga_ml(scored: DataFrame, tunnels: DataFrame, p: str = "p") -> DataFrame:
    """Model path of generated domains: rows that the tunnel rule fired on are
    left out, and a source's query alerts once in 300 s."""
    d = scored.join(tunnels.select("uid").distinct(), "uid", "left_anti").where(f"{p} > 0.7")
    d = _at_port_53(gates.cooldown(d, ["src_ip", "query"], 300, row="uid"))
    evidence = f"named_struct('detection_path', if(word_boundary_score > 0.65, 'DICT_DGA', 'RANDOM_DGA'), 'probability', round({p}, 4))"
    return make_alert(d, "dga", f"CASE WHEN {p} > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END", p, evidence, 0, "ml", "true")


def beacon_ml(scored: DataFrame, p: str = "p") -> DataFrame:
    """The model decides in its range (<= 20 rows, mean <= 45 s), the rule beyond."""
    inside = "observations <= 20 AND mean_interval <= 45"
    d = scored.where(f"observations >= 5 AND mean_interval BETWEEN 3 AND 600 AND CASE WHEN {inside} THEN {p} > 0.5 ELSE cv <= 0.35 END")
    conf = f"CASE WHEN {inside} THEN {p} ELSE 0.6D + least((0.35D - cv) / 0.35D * 0.35D, 0.35D) END"
    d = gates.first_only(d, ["src_ip", "dst_ip", "dst_port"])
    return make_alert(d, "c2", "'HIGH'", conf, "array(concat('Repeated connections: ', observations))", 0, f"CASE WHEN {inside} THEN 'ml' ELSE 'rule_fallback_out_of_range' END")


def exfil_ml(scored: DataFrame, p: str = "p") -> DataFrame:
    """A pattern needs p >= .60 (confidence floored at .70, then uncalibrated),
    no pattern needs p >= .80."""
    d = scored.withColumn("pattern", F.expr(features.EXFIL_PATTERN)).where(f"CASE WHEN pattern IS NULL THEN {p} >= 0.8 ELSE {p} >= 0.6 END")
    conf = f"CASE WHEN pattern IS NULL THEN {p} ELSE greatest({p}, 0.70D) END"
    severity = f"CASE WHEN pattern = 'ICMP_COVERT' THEN 'CRITICAL' WHEN {conf} > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END"
    return make_alert(d, "exfil", severity, conf, "named_struct('pattern', coalesce(pattern, 'ML_ONLY'))", 0, "CASE WHEN pattern IS NULL THEN 'ml_only' ELSE 'ml_rule_confirmed' END", f"coalesce(pattern IS NULL OR {p} >= 0.70, true)")


def tls_tier2(scored: DataFrame, tier2: Callable[[DataFrame], DataFrame] | None, threshold2: float = 0.51, p: str = "p") -> DataFrame:
    """Only scores from .4 to .7 with packets are scored again by ``tier2``,
    which adds p2; the others keep tier 1 (p > .72)."""
    band = f"{p} BETWEEN 0.4 AND 0.7 AND size(sizes) > 0"
    if tier2 is None:
        return scored.selectExpr("*", "cast(null AS double) AS p2", f"{p} > 0.72 AS malicious")
    again = tier2(scored.where(band)).selectExpr("*", f"p2 >= {threshold2} AS malicious")
    rest = scored.where(f"NOT coalesce({band}, false)").selectExpr("*", "cast(null AS double) AS p2", f"{p} > 0.72 AS malicious")
    return rest.unionByName(again, allowMissingColumns=True)
