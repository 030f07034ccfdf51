"""Queries over flows: predicates, windows, gates, detectors, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowdetect.functions import expr as x
from flowdetect.operators import correlate, detect, enrich, features, gates, text
from flowdetect.plans.views import duck, view

Q, O = {}, {}


def q(name, sql=None, *views):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = duck(sql, *views)
        return f

    return add


INT = r"regexp_matches({}, '^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)')"
BL = [(k, f"fam{k % 3}") for k in range(0, 97, 13)]


def blacklist(spark):
    return spark.range(97).where("id % 13 = 0").selectExpr("md5(cast(id AS string)) AS hash", "concat('fam', id % 3) AS family")


def joined(spark, d):
    return enrich.join_uid(view(spark, d, "ssl"), view(spark, d, "conn"), view(spark, d, "pktseq"))


JOINED = "j AS (SELECT s.*, c.orig_bytes, c.resp_bytes, c.duration, coalesce(p.sizes, []) AS sizes, coalesce(p.gaps, []) AS gaps FROM ssl s JOIN conn c ON s.uid = c.uid LEFT JOIN pktseq p ON s.uid = p.uid)"

WN1 = """w AS (SELECT *, list(dst_port) OVER v AS ports, list(src_ip) OVER v AS ips, list(ts_us) OVER v AS t FROM {src} WINDOW v AS (ORDER BY ts_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW)),
f AS (SELECT * EXCLUDE (ports, ips, t), len(t) AS packet_rate, len(list_distinct(ports)) AS unique_dst_ports, round(list_aggregate(ports, 'entropy'), 4) AS dst_port_entropy, {iat}, len(list_distinct(ips)) AS unique_src_ips, round(list_aggregate(ips, 'entropy'), 4) AS src_ip_entropy FROM w)"""
GAPS = "list_transform(range(1, len(t)), lambda i: (t[i + 1] - t[i]) / 1e6)"
IAT = f"round(coalesce(list_avg({GAPS}), 0), 4) AS mean_iat, round(coalesce(list_aggregate({GAPS}, 'stddev_pop'), 0), 4) AS std_iat"
F1 = ["event_id", "packet_rate", "unique_dst_ports", "dst_port_entropy", "mean_iat", "std_iat", "unique_src_ips", "src_ip_entropy"]
WN2 = f"""w AS (SELECT *, list(dst_port) OVER v AS ports, list(dst_ip) OVER v AS ips, list(ts_us) OVER v AS t FROM flows WINDOW v AS (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)),
f AS (SELECT * EXCLUDE (ports, ips, t), len(list_distinct(ports)) AS unique_ports, len(list_distinct(ips)) AS unique_hosts, len(t) AS connection_count, round(list_aggregate(ports, 'entropy'), 4) AS port_entropy, list_max(ports) - list_min(ports) AS port_range_span, {IAT} FROM w)"""
F2 = ["event_id", "unique_ports", "unique_hosts", "connection_count", "port_entropy", "port_range_span", "std_iat"]
WN3 = f"""w AS (SELECT *, list(ts_us) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS t FROM flows),
f AS (SELECT * EXCLUDE t, len(t) AS observations, round(coalesce(list_avg({GAPS}), 0), 2) AS mean_interval, round(coalesce(list_aggregate({GAPS}, 'stddev_pop'), 0), 2) AS std_interval,
  CASE WHEN len(t) < 2 THEN NULL WHEN list_avg({GAPS}) = 0 THEN 'Infinity'::DOUBLE ELSE round(list_aggregate({GAPS}, 'stddev_pop') / list_avg({GAPS}), 4) END AS cv FROM w)"""
F3 = ["event_id", "observations", "mean_interval", "std_interval", "cv"]
WN4 = """h AS (SELECT f.*, count(*) OVER v AS m, sum(dst_port_entropy) OVER v AS s1, sum(dst_port_entropy * dst_port_entropy) OVER v AS q1 FROM f WINDOW v AS (ORDER BY ts_us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW)),
g AS (SELECT * EXCLUDE (m, s1, q1), m - 1 AS m, s1 - dst_port_entropy AS s1, q1 - dst_port_entropy * dst_port_entropy AS q1 FROM h),
k AS (SELECT *, CASE WHEN m < 10 THEN 0 ELSE round(abs(dst_port_entropy - s1 / m) / greatest(sqrt(greatest((q1 - s1 * s1 / m) / (m - 1), 0)), 0.01), 3) END AS sigma,
  CASE WHEN m < 10 THEN dst_port_entropy < 1.5 ELSE abs(dst_port_entropy - s1 / m) / greatest(sqrt(greatest((q1 - s1 * s1 / m) / (m - 1), 0)), 0.01) > 2 END AS anomalous FROM g)"""


def cool(src, key, seconds, pre):
    """Greedy cooldown as a recursive query."""
    ks = ", ".join(key)
    same = " AND ".join(f"c.{k} = r.{k}" for k in key)
    return f"""WITH RECURSIVE {pre}, c AS (SELECT * FROM {src}), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY ts_us, event_id) AS rn FROM c) WHERE rn = 1
UNION ALL SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY {', '.join('c.' + k for k in key)} ORDER BY c.ts_us, c.event_id) AS rn FROM c JOIN r ON {same} AND c.ts_us - r.ts_us >= {seconds * 1000000}) WHERE rn = 1)"""


FL = lambda s, d: view(s, d, "flows")
q("wn1_flood_features", f"WITH {WN1.format(src='flows', iat=IAT)} SELECT {', '.join(F1)} FROM f", "flows")(lambda s, d: features.flood_features(FL(s, d)).select(F1))
q("wn2_scan_features", f"WITH {WN2} SELECT {', '.join(F2)} FROM f", "flows")(lambda s, d: features.scan_features(FL(s, d)).select(F2))
q("wn3_beacon_features", f"WITH {WN3} SELECT {', '.join(F3)} FROM f", "flows")(lambda s, d: features.beacon_features(FL(s, d)).select(F3))
q("wn4_entropy_baseline", f"WITH {WN1.format(src='flows', iat=IAT)}, {WN4} SELECT event_id, sigma, anomalous FROM k", "flows")(
    lambda s, d: features.entropy_baseline(features.flood_features(FL(s, d))).select("event_id", "sigma", "anomalous"))
SLOW = "sl AS (SELECT *, count(*) OVER (PARTITION BY dst_ip, dst_port ORDER BY ts_us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS slow_count FROM flows WHERE proto IN ('tcp', 'udp') AND duration > 15 AND orig_bytes < 500)"
q("wn5_slow_connections", f"WITH {SLOW} SELECT event_id, slow_count FROM sl", "flows")(lambda s, d: features.slow_conns(FL(s, d).where("proto IN ('tcp', 'udp')")).select("event_id", "slow_count"))
q("wn11_alert_gaps", """SELECT seq, CASE WHEN event_ts > lag(event_ts) OVER w THEN round(event_ts - lag(event_ts) OVER w, 3) END AS gap FROM alerts WINDOW w AS (PARTITION BY threat_class ORDER BY event_ts, seq)""", "alerts")(
    lambda s, d: correlate.gaps(view(s, d, "alerts")).select("seq", F.col("class_gap").alias("gap")))
q("wn11_all_gaps", "SELECT seq, CASE WHEN event_ts > lag(event_ts) OVER w THEN round(event_ts - lag(event_ts) OVER w, 3) END AS gap FROM alerts WINDOW w AS (ORDER BY event_ts, seq)", "alerts")(
    lambda s, d: correlate.gaps(view(s, d, "alerts")).select("seq", F.col("all_gap").alias("gap")))
A = ["flow_id", "src_ip", "dst_ip", "dst_port", "threat_class", "severity", "confidence", "detection_method"]


def alerts_sql(cls, severity, confidence, method):
    return f" SELECT uid AS flow_id, src_ip, dst_ip, dst_port, '{cls}' AS threat_class, {severity} AS severity, round(least(({confidence})::DOUBLE, 0.99), 2) AS confidence, '{method}' AS detection_method FROM "


SCAN = cool("(SELECT * FROM f WHERE unique_ports > 15 OR unique_hosts > 10)", ["src_ip"], 20, WN2) + alerts_sql("recon", "CASE WHEN unique_ports <= 30 THEN 'MEDIUM' ELSE 'HIGH' END", "0.6 + least(unique_ports / 15.0 * 0.3, 0.35)", "rule_fallback_no_model") + "r"
q("entry_scan_alerts", SCAN, "flows")(lambda s, d: detect.scan_rule(FL(s, d)).select(A))
q("dt4_scan_rule", SCAN, "flows")(lambda s, d: detect.REGISTRY["scan_rule"](FL(s, d)).select(A))
SLOWC = cool("(SELECT * FROM sl WHERE slow_count >= 25)", ["dst_ip", "dst_port"], 30, SLOW)
q("dt3_slow_http", SLOWC + alerts_sql("ddos", "'HIGH'", "least(0.95, 0.6 + slow_count / 100.0)", "rule_based") + "r", "flows")(lambda s, d: detect.slow_http(FL(s, d)).select(A))
q("gt1_cooldown", SLOWC + " SELECT event_id FROM r", "flows")(lambda s, d: gates.cooldown(features.slow_conns(FL(s, d).where("proto IN ('tcp', 'udp')")).where("slow_count >= 25"), ["dst_ip", "dst_port"], 30).select("event_id"))
BEA = f"WITH {WN3}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, event_id) AS rn FROM f WHERE observations >= 5 AND mean_interval BETWEEN 3 AND 600 AND cv <= 0.35) WHERE rn = 1)"
q("dt6_beacon_rule", BEA + alerts_sql("c2", "'HIGH'", "0.6 + least((0.35 - cv) / 0.35 * 0.35, 0.35)", "rule_fallback_no_model") + "r", "flows")(lambda s, d: detect.beacon_rule(FL(s, d)).select(A))
q("gt2_first_only", BEA + " SELECT event_id FROM r", "flows")(lambda s, d: gates.first_only(features.beacon_features(FL(s, d)).where(detect.BEACON), ["src_ip", "dst_ip", "dst_port"]).select("event_id"))
FLOODPRE = SLOWC[len("WITH RECURSIVE "):].replace("c AS (", "sc AS (").replace(", r AS", ", sr AS").replace("FROM c)", "FROM sc)").replace("FROM c JOIN r ON", "FROM sc c JOIN sr r ON") + f", rest AS (SELECT * FROM flows WHERE proto IN ('tcp', 'udp') AND event_id NOT IN (SELECT event_id FROM sr)), {WN1.format(src='rest', iat=IAT)}, {WN4}"
q("dt2_flood_rule", cool("(SELECT * FROM k WHERE anomalous)", ["src_ip"], 30, FLOODPRE) + " SELECT event_id FROM r", "flows")(
    lambda s, d: detect.flood_rule(FL(s, d)).selectExpr("cast(substr(flow_id, 2) AS bigint) AS event_id"))
q("dt8_dns_tunnel", """WITH g AS (SELECT *, regexp_replace(query, '[.]+$', '') AS qn FROM dns), r AS (SELECT *, len(qn) AS ql, len(answers) AS al FROM g WHERE len(qn) >= 10 AND qtype_name IN ('TXT', 'NULL') AND NOT (qn LIKE '%.local' OR qn LIKE '%.internal' OR qn LIKE '%.arpa'))
SELECT uid AS flow_id, src_ip, NULL AS dst_ip, 53 AS dst_port, 'dga' AS threat_class, 'HIGH' AS severity, round(least(least(0.97, 0.6 + ql / 200.0 + greatest(al / greatest(ql, 1), ql / greatest(al, 1)) / 20), 0.99), 2) AS confidence, 'rule_based' AS detection_method FROM r WHERE ql > 50 AND greatest(al / greatest(ql, 1), ql / greatest(al, 1)) > 3""", "dns")(
    lambda s, d: detect.dns_tunnel(view(s, d, "dns")).select(A))
q("prj9_dns_gate", "SELECT uid, regexp_replace(query, '[.]+$', '') AS query FROM dns WHERE len(regexp_replace(query, '[.]+$', '')) >= 10 AND qtype_name <> 'PTR'", "dns")(lambda s, d: detect.dns_gate(view(s, d, "dns")).select("uid", "query"))
EX = f"""WITH e AS (SELECT *, orig_bytes / greatest(resp_bytes, 1) AS br, orig_bytes / (CASE WHEN duration = 0 THEN 0.001 ELSE duration END) AS bps FROM flows WHERE NOT ({INT.format('src_ip')} AND {INT.format('dst_ip')}) AND orig_bytes >= 1000),
p AS (SELECT *, CASE WHEN lower(proto) = 'icmp' AND orig_bytes > 1000 THEN 'ICMP_COVERT' WHEN dst_port = 53 AND orig_bytes > 5000 THEN 'DNS_EXFIL' WHEN br > 5.0 AND orig_bytes > 500000 THEN 'HIGH_UPLOAD' WHEN duration > 300 AND br > 2.0 THEN 'SUSTAINED_UPLOAD' END AS pattern FROM e)"""
q("fn10_fn11_exfil_features", EX + " SELECT event_id, round(br, 4) AS byte_ratio, round(bps, 2) AS bytes_per_sec, (lower(proto) = 'icmp')::INT AS is_icmp, (dst_port = 53)::INT AS to_dns, (dst_port IN (80, 443, 8080))::INT AS to_common_port, pattern FROM p", "flows")(
    lambda s, d: features.exfil_features(detect.exfil_gate(FL(s, d))).selectExpr("event_id", "round(byte_ratio, 4) AS byte_ratio", "round(bytes_per_sec, 2) AS bytes_per_sec", "is_icmp", "to_dns", "to_common_port", f"{features.EXFIL_PATTERN} AS pattern"))
q("dt10_exfil_pattern", EX + alerts_sql("exfil", "CASE WHEN pattern = 'ICMP_COVERT' THEN 'CRITICAL' ELSE 'MEDIUM' END", "0.7", "rule_based") + "p WHERE pattern IS NOT NULL", "flows")(lambda s, d: detect.exfil_pattern(FL(s, d)).select(A))
q("prj6_internal", f"SELECT event_id, {INT.format('src_ip')} AS src_internal, {INT.format('dst_ip')} AS dst_internal FROM flows", "flows")(lambda s, d: FL(s, d).selectExpr("event_id", f"{x.is_internal('src_ip')} AS src_internal", f"{x.is_internal('dst_ip')} AS dst_internal"))
q("prj5_prj7_gates", f"SELECT event_id FROM flows WHERE proto IN ('tcp', 'udp') AND NOT ({INT.format('src_ip')} AND {INT.format('dst_ip')}) AND orig_bytes >= 1000", "flows")(lambda s, d: detect.exfil_gate(FL(s, d).where("proto IN ('tcp', 'udp')")).select("event_id"))
q("jn1_join_uid", f"WITH {JOINED} SELECT uid, orig_bytes, resp_bytes, duration, len(sizes) AS n, coalesce(list_sum(sizes), 0)::BIGINT AS total FROM j", "ssl", "conn", "pktseq")(
    lambda s, d: joined(s, d).selectExpr("uid", "orig_bytes", "resp_bytes", "duration", "cast(size(sizes) AS bigint) AS n", "aggregate(sizes, 0L, (a, b) -> a + b) AS total"))
q("jn2_last_by_uid", "SELECT src_ip, event_id, dst_ip FROM flows QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY event_id DESC) = 1", "flows")(lambda s, d: enrich.last_by_uid(FL(s, d), "src_ip").select("src_ip", "event_id", "dst_ip"))
q("jn4_join_uid_bounded", "SELECT s.uid, coalesce(c.orig_bytes, 0) AS orig_bytes, coalesce(c.duration, 0) AS duration FROM ssl s LEFT JOIN conn c ON s.uid = c.uid AND c.ts_us BETWEEN s.ts_us - 30000000 AND s.ts_us + 30000000", "ssl", "conn")(
    lambda s, d: enrich.join_uid_bounded(view(s, d, "ssl"), view(s, d, "conn")).select("uid", "orig_bytes", "duration"))
GATE = f"NOT {INT.format('dst_ip')} AND duration >= 0.1 AND orig_bytes + resp_bytes >= 100"
q("prj8_tls_gate", f"WITH {JOINED} SELECT uid FROM j WHERE {GATE}", "ssl", "conn", "pktseq")(lambda s, d: detect.tls_gate(joined(s, d)).select("uid"))
BLS = "b AS (SELECT md5(k::VARCHAR) AS hash, 'fam' || (k % 3) AS family FROM range(0, 97, 13) t(k))"
q("dt11_jn5_tls_blacklist", f"WITH {JOINED}, {BLS} SELECT uid AS flow_id, src_ip, dst_ip, dst_port, 'tls' AS threat_class, 'HIGH' AS severity, 0.95::DOUBLE AS confidence, 'ja3_blacklist' AS detection_method, family FROM j JOIN b ON j.ja3 = b.hash WHERE {GATE}", "ssl", "conn", "pktseq")(
    lambda s, d: detect.tls_blacklist(joined(s, d), blacklist(s)).selectExpr(*A, "get_json_object(evidence_json, '$.family') AS family"))
q("fn12_tls_features", f"WITH {JOINED} SELECT uid, orig_bytes + resp_bytes AS total_bytes, round(coalesce(list_avg(sizes), 0), 4) AS size_mean, CASE WHEN len(sizes) > 1 THEN round(list_aggregate(sizes, 'stddev_pop'), 4) ELSE 0 END AS size_std, round(coalesce(list_avg(gaps), 0), 4) AS gap_mean, CASE WHEN len(gaps) > 1 THEN round(list_aggregate(gaps, 'stddev_pop'), 4) ELSE 0 END AS gap_std, len(sizes) AS n_pkts, (log_type = 'quic')::INT AS is_quic FROM j", "ssl", "conn", "pktseq")(
    lambda s, d: features.tls_features(joined(s, d)).select("uid", "total_bytes", "size_mean", "size_std", "gap_mean", "gap_std", "n_pkts", "is_quic"))
PAD = "list_resize({}, 12, 0.0::DOUBLE)"
SZ, GP, MK = (PAD.format(f"list_transform({a}[1:12], lambda v: {e})") for a, e in (("sizes", "round(v / 1500.0::DOUBLE, 6)"), ("gaps", "round(ln(1 + greatest(v, 0)) / ln(3), 6)"), ("sizes", "1.0::DOUBLE")))
q("fn13_pack_sequence", f"WITH {JOINED} SELECT uid, round(list_sum({SZ}), 4) AS s, round(list_sum({GP}), 4) AS g, list_sum({MK}) AS m, len({SZ}) AS n FROM j", "ssl", "conn", "pktseq")(
    lambda s, d: features.pack_sequence(joined(s, d)).selectExpr("uid", *(f"round(aggregate({c}, 0D, (a, b) -> a + b), 4) AS {n}" for c, n in (("seq_sizes", "s"), ("seq_gaps", "g"))), "aggregate(seq_mask, 0D, (a, b) -> a + b) AS m", "size(seq_sizes) AS n"))
q("fn1_fn3_array_stats", f"WITH w AS (SELECT src_ip, list(dst_port) AS p, list(ts_us ORDER BY ts_us) AS t FROM flows GROUP BY src_ip) SELECT src_ip, round(list_aggregate(p, 'entropy'), 4) AS entropy, round(list_avg({GAPS}), 4) AS mean, round(list_aggregate({GAPS}, 'stddev_pop'), 4) AS std FROM w", "flows")(
    lambda s, d: FL(s, d).groupBy("src_ip").agg(F.collect_list("dst_port").alias("p"), F.collect_list("ts_us").alias("t")).withColumn("i", F.expr(x.interval_stats("t"))).selectExpr("src_ip", f"round({x.entropy('p')}, 4) AS entropy", "round(i.mean, 4) AS mean", "round(i.std, 4) AS std"))
q("fn2_fn9_dns_functions", """SELECT uid, round(list_aggregate(string_split(lower(query), ''), 'entropy'), 4) AS char_entropy,
 round(CASE WHEN len(regexp_replace(lower(query), '[^a-z]', '', 'g')) = 0 THEN 0 ELSE len(regexp_replace(lower(query), '[^b-df-hj-np-tv-z]', '', 'g')) / len(regexp_replace(lower(query), '[^a-z]', '', 'g')) END, 4) AS consonant_ratio,
 round(len(regexp_replace(query, '[^0-9]', '', 'g')) / greatest(len(query), 1), 4) AS numeric_ratio, string_split(query, '.')[1] AS first_label, string_split(query, '.')[-1] AS tld,
 string_split(query, '.')[-1] IN ('com', 'net', 'org', 'gov', 'edu', 'io', 'co', 'uk', 'de', 'fr', 'us', 'ai', 'dev', 'app', 'so', 'me') AS known,
 round(greatest(len(answers) / greatest(len(query), 1), len(query) / greatest(len(answers), 1)), 4) AS ratio, CASE WHEN len(answers) / greatest(len(query), 1) >= len(query) / greatest(len(answers), 1) THEN 'DOWNSTREAM' ELSE 'UPSTREAM' END AS direction FROM dns""", "dns")(
    lambda s, d: view(s, d, "dns").withColumn("t", F.expr(x.tunnel_ratio("query", "answers"))).selectExpr("uid", f"round({x.char_entropy('query')}, 4) AS char_entropy", f"round({x.consonant_ratio('query')}, 4) AS consonant_ratio", f"round({x.numeric_ratio('query')}, 4) AS numeric_ratio", "split(query, '\\\\.')[0] AS first_label", f"{x.tld('query')} AS tld", f"{x.tld_known('query')} AS known", "round(t.ratio, 4) AS ratio", "t.direction"))
GR = "g AS (SELECT doc_id, substr(t, i, 3) AS gram FROM (SELECT doc_id, lower(source || ' ' || lang) AS t, unnest(range(1, len(source || ' ' || lang) - 1)) AS i FROM documents) WHERE regexp_matches(substr(t, i, 3), '^[a-z]{3}$'))"
q("ag18_trigram_model", """WITH w AS (SELECT lower(text) AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM w), n AS (SELECT gram, count(*) AS n FROM g WHERE regexp_matches(gram, '^[a-z]{3}$') GROUP BY gram)
SELECT gram, round(log2(n / sum(n) OVER ()), 4) AS logp FROM n""", "documents")(lambda s, d: text.trigram_model(view(s, d, "documents"), "text"))
q("fn6_ngram_score", """WITH w AS (SELECT lower(text) AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM w), n AS (SELECT gram, count(*) AS n FROM g WHERE regexp_matches(gram, '^[a-z]{3}$') GROUP BY gram), m AS (SELECT gram, round(log2(n / sum(n) OVER ()), 4) AS logp FROM n),
k AS (SELECT uid, unnest(list_transform(range(1, len(query) - 1), lambda i: substr(lower(query), i, 3))) AS gram FROM dns), z AS (SELECT uid, avg(coalesce(logp, -10)) AS a FROM k LEFT JOIN m USING (gram) WHERE regexp_matches(gram, '^[a-z]{3}$') GROUP BY uid)
SELECT dns.uid, round(coalesce(a, -10), 9) AS ngram_score FROM dns LEFT JOIN z ON dns.uid = z.uid""", "dns")(lambda s, d: text.ngram_score(view(s, d, "dns"), "uid", "query", text.trigram_model(view(s, d, "documents"), "text")))
q("src13_words", """SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(trim(text)), '[^a-z]+')) AS word FROM documents) WHERE len(word) BETWEEN 3 AND 10""", "documents")(lambda s, d: text.words(view(s, d, "documents"), "text"))
q("fn7_word_boundary_score", """WITH RECURSIVE lex AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(trim(text)), '[^a-z]+')) AS word FROM documents) WHERE len(word) BETWEEN 3 AND 10),
l AS (SELECT uid, string_split(query, '.')[1] AS lab FROM dns), c AS (SELECT uid, p, max(n) AS n FROM (SELECT uid, lab, unnest(range(1, len(lab) + 1)) AS p FROM l) CROSS JOIN range(3, 13) r(n) WHERE p + n - 1 <= len(lab) AND lower(substr(lab, p, n)) IN (SELECT word FROM lex) GROUP BY uid, p),
w AS (SELECT uid, len(lab) AS ln, 1 AS p, 0 AS m FROM l UNION ALL SELECT w.uid, ln, w.p + coalesce(c.n, 1), m + coalesce(c.n, 0) FROM w LEFT JOIN c ON w.uid = c.uid AND w.p = c.p WHERE w.p <= ln)
SELECT uid, round(max(m) / greatest(max(ln), 1), 4) AS wbs FROM w GROUP BY uid""", "dns")(
    lambda s, d: text.word_boundary_score(view(s, d, "dns").selectExpr("uid", "split(query, '\\\\.')[0] AS label"), "uid", "label", text.words(view(s, d, "documents"), "text")))
