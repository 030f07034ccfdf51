"""Queries over alerts: reports, exports, custody, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowdetect.functions import expr as x
from flowdetect.operators import correlate, custody, export, report
from flowdetect.plans.views import duck, stored, view

Q, O = {}, {}


def q(name, sql, f, *views):
    Q[name] = lambda s, d: f(view(s, d, "alerts"))
    if sql:
        O[name] = duck(sql, *(views or ("alerts",)))


R = report
KEYS = ", ".join(f"('{c}')" for c in R.CLASSES)
q("src15_last_alerts", "SELECT seq, threat_class FROM alerts ORDER BY seq DESC LIMIT 50", lambda a: R.last_alerts(a, 50).select("seq", "threat_class"))
q("ag2_stats", f"WITH l AS (SELECT threat_class FROM alerts ORDER BY seq DESC LIMIT 500), o AS (SELECT k.threat_class, count(l.threat_class) AS count FROM (VALUES {KEYS}) k(threat_class) LEFT JOIN l ON l.threat_class = k.threat_class GROUP BY 1) SELECT * FROM o UNION ALL SELECT 'total', sum(count)::BIGINT FROM o", lambda a: R.stats(a))
q("ag3_tally", "SELECT dst_ip AS key, count(*) AS count FROM alerts WHERE dst_ip IS NOT NULL AND dst_ip <> '' GROUP BY 1", lambda a: R.tally(a, "dst_ip"))
q("ag4_confidence_histogram", "SELECT b AS bin, count(confidence) AS count FROM range(10) t(b) LEFT JOIN alerts ON least(9, floor(confidence * 10)) = b GROUP BY 1", lambda a: R.confidence_histogram(a))
q("ag5_by_hour", "SELECT h AS hour, count(ts_us) AS count FROM range(24) t(h) LEFT JOIN alerts ON hour(make_timestamp(ts_us)) = h GROUP BY 1", lambda a: R.by_hour(a))
q("ag6_timeline", "WITH e AS (SELECT min(ts_us) AS s, max(ts_us) AS e FROM alerts) SELECT least(15, floor((ts_us - s) / greatest(e - s, 1000) * 16))::BIGINT AS bucket, threat_class, count(*) AS count FROM alerts, e GROUP BY 1, 2", lambda a: R.timeline(a))
LINKS = "n AS (SELECT src_ip, dst_ip, threat_class, count(*) AS c FROM alerts WHERE dst_ip IS NOT NULL GROUP BY ALL), l AS (SELECT src_ip, dst_ip, sum(c)::BIGINT AS n, arg_min(threat_class, (-c, threat_class)) AS dominant FROM n GROUP BY 1, 2)"
q("ag7_flow_links", f"WITH {LINKS} SELECT * FROM l", lambda a: R.flow_links(a))
q("jn13_tk2_flow_map", f"WITH {LINKS} SELECT * FROM l WHERE src_ip IN (SELECT src_ip FROM l GROUP BY 1 ORDER BY sum(n) DESC, src_ip LIMIT 10) AND dst_ip IN (SELECT dst_ip FROM l GROUP BY 1 ORDER BY sum(n) DESC, dst_ip LIMIT 10)", lambda a: R.flow_map(a))
q("ag8_summary", "SELECT threat_class, severity, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((threat_class), (severity), ())", lambda a: R.summary(a))
q("ag10_class_share", "WITH n AS (SELECT threat_class, count(*) AS c FROM alerts GROUP BY 1) SELECT threat_class, round(c / sum(c) OVER (), 6) AS share, round(sum(c) OVER (ORDER BY threat_class) / sum(c) OVER (), 6) AS cumulative FROM n", lambda a: R.class_share(a))
q("ag11_latency", "WITH v AS (SELECT confidence AS v, row_number() OVER (ORDER BY confidence) - 1 AS i, count(*) OVER () AS n FROM alerts) SELECT count(*) AS n, min(v) AS low, max(v) AS high, max(v) FILTER (i = n // 2) AS median FROM v", lambda a: R.latency(a, "confidence"))
q("ag23_rate_summary", "SELECT coalesce(max(confidence), 0) AS peak, coalesce(round(avg(confidence), 2), 0) AS mean FROM alerts", lambda a: R.rate_summary(a, "confidence"))
q("prj11_search", "SELECT seq FROM alerts WHERE threat_class = 'c2' AND severity = 'HIGH' AND contains(src_ip, '0.1')", lambda a: R.search_alerts(a, "C2", "high", "0.1").select("seq"))
q("prj12_since", "SELECT seq FROM alerts WHERE event_ts >= 1704070000", lambda a: R.alerts_since(a, 1704070000.0).select("seq"))
q("tk1_top_k", "SELECT src_ip AS key, count(*) AS count FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", lambda a: R.top_k(a, "src_ip"))
q("tk3_top_alerts", "SELECT seq, confidence FROM alerts WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY confidence DESC, seq LIMIT 5", lambda a: R.top_alerts(a).select("seq", "confidence"))
q("tk6_feed", "WITH f AS (SELECT * FROM alerts WHERE flow_id IS NULL UNION ALL SELECT * FROM alerts WHERE flow_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY flow_id ORDER BY ts_us DESC, seq DESC) = 1) SELECT seq FROM f ORDER BY ts_us DESC, seq DESC LIMIT 200", lambda a: R.feed(a).select("seq"))
q("ag12_throughput", "WITH g AS (SELECT DISTINCT unnest(range(ts_us // 60000000 - 9, ts_us // 60000000 + 1)) AS w FROM alerts) SELECT w, count(*) / 10.0::DOUBLE AS rate FROM g JOIN alerts ON ts_us // 60000000 BETWEEN w AND w + 9 GROUP BY w",
  lambda a: a.select(F.explode(F.expr("sequence(ts_us DIV 60000000 - 9, ts_us DIV 60000000)")).alias("w")).groupBy("w").agg((F.count("*") / 10.0).alias("rate")))
q("sm12_running_stats", "SELECT threat_class, count(*) AS count FROM alerts GROUP BY 1", lambda a: a.groupBy("threat_class").count())
M = "(SELECT detector, avg(confidence) AS precision, max(confidence) AS recall FROM alerts GROUP BY 1)"
mt = lambda a: a.groupBy("detector").agg(F.avg("confidence").alias("precision"), F.max("confidence").alias("recall"))
q("prj15_metrics_long", f"SELECT detector, 'precision' AS metric, round(precision * 100, 1) AS percent FROM {M} UNION ALL SELECT detector, 'recall', round(recall * 100, 1) FROM {M}", lambda a: R.metrics_long(mt(a), ("precision", "recall")))
q("jn12_model_metrics", f"SELECT m.detector, round(precision, 6) AS precision, recall, l.latency, 71.3::DOUBLE AS flows_per_s FROM {M} m LEFT JOIN (SELECT 'det_1' AS detector, 2.5::DOUBLE AS latency) l USING (detector)",
  lambda a: R.model_metrics(mt(a), a.sparkSession.sql("SELECT 'det_1' AS detector, 2.5D AS latency"), a.sparkSession.sql("SELECT 71.3D AS flows_per_s")).withColumn("precision", F.round("precision", 6)))
q("tk8_latency_rank", "SELECT detector, max(confidence) AS latency FROM alerts GROUP BY 1", lambda a: R.latency_rank(a.groupBy("detector").agg(F.max("confidence").alias("latency"))))
H = r"replace(replace({}, '\', '\\'), '|', '\|')"
V = r"replace(replace({}, '\', '\\'), '=', '\=')"
q("exp2_cef", rf"""SELECT seq, concat_ws('|', 'CEF:0', 'FlowDetect', 'ThreatPipeline', '1.0', threat_class, threat_class, (CASE severity WHEN 'CRITICAL' THEN 9 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 5 END)::VARCHAR) || '|' || concat_ws(' ', 'src=' || src_ip, 'dst=' || dst_ip, 'dpt=' || dst_port::VARCHAR, 'cn1=' || round(confidence * 100)::INT::VARCHAR, 'cn1Label=confidencePercent', 'cs1=' || {V.format('evidence')}, 'cs1Label=evidence', 'cs2=' || flow_id, 'cs2Label=flowId') AS line FROM alerts""", export.cef)
q("exp1_stix", """SELECT seq, concat_ws(' AND ', '[ipv4-addr:value = ''' || src_ip || ''']', '[ipv4-addr:value = ''' || dst_ip || ''']', '[network-traffic:dst_port = ' || dst_port || ']') AS pattern,
CASE threat_class WHEN 'ddos' THEN 'denial-of-service' WHEN 'recon' THEN 'reconnaissance' WHEN 'c2' THEN 'command-and-control' WHEN 'exfil' THEN 'exfiltration' ELSE 'malicious-activity' END AS label, threat_class, round(confidence * 100)::BIGINT AS confidence, flow_id AS x_flow_id, severity AS x_severity FROM alerts""", export.stix)
chained = lambda a: custody.append(a.select(F.col("src_ip").alias("chain_id"), F.col("seq").alias("pos"), custody.canonical("seq", "threat_class").alias("body")))
BODY = """b AS (SELECT src_ip AS chain_id, seq AS pos, row_number() OVER (PARTITION BY src_ip ORDER BY seq) - 1 AS i, '{"seq":' || seq || ',"threat_class":"' || threat_class || '"}' AS body FROM alerts)"""
CHAIN = f"WITH RECURSIVE {BODY}, c AS (SELECT chain_id, i, pos, body, repeat('0', 64) AS prev_hash, sha256(body || '|' || repeat('0', 64)) AS record_hash FROM b WHERE i = 0 UNION ALL SELECT b.chain_id, b.i, b.pos, b.body, c.record_hash, sha256(b.body || '|' || c.record_hash) FROM c JOIN b ON b.chain_id = c.chain_id AND b.i = c.i + 1)"
q("ch1_append", CHAIN + " SELECT chain_id, pos, body, i AS seq, prev_hash, record_hash FROM c", chained)
q("ch2_verify", CHAIN + """, k AS (SELECT * REPLACE (CASE WHEN i = 3 THEN body || ' ' ELSE body END AS body) FROM c), v AS (SELECT chain_id, i, CASE WHEN prev_hash <> coalesce(lag(record_hash) OVER (PARTITION BY chain_id ORDER BY i), repeat('0', 64)) THEN 'broken link' WHEN record_hash <> sha256(body || '|' || prev_hash) THEN 'content changed' END AS detail FROM k)
SELECT chain_id, count(detail) = 0 AS valid, count(*) AS total, coalesce(min(i) FILTER (detail IS NOT NULL), count(*)) AS verified, min(i) FILTER (detail IS NOT NULL) AS broken_at, arg_min(detail, i) FILTER (detail IS NOT NULL) AS detail FROM v GROUP BY 1""",
  lambda a: custody.verify(chained(a).withColumn("body", F.expr("if(seq = 3, concat(body, ' '), body)"))))


def resumed(a):
    """The chains in two parts: what comes later goes on from the stored heads."""
    rows = a.select(F.col("src_ip").alias("chain_id"), F.col("seq").alias("pos"), custody.canonical("seq", "threat_class").alias("body"))
    first = stored(custody.append(rows.where("pos < 2000")), "chain")
    rest = rows.join(first.select("chain_id", "pos"), ["chain_id", "pos"], "left_anti")
    return first.unionByName(custody.append(rest, custody.tail(first)))


q("ch3_resume", CHAIN.replace("seq AS pos, row_number() OVER (PARTITION BY src_ip ORDER BY seq) - 1 AS i", "seq AS pos, row_number() OVER (PARTITION BY src_ip ORDER BY seq >= 2000, seq) - 1 AS i") + " SELECT chain_id, pos, body, i AS seq, prev_hash, record_hash FROM c", resumed)
q("ch3_tail", CHAIN + " SELECT chain_id, max(i) AS seq, arg_max(record_hash, i) AS record_hash FROM c GROUP BY 1", lambda a: custody.tail(chained(a)))
q("fn19_canonical", """SELECT seq, sha256('{"seq":' || seq || ',"threat_class":"' || threat_class || '"}') AS h FROM alerts""", lambda a: a.select("seq", F.sha2(custody.canonical("threat_class", "seq"), 256).alias("h")))
PAT = []
for p, (name, classes, sec, conf, sev) in enumerate(correlate.PATTERNS):
    PAT.append(f"SELECT a.seq, {p} AS priority, '{name}' AS pattern, {conf}::DOUBLE AS confidence, '{sev}' AS severity, count(DISTINCT coalesce(b.flow_id, b.ts_us || ':' || b.threat_class)) AS n_ids FROM alerts a JOIN alerts b ON a.src_ip = b.src_ip AND b.ts_us <= a.ts_us AND b.ts_us > a.ts_us - {sec * 1000000} AND b.threat_class IN {classes} GROUP BY a.seq HAVING count(DISTINCT b.threat_class) = {len(classes)}")
q("cr1_patterns", " UNION ALL ".join(PAT), lambda a: correlate.patterns(a).selectExpr("seq", "priority", "pattern", "confidence", "severity", "cast(size(ids) AS bigint) AS n_ids"))
# Candidates of the pattern table: (seq, priority, pattern, ids, last 20 rows).
PATTERN_TABLE = "pt(priority, pattern, need, us, conf, sev) AS (VALUES (0, 'KILL_CHAIN', ['recon', 'c2', 'exfil'], 600000000, 0.97::DOUBLE, 'CRITICAL'), (1, 'C2_EXFIL', ['c2', 'exfil'], 600000000, 0.92::DOUBLE, 'CRITICAL'), (2, 'DGA_C2', ['dga', 'c2'], 120000000, 0.88::DOUBLE, 'HIGH'), (3, 'RECON_DDOS', ['recon', 'ddos'], 300000000, 0.85::DOUBLE, 'HIGH'))"
CANDIDATES = f"""{PATTERN_TABLE},
cand AS (SELECT a.seq, a.src_ip, a.ts_us, a.event_ts, a.dst_ip, priority, pattern, any_value(conf) AS conf, any_value(sev) AS sev, list_sort(list_distinct(list(coalesce(b.flow_id, b.ts_us || ':' || b.threat_class)))) AS ids,
  list_sort(list({{'ts_us': b.ts_us, 'seq': b.seq, 'threat_class': b.threat_class}}))[-20:] AS rows20
  FROM alerts a CROSS JOIN pt JOIN alerts b ON b.src_ip = a.src_ip AND b.ts_us <= a.ts_us AND b.ts_us > a.ts_us - us AND list_contains(need, b.threat_class)
  GROUP BY a.seq, a.src_ip, a.ts_us, a.event_ts, a.dst_ip, priority, pattern HAVING count(DISTINCT b.threat_class) = len(any_value(need)))"""


def fired_sql(cand: str) -> str:
    """Alerts in order per source; the first candidate that is news fires."""
    return f"""turns AS (SELECT seq, src_ip, ts_us, list({{'priority': priority, 'pattern': pattern, 'ids': ids}} ORDER BY priority) AS c, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, seq) AS i FROM {cand} GROUP BY seq, src_ip, ts_us),
nil AS (SELECT [{{'pattern': '', 't': 0::BIGINT, 'ids': ['']}}] AS st),
walk AS (SELECT src_ip, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS pattern, st FROM (SELECT DISTINCT src_ip FROM turns), nil
  UNION ALL SELECT src_ip, i, seq, hit.pattern, CASE WHEN hit IS NULL THEN st ELSE list_append(list_filter(st, lambda s: s.pattern <> hit.pattern), {{'pattern': hit.pattern, 't': ts_us, 'ids': hit.ids}}) END
  FROM (SELECT t.src_ip, t.i, t.seq, t.ts_us, st, list_filter(c, lambda x: NOT list_bool_or(list_transform(st, lambda s: s.pattern = x.pattern AND t.ts_us - s.t <= 900000000 AND list_has_all(s.ids, x.ids))))[1] AS hit
    FROM walk w JOIN turns t ON t.src_ip = w.src_ip AND t.i = w.i + 1)),
fired AS (SELECT c.* FROM walk w JOIN {cand} c ON c.seq = w.seq AND c.pattern = w.pattern WHERE w.pattern IS NOT NULL)"""


CAND = "WITH RECURSIVE " + CANDIDATES + ", " + fired_sql("cand")
q("cr2_fire", CAND + " SELECT seq, src_ip, pattern, conf AS confidence FROM fired", lambda a: correlate.fire(a).selectExpr("seq", "src_ip", "pattern", "confidence"))
EW = """WITH RECURSIVE g AS (SELECT seq, threat_class, ts_us, row_number() OVER (PARTITION BY threat_class ORDER BY ts_us, seq) AS i, (ts_us - lag(ts_us) OVER (PARTITION BY threat_class ORDER BY ts_us, seq)) / 1e6 AS gap FROM alerts),
r AS (SELECT seq, threat_class, i, NULL::DOUBLE AS m, 0 AS n FROM g WHERE i = 1 UNION ALL SELECT g.seq, g.threat_class, g.i, CASE WHEN gap > 0 THEN coalesce(0.2 * gap + 0.8 * r.m, gap) ELSE r.m END, r.n + (gap > 0)::INT FROM r JOIN g ON g.threat_class = r.threat_class AND g.i = r.i + 1)
SELECT seq, round(m, 3) AS class_gap, n AS class_n FROM r"""
q("cr4_rate_baseline", EW, lambda a: correlate.rate_baseline(a).select("seq", F.round("class_gap", 3).alias("class_gap"), "class_n"))
# Running mean gaps of each class and of all alerts, then the adaptive layer.
EWMA = """g AS (SELECT k, ts_us, row_number() OVER w AS i, (ts_us - lag(ts_us) OVER w) / 1e6 AS gap FROM (SELECT DISTINCT threat_class AS k, ts_us FROM alerts UNION ALL SELECT DISTINCT '*', ts_us FROM alerts) WINDOW w AS (PARTITION BY k ORDER BY ts_us)),
ew AS (SELECT k, ts_us, i, NULL::DOUBLE AS m, 0 AS n FROM g WHERE i = 1 UNION ALL SELECT g.k, g.ts_us, g.i, coalesce(0.2::DOUBLE * gap + 0.8::DOUBLE * m, gap), n + 1 FROM ew JOIN g ON g.k = ew.k AND g.i = ew.i + 1)"""
ADAPT = f"""{EWMA},
w AS (SELECT a.*, CASE WHEN m IS NULL THEN 300 ELSE least(900, greatest(60, 3 * m)) END AS win FROM alerts a JOIN ew ON k = '*' AND ew.ts_us = a.ts_us),
fr AS (SELECT w.seq, w.src_ip, w.ts_us, w.event_ts, w.dst_ip, win, list_sort(list_distinct(list(b.threat_class))) AS classes, list_sort(list_distinct(list(coalesce(b.flow_id, b.ts_us || ':' || b.threat_class)))) AS ids,
  list_sort(list({{'ts_us': b.ts_us, 'seq': b.seq, 'threat_class': b.threat_class}}))[-20:] AS rows20
  FROM w JOIN alerts b ON b.src_ip = w.src_ip AND b.ts_us <= w.ts_us AND b.ts_us > w.ts_us - 900000000 AND b.ts_us > w.ts_us - CAST(trunc(win * 1000000) AS BIGINT) GROUP BY ALL),
pc AS (SELECT seq, ts_us, win, unnest(classes) AS k FROM fr WHERE len(classes) >= 2),
ps AS (SELECT pc.seq, sum(-ln(greatest(CASE WHEN n < 3 THEN 1 ELSE 1 - exp(-win / greatest(m, 1e-6)) END, 1e-6))) AS score FROM pc ASOF JOIN ew ON pc.k = ew.k AND pc.ts_us >= ew.ts_us GROUP BY pc.seq),
ad AS (SELECT fr.seq, src_ip, fr.ts_us, event_ts, dst_ip, 99 AS priority, 'ADAPTIVE:' || array_to_string(classes, ',') AS pattern, least(0.99, 1 - exp(-score))::DOUBLE AS conf, CASE WHEN len(classes) >= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS sev, ids, rows20 FROM fr JOIN ps ON ps.seq = fr.seq WHERE score >= 3)"""
q("cr3_adaptive", f"WITH RECURSIVE {ADAPT} SELECT seq, src_ip, pattern, round(conf, 4) AS confidence, sev AS severity FROM ad", lambda a: correlate.adaptive(a).selectExpr("seq", "src_ip", "pattern", "round(confidence, 4) AS confidence", "severity"))
ALL_GAPS = f"WITH RECURSIVE {EWMA} SELECT seq, round(m, 3) AS all_gap, n AS all_n FROM alerts a JOIN ew ON k = '*' AND ew.ts_us = a.ts_us"
q("cr4_all_gaps", ALL_GAPS, lambda a: correlate.rate_baseline(a).select("seq", F.round("all_gap", 3).alias("all_gap"), "all_n"))
# A thinner alert stream on which the adaptive layer fires: rare classes close together.
THIN = "alerts AS (SELECT * FROM alerts0 WHERE threat_class IN ('ddos', 'recon') OR seq % 40 < 5)"


def thin(a):
    return a.where("threat_class IN ('ddos', 'recon') OR seq % 40 < 5")


def thin_sql(body: str) -> str:
    """The twin's SQL over the thinned alerts."""
    return duck("WITH RECURSIVE " + THIN + ", " + body.replace("WITH RECURSIVE ", "", 1), "alerts").replace("alerts AS (SELECT event_id", "alerts0 AS (SELECT event_id", 1)


def q_thin(name, sql, f):
    Q[name] = lambda s, d: f(thin(view(s, d, "alerts")))
    O[name] = thin_sql(sql)


q_thin("cr3_adaptive_thin", f"WITH RECURSIVE {ADAPT} SELECT seq, src_ip, pattern, round(conf, 4) AS confidence, sev AS severity FROM ad", lambda a: correlate.adaptive(a).selectExpr("seq", "src_ip", "pattern", "round(confidence, 4) AS confidence", "severity"))
BOTH = "WITH RECURSIVE " + CANDIDATES + ", " + ADAPT + ", allc AS (SELECT * FROM cand UNION ALL SELECT seq, src_ip, ts_us, event_ts, dst_ip, priority, pattern, conf, sev, ids, rows20 FROM ad), " + fired_sql("allc")
INCIDENT = " SELECT seq, CASE WHEN priority = 99 THEN 'MULTI_VECTOR_ANOMALY' ELSE 'MULTI_VECTOR' END AS threat_class, sev AS severity, round(least(conf, 0.99), 2) AS confidence, len(rows20) AS n FROM fired"
assembled = lambda a: correlate.assemble(correlate.correlate(a)).selectExpr("seq", "threat_class", "severity", "confidence", "size(contributing) AS n")
q("cr6_assemble", BOTH + INCIDENT, assembled)
q_thin("cr6_assemble_thin", BOTH + INCIDENT, assembled)
q("ag9_pattern_counts", CAND + " SELECT p.pattern, count(f.seq) AS count FROM (SELECT pattern FROM pt UNION ALL SELECT 'ADAPTIVE') p LEFT JOIN fired f ON f.pattern = p.pattern GROUP BY 1", lambda a: R.pattern_counts(correlate.fire(a).select("pattern"), tuple(p[0] for p in correlate.PATTERNS)))
q("tk4_tk5_incident_steps", CAND + ", s AS (SELECT src_ip || ':' || seq AS incident_id, unnest(rows20) AS r, generate_subscripts(rows20, 1) - 1 AS step, rows20[1].ts_us AS t0 FROM fired) SELECT incident_id, step, r.threat_class, round(r.ts_us / 1e6 - t0 / 1e6, 3) AS \"offset\" FROM s",
  lambda a: R.incident_steps(correlate.fire(a).selectExpr("concat(src_ip, ':', seq) AS incident_id", "transform(contributing, r -> struct(r.ts_us / 1e6 AS event_ts, r.threat_class AS threat_class)) AS contributing")))
q("cr1_multi_vector", """WITH u AS (SELECT * FROM alerts UNION ALL SELECT seq + 1000000, ts_us, event_ts, 'MULTI_VECTOR', src_ip, dst_ip, dst_port, severity, confidence, flow_id, detector, evidence FROM alerts WHERE seq % 3 = 0) SELECT seq FROM u WHERE threat_class NOT LIKE 'MULTI_VECTOR%' AND src_ip <> ''""",
  lambda a: correlate.usable(a.unionByName(a.where("seq % 3 = 0").withColumns({"seq": F.col("seq") + 1000000, "threat_class": F.lit("MULTI_VECTOR")}))).select("seq"))
q("fn17_fn18_windows", "SELECT seq, round(1 - exp(-300 / (1 + seq % 50)), 6) AS p, least(900, greatest(60, 3 * (1 + seq % 400)))::DOUBLE AS w FROM alerts", lambda a: a.selectExpr("seq", f"round({x.poisson_p('300D', 'cast(1 + seq % 50 AS double)', '5')}, 6) AS p", f"{x.adaptive_window('cast(1 + seq % 400 AS double)')} AS w"))
