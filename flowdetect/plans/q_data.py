"""Queries over captures, datasets and model evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowdetect.operators import dataset, detect, features, ml, normalize
from flowdetect.plans.q_detect import F3, GAPS, INT, JOINED, WN3, blacklist, joined
from flowdetect.plans.views import duck, stored, view

Q, O = {}, {}


def q(name, sql, f, *views):
    Q[name] = f
    if sql:
        O[name] = duck(sql, *views)


FL = lambda s, d: view(s, d, "flows")
SE = lambda s, d: dataset.pair_marks(view(s, d, "marks")).where("ok")
SC = lambda s, d: view(s, d, "scores").withColumn("pred", F.expr("cast(p > 0.5 AS int)"))
MARKS = "pm AS (SELECT *, row_number() OVER w AS n, lead(ts_us) OVER w AS e, lead(label) OVER w AS l FROM marks WINDOW w AS (ORDER BY ts_us)), se AS (SELECT replace(label, '_start', '') AS session_id, string_split(label, '_')[1] AS label, ts_us AS start_us, e AS end_us FROM pm WHERE n % 2 = 1 AND l = replace(label, '_start', '_end'))"
q("wn9_pair_marks", f"WITH {MARKS} SELECT * FROM se", lambda s, d: SE(s, d).drop("ok"), "marks")
q("wn8_clamp_windows", f"WITH {MARKS} SELECT session_id, least(end_us + 65000000, coalesce(lead(start_us) OVER (ORDER BY start_us), end_us + 65000000)) AS end_us FROM se", lambda s, d: dataset.clamp_windows(SE(s, d)).select("session_id", "end_us"), "marks")
q("jn6_interval_join", f"WITH {MARKS} SELECT f.event_id, se.session_id FROM flows f JOIN se ON f.ts_us BETWEEN start_us AND end_us", lambda s, d: dataset.interval_join(FL(s, d), SE(s, d)).select("event_id", "session_id"), "marks")
SNAP = f"{MARKS}, gr AS (SELECT *, unnest(range(start_us, end_us + 1, {{step}})) AS t_us FROM se), sn AS (SELECT g.session_id, g.label, g.t_us, list(f.dst_port) AS ports, list(f.dst_ip) AS ips, list(f.src_ip) AS srcs, list(f.ts_us ORDER BY f.ts_us) AS t FROM gr g JOIN flows f ON f.ts_us BETWEEN greatest(g.start_us, g.t_us - {{w}}) AND g.t_us AND f.ts_us <= g.end_us GROUP BY 1, 2, 3)"
IAT = f"round(coalesce(list_avg({GAPS}), 0), 4) AS mean_iat, round(coalesce(list_aggregate({GAPS}, 'stddev_pop'), 0), 4) AS std_iat"
q("ds1_flood_rows", "WITH " + SNAP.format(step=2_000_000, w=10_000_000) + f" SELECT session_id, label, t_us, len(t) AS packet_rate, len(list_distinct(ports)) AS unique_dst_ports, round(list_aggregate(ports, 'entropy'), 4) AS dst_port_entropy, {IAT}, len(list_distinct(srcs)) AS unique_src_ips, round(list_aggregate(srcs, 'entropy'), 4) AS src_ip_entropy FROM sn", lambda s, d: dataset.flood_rows(FL(s, d), SE(s, d), 2_000_000), "marks")
q("ds2_scan_rows", "WITH " + SNAP.format(step=5_000_000, w=60_000_000) + f" SELECT session_id, label, t_us, len(list_distinct(ports)) AS unique_ports, len(list_distinct(ips)) AS unique_hosts, len(t) AS connection_count, round(list_aggregate(ports, 'entropy'), 4) AS port_entropy, list_max(ports) - list_min(ports) AS port_range_span, {IAT} FROM sn", lambda s, d: dataset.scan_rows(FL(s, d), SE(s, d), 5_000_000), "marks")
q("ds3_wn7_beacon_rows", f"WITH {MARKS}, gr AS (SELECT *, unnest(range(start_us, end_us + 1, 5000000)) AS t_us FROM se), sn AS (SELECT g.session_id, g.label, g.t_us, list(f.ts_us ORDER BY f.ts_us)[-20:] AS t FROM gr g JOIN flows f ON f.ts_us BETWEEN g.start_us AND g.t_us GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT session_id, label, t_us, len(t) AS n, round(list_avg({GAPS}), 4) AS mean_interval, round(list_aggregate({GAPS}, 'stddev_pop'), 4) AS std_interval, CASE WHEN list_avg({GAPS}) > 0 THEN round(list_aggregate({GAPS}, 'stddev_pop') / list_avg({GAPS}), 4) ELSE 'Infinity'::DOUBLE END AS cv FROM sn",
  lambda s, d: dataset.beacon_rows(FL(s, d), SE(s, d), 5_000_000), "marks")
# The three at the reference's own steps; their twins follow at the end
SCENARIOS = {"scan_": ("recon_port_scan", "port_scan", "real"), "benign_": ("recon_benign_baseline", None, "real")}
full = lambda rows: dataset.provenance(rows, SCENARIOS, "loopback")
q("ds1_flood_rows_full_rate", None, lambda s, d: full(dataset.flood_rows(FL(s, d), SE(s, d))))
q("ds2_scan_rows_full_rate", None, lambda s, d: full(dataset.scan_rows(FL(s, d), SE(s, d))))
q("ds3_wn7_beacon_rows_full_rate", None, lambda s, d: full(dataset.beacon_rows(FL(s, d), SE(s, d), 220_000)))
q("ag1_group_channels", "SELECT src_ip, dst_ip, dst_port, count(*) AS n FROM flows GROUP BY ALL HAVING count(*) >= 3", lambda s, d: dataset.group_channels(FL(s, d)).selectExpr("src_ip", "dst_ip", "dst_port", "cast(size(times) AS bigint) AS n"), "flows")
TR = "SELECT DISTINCT src_ip, dst_ip, dst_port FROM flows WHERE event_id % 97 = 0"
q("jn8_label_by_triple", f"SELECT event_id FROM flows WHERE (src_ip, dst_ip, dst_port) IN ({TR})", lambda s, d: dataset.label_by_triple(FL(s, d), FL(s, d).where("event_id % 97 = 0").select("src_ip", "dst_ip", "dst_port").distinct()).select("event_id"), "flows")
TU = "SELECT src_ip AS a, 7 AS ap, dst_ip AS b, dst_port AS bp FROM flows WHERE event_id % 97 = 0"
q("jn9_label_by_tuple", f"SELECT event_id FROM flows WHERE (src_ip, 7, dst_ip, dst_port) IN (SELECT a, ap, b, bp FROM ({TU}) UNION SELECT b, bp, a, ap FROM ({TU}))",
  lambda s, d: (lambda f: dataset.label_by_tuple(f, (lambda t: t.union(t.select("dst_ip", "dst_port", "src_ip", "src_port")).distinct())(f.where("event_id % 97 = 0").select("src_ip", "src_port", "dst_ip", "dst_port"))).select("event_id"))(FL(s, d).withColumn("src_port", F.lit(7))), "flows")
q("jn10_label_by_domain", "SELECT uid FROM ssl WHERE server_name IN ('h3.example', 'h7.example')", lambda s, d: dataset.label_by_domain(view(s, d, "ssl"), s.sql("SELECT explode(array('h3.example', 'h7.example')) AS server_name")).select("uid"), "ssl")
q("jn11_benign_sequences", "SELECT p.uid, coalesce(s.server_name, 'unknown_' || substr(p.uid, 1, 6)) AS grp FROM pktseq p LEFT JOIN (SELECT * FROM ssl WHERE event_id % 3 <> 0) s ON p.uid = s.uid", lambda s, d: dataset.benign_sequences(view(s, d, "pktseq"), view(s, d, "ssl").where("log_type = 'ssl' AND event_id % 3 <> 0"), view(s, d, "ssl").where("log_type = 'quic' AND event_id % 3 <> 0")).select("uid", "grp"), "pktseq", "ssl")
q("ds5_wn10_exfil_rows", """WITH r AS (SELECT *, CASE WHEN dst_port = 8080 AND conn_state = 'SF' AND orig_bytes >= 500000 THEN 1 WHEN proto = 'icmp' AND orig_bytes >= 1000 THEN 1 WHEN proto = 'udp' AND dst_port = 53 AND orig_bytes >= 2000 THEN 1 WHEN orig_bytes > 0 AND orig_bytes < 10000 THEN 0 END AS label FROM flows)
SELECT event_id, label, 'local_' || label || '_' || (row_number() OVER (PARTITION BY label ORDER BY ts_us, uid) - 1) AS grp FROM r WHERE label IS NOT NULL""", lambda s, d: dataset.exfil_rows(FL(s, d), 8080).select("event_id", "label", "grp"), "flows")
q("ds6_tls_rows", f"WITH {JOINED} SELECT uid, round((orig_bytes + resp_bytes) / (CASE WHEN duration = 0 THEN 0.001 ELSE duration END), 4) AS bps, coalesce(nullif(server_name, ''), 'unknown_' || substr(uid, 1, 6)) AS grp FROM j WHERE duration >= 0.05 AND orig_bytes + resp_bytes >= 50", lambda s, d: dataset.tls_rows(joined(s, d)).selectExpr("uid", "total_bps AS bps", "grp"), "ssl", "conn", "pktseq")
q("ds7_sequence_rows", f"WITH {JOINED} SELECT uid, least(12, len(sizes)) AS n FROM j WHERE len(sizes) > 0", lambda s, d: dataset.sequence_rows(joined(s, d)).selectExpr("uid", "least(12, size(sizes)) AS n"), "ssl", "conn", "pktseq")
q("ds8_tag", f"WITH {MARKS} SELECT session_id, 'lab' AS source, 's1' AS scenario_id, CASE WHEN label = 'benign' THEN NULL ELSE label END AS attack_subtype, 'session_marks' AS label_method, 'loop' AS environment FROM se", lambda s, d: dataset.tag(SE(s, d), "lab", "s1", "loop").select("session_id", "source", "scenario_id", "attack_subtype", "label_method", "environment"), "marks")
q("ds9_empty_sessions", f"WITH {MARKS} SELECT session_id FROM se WHERE NOT EXISTS (FROM flows f WHERE f.dst_ip = '203.0.113.200' AND f.ts_us BETWEEN start_us AND start_us + 3000000)", lambda s, d: dataset.empty_sessions(SE(s, d), dataset.interval_join(FL(s, d).where("dst_ip = '203.0.113.200'"), SE(s, d).withColumn("end_us", F.expr("start_us + 3000000")))).select("session_id"), "marks")
q("ds10_window_validate", """WITH w AS (SELECT min(ts_us) AS lo, max(ts_us) + 65000000 AS hi FROM marks), f AS (SELECT *, ts_us BETWEEN lo AND hi AS inside FROM flows, w), i AS (SELECT * FROM f WHERE inside), ip AS (SELECT src_ip AS ip FROM i UNION SELECT dst_ip FROM i),
c AS (SELECT 'loopback' AS "check", count(*) FILTER (src_ip LIKE '127.%' OR dst_ip LIKE '127.%') AS n FROM i UNION ALL SELECT 'self', count(*) FILTER (src_ip = dst_ip) FROM i UNION ALL SELECT 'missing_fields', count(*) FILTER (src_ip IS NULL OR dst_ip IS NULL) FROM i UNION ALL SELECT 'malformed', 0 UNION ALL SELECT 'no_window', 0 UNION ALL SELECT 'empty', (count(*) = 0)::BIGINT FROM i UNION ALL SELECT 'outside_window', count(*) FROM f WHERE inside IS NOT TRUE UNION ALL SELECT 'absent_addresses', count(*) FROM (VALUES ('10.0.0.1'), ('9.9.9.9')) v(ip) WHERE v.ip NOT IN (SELECT ip FROM ip))
SELECT CASE WHEN n = 0 THEN 'PASS' WHEN "check" IN ('malformed', 'no_window') THEN 'WARN' WHEN "check" = 'outside_window' THEN 'INFO' ELSE 'FAIL' END AS level, "check", n FROM c""",
  lambda s, d: dataset.validate(FL(s, d), s.sql("SELECT explode(array('10.0.0.1', '9.9.9.9')) AS ip"), marks=view(s, d, "marks"), multihost=True), "marks", "flows")
q("ds10_jn14_validate", """WITH ip AS (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows), c AS (SELECT 'loopback' AS "check", count(*) FILTER (src_ip LIKE '127.%' OR dst_ip LIKE '127.%') AS n FROM flows UNION ALL SELECT 'self', count(*) FILTER (src_ip = dst_ip) FROM flows UNION ALL SELECT 'missing_fields', count(*) FILTER (src_ip IS NULL OR dst_ip IS NULL OR ts_us IS NULL) FROM flows UNION ALL SELECT 'malformed', 2 UNION ALL SELECT 'absent_addresses', count(*) FROM (VALUES ('10.0.0.1'), ('9.9.9.9')) v(ip) WHERE v.ip NOT IN (SELECT ip FROM ip))
SELECT CASE WHEN n = 0 THEN 'PASS' WHEN "check" IN ('missing_fields', 'absent_addresses') THEN 'FAIL' WHEN "check" = 'malformed' THEN 'WARN' ELSE 'INFO' END AS level, "check", n FROM c""", lambda s, d: dataset.validate(FL(s, d), s.sql("SELECT explode(array('10.0.0.1', '9.9.9.9')) AS ip"), 2), "flows")
q("ds12_ds13_domain_rows", "SELECT uid, len(query) AS n, round_even(len(query) / 5.0::DOUBLE, 0) * 5 AS length_bucket FROM dns", lambda s, d: dataset.domain_rows(view(s, d, "dns"), "query").select("uid", "n", "length_bucket"), "dns")
q("ds11_st1_extend", "SELECT label, count(*) AS n, count(DISTINCT session_id) AS sessions FROM (SELECT (event_id % 2)::VARCHAR AS label, event_id % 7 AS session_id FROM flows UNION ALL SELECT (event_id % 3)::VARCHAR, event_id % 5 FROM flows) GROUP BY 1", lambda s, d: dataset.extend(FL(s, d).selectExpr("cast(event_id % 2 AS string) AS label", "event_id % 7 AS session_id"), FL(s, d).selectExpr("cast(event_id % 3 AS string) AS label", "event_id % 5 AS session_id"))[1], "flows")
q("st3_observed", "SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows", lambda s, d: FL(s, d).select(F.col("src_ip").alias("ip")).union(FL(s, d).select("dst_ip")).distinct(), "flows")
q("st4_split_unseen", f"WITH {MARKS} SELECT session_id, (row_number() OVER (ORDER BY start_us) % 5 = 0) AS unseen FROM se", lambda s, d: (lambda r, m: dataset.split_unseen(r, m)[0].selectExpr("session_id", "false AS unseen").union(dataset.split_unseen(r, m)[1].selectExpr("session_id", "true AS unseen")))(SE(s, d), s.sql("SELECT session_id, if(row_number() OVER (ORDER BY start_us) % 5 = 0, 'unseen_test', 'train') AS split FROM {m}", m=SE(s, d))), "marks")
q("fn14_map_scenario", "SELECT event_id, CASE WHEN dst_ip LIKE '203.0.113.200%' THEN 's2' WHEN dst_ip LIKE '203.%' THEN 's1' END AS scenario_id FROM flows", lambda s, d: dataset.map_scenario(FL(s, d), "dst_ip", {"203.": ("s1", "x", "lab"), "203.0.113.200": ("s2", "y", "lab")}, strict=False).select("event_id", "scenario_id"), "flows")
q("tk7_systematic_sample", "WITH n AS (SELECT src_ip, event_id, row_number() OVER (PARTITION BY src_ip ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY src_ip) AS n FROM flows WHERE src_ip LIKE '10.0.0.%') SELECT n.src_ip, event_id FROM n JOIN range(10) k(k) ON i = k * n // 10", lambda s, d: dataset.systematic_sample(FL(s, d).where("src_ip LIKE '10.0.0.%'"), "src_ip", ["event_id"], 10).select("src_ip", "event_id"), "flows")
q("tk9_take_exact", "SELECT event_id FROM flows ORDER BY ts_us LIMIT 100", lambda s, d: dataset.take_exact(FL(s, d), ["ts_us"], 100).select("event_id"), "flows")
q("prj10_capture_filters", "SELECT event_id FROM flows WHERE dst_ip IN ('192.168.1.60', '203.0.113.1') AND dst_port BETWEEN 80 AND 443 AND src_ip = '10.0.0.3'", lambda s, d: dataset.filter_events(FL(s, d), dst_ips=["192.168.1.60", "203.0.113.1"], ports=(80, 443), src_ip="10.0.0.3").select("event_id"), "flows")
q("prj14_rebase_time", "SELECT event_id, ts_us + (1000000 - (SELECT min(ts_us) FROM flows)) AS ts_us FROM flows", lambda s, d: normalize.rebase_time(FL(s, d), 1_000_000).select("event_id", "ts_us"), "flows")
RAW = ["ts", "uid", "src_ip AS `id.orig_h`", "'0' AS `id.orig_p`", "dst_ip AS `id.resp_h`", "cast(dst_port AS string) AS `id.resp_p`", "proto", "conn_state", "if(event_id % 10 = 3, 'x', cast(orig_bytes AS string)) AS orig_bytes", "cast(resp_bytes AS string) AS resp_bytes", "cast(null AS string) AS orig_pkts", "cast(resp_pkts AS string) AS resp_pkts", "cast(duration AS string) AS duration",
       "if(event_id % 4 = 1, 'q.example', null) AS query", "cast(null AS string) AS qtype_name", "if(event_id % 4 = 2, 'aa', null) AS ja3", "cast(null AS string) AS ja4", "if(event_id % 8 = 3, 'h', null) AS server_name", "cast(null AS string) AS version", "if(event_id % 16 = 0, array(1L), null) AS sizes", "if(event_id % 16 = 0, array(1D), null) AS gaps"]
q("prj1_prj3_normalize", """SELECT uid, NULL::INT AS src_port, dst_port, orig_bytes, 0::BIGINT AS orig_pkts, CASE WHEN event_id % 16 = 0 THEN 'pktseq' WHEN event_id % 4 = 1 THEN 'dns' WHEN event_id % 4 = 2 THEN 'ssl' WHEN event_id % 8 = 3 THEN 'quic' ELSE 'conn' END AS log_type, CASE WHEN event_id % 4 = 1 AND event_id % 16 <> 0 THEN 'A' END AS qtype_name FROM flows WHERE event_id % 10 <> 3""",
  lambda s, d: normalize.normalize(FL(s, d).selectExpr(*RAW)).select("uid", "src_port", "dst_port", "orig_bytes", "orig_pkts", "log_type", "qtype_name"), "flows")
CM = "c AS (SELECT {by} count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 0 AND p <= 0.5) AS tn, count(*) FILTER (y = 1 AND p <= 0.5) AS fn FROM scores {g}), r AS (SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(fp / nullif(fp + tn, 0), 4) AS fpr, round(fn / nullif(fn + tp, 0), 4) AS fnr, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 4) AS accuracy FROM c)"
q("ag13_confusion", "WITH " + CM.format(by="", g="") + " SELECT *, round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1 FROM r", lambda s, d: ml.confusion(SC(s, d)), "scores")
q("ag14_pooled_confusion", "WITH " + CM.format(by="provenance,", g="GROUP BY provenance") + " SELECT provenance, tp, fp, tn, fn, precision, recall FROM r", lambda s, d: ml.confusion(SC(s, d), by=("provenance",)).select("provenance", "tp", "fp", "tn", "fn", "precision", "recall"), "scores")
q("ag15_recall_by", "SELECT provenance, round(avg((p > 0.5)::INT), 4) AS recall FROM scores WHERE y = 1 GROUP BY 1", lambda s, d: ml.recall_by(SC(s, d), "provenance"), "scores")
q("ag16_profile", "SELECT provenance AS label, count(*) AS n, count(DISTINCT grp) AS sessions FROM scores GROUP BY 1", lambda s, d: dataset.profile(SC(s, d).selectExpr("provenance AS label", "grp AS session_id")), "scores")
q("ag17_blind_spot", "SELECT y AS label, count(*) AS count FROM scores WHERE p > 0.7 GROUP BY 1", lambda s, d: ml.blind_spot(SC(s, d).withColumnRenamed("y", "label"), "p > 0.7"), "scores")
q("ag20_reliability", "SELECT least(9, floor(p * 10))::BIGINT AS bin, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM scores GROUP BY 1", lambda s, d: ml.reliability(SC(s, d)), "scores")
q("ag21_confidence_shift", "SELECT round(max(abs(p - q)), 6) AS shift, max(abs(p - q)) > 0.15 AS warn FROM scores", lambda s, d: ml.confidence_shift(SC(s, d), "p", "q"), "scores")
q("ag22_class_report", "WITH l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (y = label) AS support, count(*) FILTER ((p > 0.5)::INT = label) AS said, count(*) FILTER (y = label AND (p > 0.5)::INT = label) AS hit FROM l, scores GROUP BY label) SELECT label, support, round(hit / nullif(said, 0), 4) AS precision, round(hit / nullif(support, 0), 4) AS recall, round(2 * hit / nullif(said + support, 0), 4) AS f1 FROM c", lambda s, d: ml.class_report(SC(s, d)), "scores")
q("ml3_ml4_weights", "WITH n AS (SELECT y, count(*) AS c FROM scores GROUP BY y) SELECT doc_id, round((SELECT sum(c) FROM n) / ((SELECT count(*) FROM n) * c) * CASE WHEN provenance = 'de' THEN 10 ELSE 1 END, 6) AS w FROM scores JOIN n USING (y)", lambda s, d: ml.row_weight(ml.class_weight(SC(s, d)), "provenance", "de").select("doc_id", F.round("w", 6).alias("w")), "scores")
q("ml5_group_folds", "WITH g AS (SELECT grp, row_number() OVER (ORDER BY count(*) DESC, grp) - 1 AS i FROM scores GROUP BY grp) SELECT grp, CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS fold FROM g", lambda s, d: ml.group_folds(SC(s, d), "grp", 5).select("grp", "fold").distinct(), "scores")
q("ml9_select_threshold", "WITH t AS (SELECT unnest(range(1, 100)) AS t), d AS (SELECT t, count(*) FILTER (y = 1 AND round(p * 100) >= t) AS tp, count(*) FILTER (round(p * 100) >= t) AS said FROM t, scores GROUP BY t) SELECT coalesce(arg_max(t, (tp, -t)) FILTER (said > 0 AND tp >= 0.1 * said), 50) / 100 AS threshold FROM d", lambda s, d: ml.select_threshold(SC(s, d), 0.1), "scores")
q("ml12_rule_baseline", f"WITH {WN3} SELECT event_id, coalesce(observations >= 5 AND mean_interval BETWEEN 3 AND 600 AND cv <= 0.35, false)::INT AS pred FROM f", lambda s, d: ml.rule_baseline(features.beacon_features(FL(s, d)), "c2").select("event_id", "pred"), "flows")
q("ml5_packed_folds", """WITH RECURSIVE g AS (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, grp) AS i FROM scores GROUP BY grp),
r AS (SELECT 0::BIGINT AS i, [0, 0, 0]::BIGINT[] AS loads UNION ALL
SELECT r.i + 1, [CASE WHEN list_position(loads, list_min(loads)) = f THEN loads[f] + g.n ELSE loads[f] END FOR f IN [1, 2, 3]] FROM r JOIN g ON g.i = r.i + 1)
SELECT (f - 1)::BIGINT AS fold, loads[f] AS n FROM (SELECT loads FROM r ORDER BY i DESC LIMIT 1), (VALUES (1), (2), (3)) v(f) WHERE loads[f] > 0""",
  lambda s, d: ml.packed_folds(SC(s, d), "grp", 3).groupBy("fold").agg(F.count("*").alias("n")), "scores")
q("ml14_stratified_split", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM scores) SELECT doc_id, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r", lambda s, d: ml.stratified_split(SC(s, d), "y", "doc_id").select("doc_id", "split"), "scores")
q("ml6_ml7_group_split", "SELECT doc_id, CASE WHEN grp = 'src1' THEN 'fit' WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'cal' ELSE 'fit' END AS split FROM (SELECT doc_id, grp, ('0x' || substr(md5('42:' || grp), 1, 8))::BIGINT % 10000 / 10000 AS u FROM scores)", lambda s, d: ml.group_split(SC(s, d), "grp", pinned=("src1",)).select("doc_id", "split"), "scores")
FEAT = ["packet_rate", "unique_dst_ports", "dst_port_entropy", "mean_iat", "std_iat", "unique_src_ips", "src_ip_entropy"]


def forest(rows, f, trees=200, depth=6):
    """The reference's forest: 200 trees, balanced classes."""
    return ml.train_forest(ml.class_weight(rows), f, trees, depth, "w")


def flood_labelled(s, d):
    rows = features.entropy_baseline(features.flood_features(FL(s, d))).withColumn("y", F.expr("cast(src_ip = '10.0.9.1' AS int)"))
    return stored(rows, "flood")  # every step of a training passes over it


def dt1(s, d):
    rows = flood_labelled(s, d)
    return detect.flood_ml(ml.score(forest(rows, FEAT), ml.spread(rows))).drop("evidence_json")


def dt5(s, d):
    rows = stored(features.scan_features(FL(s, d)).withColumn("y", F.expr("cast(src_ip = '10.0.9.1' AS int)")), "scan")
    f = ["unique_ports", "unique_hosts", "connection_count", "port_entropy", "port_range_span", "mean_iat", "std_iat"]
    return detect.scan_ml(ml.score(forest(rows, f), ml.spread(rows))).drop("evidence_json")


def dt7(s, d):
    rows = stored(features.beacon_features(FL(s, d)).where("observations >= 5 AND cv < 1e6").withColumn("y", F.expr("cast(src_ip LIKE '10.0.8.%' AS int)")), "beacon")
    return detect.beacon_ml(ml.score(forest(rows, ["observations", "mean_interval", "std_interval", "cv"]), rows)).drop("evidence_json")


def dt9(s, d):
    dns = view(s, d, "dns")
    rows = stored(dataset.lexical_rows(detect.dns_gate(dns), "query", view(s, d, "documents")).withColumn("y", F.expr("cast(query LIKE '%.ru' AS int)")), "lexical")
    scored = ml.score(forest(rows, dataset.LEXICAL, depth=30), ml.spread(rows))
    return detect.dga_ml(scored, detect.dns_tunnel_rows(dns)).withColumn("detection_path", F.get_json_object("evidence_json", "$.detection_path")).drop("evidence_json")


def dt10(s, d):
    rows = features.exfil_features(detect.exfil_gate(FL(s, d))).withColumn("y", F.expr("cast(orig_bytes > 500000 AS int)"))
    f = ["orig_bytes", "resp_bytes", "byte_ratio", "duration", "orig_pkts", "resp_pkts", "bytes_per_sec", "is_icmp", "to_dns", "to_common_port"]
    return detect.exfil_ml(ml.score(forest(rows, f, 150, 10), rows)).drop("evidence_json")


def tls_scored(s, d):
    rows = stored(features.tls_features(detect.tls_gate(joined(s, d))).withColumn("y", F.expr("cast(event_id % 3 = 0 AS int)")), "tls")
    f = ["orig_bytes", "resp_bytes", "duration", "byte_ratio", "total_bytes", "total_bps", "size_mean", "size_std", "gap_mean", "gap_std", "n_pkts", "is_quic"]
    return rows, ml.score(forest(rows, f, 150, 8), rows)


def dt13(s, d):
    rows, scored = tls_scored(s, d)
    model = ml.train_sequence(features.pack_sequence(rows))
    return detect.tls_tier2(scored, lambda r: ml.score_sequence(model, features.pack_sequence(r))).select("uid", "p", "p2", "malicious")


q("dt1_flood_ml", None, dt1)
q("dt5_scan_ml", None, dt5)
q("dt7_beacon_ml", None, dt7)
q("dt9_dga_ml", None, dt9)
q("dt10_exfil_ml", None, dt10)
q("dt12_tls_flow", None, lambda s, d: detect.tls_flow(tls_scored(s, d)[1]).drop("evidence_json"))
q("dt13_ml13_tls_tier2", None, dt13)
q("ag19_importances", None, lambda s, d: ml.importances(forest(flood_labelled(s, d), FEAT), FEAT, s))


def ml2(s, d):
    """Ten folds by capture session, as the reference's comparison."""
    rows = dataset.flood_rows(FL(s, d), SE(s, d), 2_000_000).withColumn("y", F.expr("cast(label = 'scan' AS int)"))
    rows = stored(ml.packed_folds(rows, "session_id"), "sessions")
    k = rows.agg(F.max("fold") + 1).first()[0]  # fewer than ten sessions make fewer folds
    return ml.compare(rows, FEAT, "fold", k, {"rf": forest, "logistic": lambda r, f: ml.train_logistic(ml.class_weight(r), f, "w"), "gbt": lambda r, f: ml.train_gbt(ml.class_weight(r), f, weight="w")}, light=("logistic", "gbt"))


def ml8(s, d):
    """Calibrated on the groups set apart for it."""
    rows = ml.group_split(SC(s, d), "grp")
    return ml.calibrate(ml.platt(rows.where("split = 'cal'")), rows).select("doc_id", F.round("calibrated", 6).alias("calibrated"))


q("ml2_compare", None, ml2)
q("ml8_platt", None, ml8)


def given(column):
    """A trainer whose model is a score that the rows hold."""
    return lambda fit, f: lambda rows: rows.withColumn("p", F.col(column))


q("ml2_compare_scored", "WITH m AS (SELECT 'p' AS model, y, p > 0.5 AS hit FROM scores UNION ALL SELECT 'q', y, q > 0.5 FROM scores) SELECT model, count(*) FILTER (y = 1 AND hit) AS tp, count(*) FILTER (y = 0 AND hit) AS fp, count(*) FILTER (y = 0 AND NOT hit) AS tn, count(*) FILTER (y = 1 AND NOT hit) AS fn FROM m GROUP BY 1",
  lambda s, d: ml.compare(ml.hash_folds(SC(s, d), "grp", 5), [], "fold", 5, {"p": given("p"), "q": given("q")}).select("model", "tp", "fp", "tn", "fn"), "scores")
ORIGIN = "'real' AS source, CASE label WHEN 'scan' THEN 'recon_port_scan' ELSE 'recon_benign_baseline' END AS scenario_id, CASE label WHEN 'scan' THEN 'port_scan' END AS attack_subtype, 'generator_ground_truth' AS label_method, 'loopback' AS environment"
for name, sparse, step in (("ds1_flood_rows", 2_000_000, 140_000), ("ds2_scan_rows", 5_000_000, 150_000), ("ds3_wn7_beacon_rows", 5_000_000, 220_000)):
    O[f"{name}_full_rate"] = f"SELECT *, {ORIGIN} FROM (" + O[name].replace(f", {sparse})) AS t_us", f", {step})) AS t_us") + ")"
