"""Queries through readers, writers and streams: the given tables are written
to the shared folder in a source's format, then read or streamed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.operators import correlate, dataset, detect, export, features, gates, ml, ranks, report
from flowdetect.plans.q_detect import F1, IAT, INT, JOINED, WN1, WN2, WN3, cool, joined
from flowdetect.plans.q_report import ALL_GAPS, BOTH, CAND, EW, INCIDENT, thin, thin_sql
from flowdetect.plans.views import duck, folder, stored, view
from flowdetect.sources import logs, tail
from flowdetect.streaming import stream

Q, O = {}, {}


def q(name, sql, f, *views):
    Q[name] = f
    if sql:
        O[name] = duck(sql, *views)


def FL(s, d):
    return view(s, d, "flows")


# ---- readers ----

LINE = """to_json(named_struct('ts', ts, 'uid', uid, 'id.orig_h', src_ip, 'id.resp_h', dst_ip, 'id.resp_p', cast(dst_port AS string), 'proto', proto, 'orig_bytes', cast(orig_bytes AS string)))"""


def log_lines(s, d) -> str:
    """A log in which every 50th line is cut off."""
    path = folder(s, "log")
    FL(s, d).selectExpr(f"if(event_id % 50 = 0, substr({LINE}, 1, 20), {LINE}) AS value").write.text(path)
    return path


q("src1_read_log", "SELECT uid, src_ip, dst_port::VARCHAR AS dst_port, orig_bytes::VARCHAR AS orig_bytes FROM flows WHERE event_id % 50 <> 0",
  lambda s, d: logs.read_log(s, log_lines(s, d)).selectExpr("uid", "`id.orig_h` AS src_ip", "`id.resp_p` AS dst_port", "orig_bytes"), "flows")
q("src2_malformed", "SELECT count(*) AS lines, count(*) FILTER (event_id % 50 = 0) AS malformed FROM flows", lambda s, d: logs.malformed(s, log_lines(s, d)), "flows")


def feature_csv(s, d):
    path, rows = folder(s, "features"), FL(s, d).select("uid", "orig_bytes", "duration", "proto")
    rows.write.csv(path, header=True)
    return logs.read_features(s, path, rows.schema)


q("src6_read_features", "SELECT uid, orig_bytes, duration, proto FROM flows", feature_csv, "flows")


def truth_csv(s, d):
    path = folder(s, "truth")
    FL(s, d).selectExpr("src_ip AS SrcAddr", "dst_ip AS DstAddr", "if(event_id % 7 = 0, '0x50', cast(dst_port AS string)) AS Dport", "if(event_id % 97 < 2, 'flow=From-Botnet-V1', 'flow=Background') AS Label").write.csv(path, header=True)
    return path


q("src7_truth_triples", "SELECT DISTINCT src_ip, dst_ip, dst_port FROM flows WHERE event_id % 97 < 2 AND event_id % 7 <> 0", lambda s, d: logs.read_truth_triples(s, truth_csv(s, d)), "flows")


def tuple_csv(s, d):
    path = folder(s, "tuples")
    short = "concat_ws(',', 'a', 'b', 'c', src_ip)"
    whole = "concat_ws(',', 'a', 'b', 'c', src_ip, if(event_id % 5 = 0, 'x', cast(event_id % 9 AS string)), 'e', dst_ip, cast(dst_port AS string))"
    FL(s, d).where("event_id % 11 = 0").selectExpr(f"if(event_id % 3 = 0, {short}, {whole}) AS value").write.text(path)
    return logs.read_truth_tuples(s, path)


TUPLES = "SELECT src_ip AS a, event_id % 9 AS ap, dst_ip AS b, dst_port AS bp FROM flows WHERE event_id % 11 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0"
q("src8_truth_tuples", f"SELECT a AS src_ip, ap AS src_port, b AS dst_ip, bp AS dst_port FROM ({TUPLES}) UNION SELECT b, bp, a, ap FROM ({TUPLES})", tuple_csv, "flows")


def intel_csv(s, d):
    path = folder(s, "intel")
    rows = FL(s, d).selectExpr("concat_ws(',', md5(uid), concat('fam', event_id % 3)) AS value")
    s.createDataFrame([("# hash,family",)], "value string").union(rows).write.text(path)
    return logs.read_intel_csv(s, path, "hash string, family string")


q("src9_intel_csv", "SELECT md5(uid) AS hash, 'fam' || (event_id % 3) AS family FROM flows", intel_csv, "flows")


def blacklist_json(s, d):
    """One JSON object, of the 97 fingerprints in use."""
    path = folder(s, "blacklist")
    one = view(s, d, "ssl").groupBy("ja3").agg(F.struct(F.concat(F.lit("fam"), F.min("event_id") % 3).alias("family"), F.lit("HIGH").alias("severity")).alias("v"))
    one.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("ja3", "v")))).alias("value")).coalesce(1).write.text(path)
    return logs.read_blacklist(s, path)


q("src10_blacklist", "SELECT ja3 AS hash, 'fam' || (min(event_id) % 3) AS family, 'HIGH' AS severity FROM ssl GROUP BY ja3", blacklist_json, "ssl")


def mark_files(s, d):
    """Session marks, an array of each capture's in a document of its own."""
    path = folder(s, "marks")
    arrays = view(s, d, "marks").groupBy(F.expr("event_id DIV 2000").alias("capture")).agg(F.to_json(F.sort_array(F.collect_list(F.expr("named_struct('ts', ts_us / 1e6, 'label', label)")))).alias("value"))
    arrays.repartition("capture").write.partitionBy("capture").text(path)
    return logs.read_marks(s, path)


q("src11_marks", "SELECT label, ts_us / 1e6 AS ts FROM marks", lambda s, d: mark_files(s, d).select("label", "ts"), "marks")


def manifests(s, d):
    """A manifest of each capture, a document of its own; every other capture
    has no marks file."""
    path = folder(s, "manifests")
    marks = view(s, d, "marks").withColumn("capture", F.expr("event_id DIV 2000"))
    body = F.expr("""to_json(named_struct('scenario_id', concat('cap', capture), 'session_id', min(label), 'split', if(capture % 4 = 0, 'train', 'test'),
        'victim_ips', array(concat('10.0.0.', capture % 250)), 'configuration', cast(count(*) AS string)))""")
    marks.groupBy("capture").agg(body.alias("value")).repartition("capture").write.partitionBy("capture").text(path)
    there = marks.where("capture % 2 = 0").select(F.expr("concat('sessions_cap', capture, '.json')").alias("file"))
    return logs.read_manifests(s, path, there)


q("src12_manifests", """SELECT 'cap' || (event_id // 2000) AS scenario_id, min(label) AS session_id, CASE WHEN event_id // 2000 % 4 = 0 THEN 'train' ELSE 'test' END AS split, '10.0.0.' || (event_id // 2000 % 250) AS victim, count(*)::VARCHAR AS configuration
FROM marks WHERE event_id // 2000 % 2 = 0 GROUP BY event_id // 2000""", lambda s, d: manifests(s, d).selectExpr("scenario_id", "session_id", "split", "victim_ips[0] AS victim", "configuration"), "marks")


def paired_files(s, d):
    """The sessions of all captures, paired in each one's own file."""
    read = mark_files(s, d).withColumn("ts_us", F.round(F.col("ts") * 1e6).cast("long"))
    return dataset.pair_marks(read, file="file", order="place").where("ok").drop("ok", "file")


q("src11_wn9_file_marks", "WITH m AS (SELECT *, event_id // 2000 AS capture, regexp_replace(label, '_(start|end)$', '') AS name FROM marks), p AS (SELECT *, lead(label) OVER w AS l, lead(ts_us) OVER w AS e FROM m WINDOW w AS (PARTITION BY capture, name ORDER BY ts_us)) SELECT name AS session_id, string_split(label, '_')[1] AS label, ts_us AS start_us, e AS end_us FROM p WHERE label = name || '_start' AND l = name || '_end'", paired_files, "marks")


def word_file(s, d):
    path = folder(s, "words")
    view(s, d, "documents").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("value")).distinct().write.text(path)
    return logs.read_words(s, path).distinct()


q("src13_read_words", "SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents) WHERE len(word) >= 3", word_file)


def metric_files(s, d):
    """A document for each detector, and one that cannot be read."""
    path = folder(s, "metrics")
    a = view(s, d, "alerts").groupBy("detector").agg(F.round(F.avg("confidence"), 4).alias("precision"), F.max("confidence").alias("recall"), F.lit(0.5).alias("f1"), F.lit(0.1).alias("fpr"))
    for name in ("det_0", "det_1", "det_2"):
        ml.save_metrics(a.where(F.col("detector") == name), f"{path}/{name}")
    s.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{path}/bad")
    return logs.read_metrics(s, f"{path}/*")


q("src14_snk8_metrics", "SELECT detector, round(avg(confidence), 4) AS precision, max(confidence) AS recall, 0.5::DOUBLE AS f1, 0.1::DOUBLE AS fpr FROM alerts GROUP BY 1", metric_files, "alerts")


def sequence_files(s, d):
    path = folder(s, "sequences")
    rows = dataset.sequence_rows(joined(s, d)).selectExpr("*", "event_id % 2 AS label", "'lab' AS provenance", "server_name AS grp")
    logs.write_sequences(rows, path)
    back = logs.read_sequences(s, path)
    return back.groupBy("grp", "label").agg(F.count("*").alias("n"), F.sum(F.expr("size(filter(seq_mask, m -> m > 0))")).alias("packets"))


q("src16_snk6_sequences", f"WITH {JOINED} SELECT server_name AS grp, event_id % 2 AS label, count(*) AS n, sum(least(12, len(sizes)))::BIGINT AS packets FROM j WHERE len(sizes) > 0 GROUP BY 1, 2", sequence_files, "ssl", "conn", "pktseq")

# ---- writers ----

FULL = "*, 'L' || threat_class AS threat_label, confidence > 0.5 AS calibrated, 'rule_based' AS detection_method, cast(seq % 7 AS int) AS src_port, 'T' || seq AS timestamp, 'H' || seq AS record_hash"
full = lambda s, d: view(s, d, "alerts").selectExpr(*[c.strip() for c in FULL.split(", ")])
FULL_SQL = f"SELECT {FULL} FROM alerts".replace("cast(seq % 7 AS int)", "(seq % 7)::INT")


def csv_file(s, d):
    path = folder(s, "csv")
    export.write_csv(full(s, d), path)
    return s.read.csv(path, header=True, escape='"').select(*export.CSV_COLUMNS)


q("snk4_csv", f"WITH f AS ({FULL_SQL}) SELECT timestamp, flow_id, threat_class, threat_label, severity, confidence::VARCHAR AS confidence, calibrated::VARCHAR AS calibrated, detection_method, src_ip, src_port::VARCHAR AS src_port, dst_ip, dst_port::VARCHAR AS dst_port, detector, seq::VARCHAR AS seq, record_hash FROM f", csv_file, "alerts")
V = r"replace(replace({}, '\', '\\'), '=', '\=')"


def cef_file(s, d):
    path = folder(s, "cef")
    export.write_cef(full(s, d), path)
    return s.read.text(path).withColumnRenamed("value", "line")


q("snk2_exp2_cef_whole", rf"""WITH f AS ({FULL_SQL}) SELECT concat_ws('|', 'CEF:0', 'FlowDetect', 'ThreatPipeline', '1.0', threat_class, threat_label, (CASE severity WHEN 'CRITICAL' THEN 9 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 5 END)::VARCHAR) || '|' || concat_ws(' ', 'src=' || src_ip, 'dst=' || dst_ip, 'dpt=' || dst_port::VARCHAR, 'rt=' || timestamp, 'cn1=' || round(confidence * 100)::INT::VARCHAR, 'cn1Label=confidencePercent', 'cs1=' || {V.format('evidence')}, 'cs1Label=evidence', 'cs2=' || flow_id, 'cs2Label=flowId') AS line FROM f""", cef_file, "alerts")


def stix_file(s, d):
    path = folder(s, "stix")
    export.write_stix(full(s, d), path)
    shape = "type string, id string, objects array<struct<type: string, spec_version: string, id: string, created: string, modified: string, valid_from: string, name: string, pattern: string, pattern_type: string, labels: array<string>, confidence: long, x_flow_id: string, x_detector: string, x_severity: string, x_calibrated: boolean, x_event_ts: double, x_evidence: string>>"
    d = s.read.text(path).select(F.from_json("value", shape).alias("b")).select("b.type", F.explode("b.objects").alias("o"))
    return d.selectExpr(
        "type AS bundle", "o.type", "o.spec_version", "o.id LIKE 'indicator--%' AND o.created = o.modified AND o.created = o.valid_from AS dated", "o.name", "o.pattern", "o.pattern_type", "o.labels[0] AS label", "o.labels[1] AS threat_class",
        "o.confidence", "o.x_flow_id", "o.x_detector", "o.x_severity", "o.x_calibrated", "o.x_event_ts", "o.x_evidence",
    )


q("snk3_exp1_stix_whole", f"""WITH f AS ({FULL_SQL}) SELECT 'bundle' AS bundle, 'indicator' AS type, '2.1' AS spec_version, true AS dated, threat_label AS name, concat_ws(' AND ', '[ipv4-addr:value = ''' || src_ip || ''']', '[ipv4-addr:value = ''' || dst_ip || ''']', '[network-traffic:dst_port = ' || dst_port || ']') AS pattern, 'stix' AS pattern_type,
CASE threat_class WHEN 'ddos' THEN 'denial-of-service' WHEN 'recon' THEN 'reconnaissance' WHEN 'c2' THEN 'command-and-control' WHEN 'exfil' THEN 'exfiltration' ELSE 'malicious-activity' END AS label, threat_class, round(confidence * 100)::BIGINT AS confidence, flow_id AS x_flow_id, detector AS x_detector, severity AS x_severity, calibrated AS x_calibrated, event_ts AS x_event_ts, evidence AS x_evidence FROM f""", stix_file, "alerts")


def split_files(s, d):
    path, rows = folder(s, "dataset"), FL(s, d).selectExpr("event_id", "event_id % 20 AS session_id")
    parts = dataset.split_unseen(rows, s.range(20).selectExpr("id AS session_id", "if(id % 5 = 0, 'unseen_test', 'train') AS split"))
    logs.write_dataset(*parts, path)
    return s.read.parquet(path).select("event_id", "session_id", "split")


q("snk5_dataset", "SELECT event_id, event_id % 20 AS session_id, CASE WHEN event_id % 20 % 5 = 0 THEN 'unseen_test' ELSE 'train' END AS split FROM flows", split_files, "flows")


def saved_model(s, d):
    """A model and its calibration rows, written, read and asked again."""
    from pyspark.ml import PipelineModel

    path, rows = folder(s, "model"), view(s, d, "scores")
    model = ml.train_logistic(rows, ["p", "q"])
    ml.save(model, path, rows.where("doc_id % 4 = 0").select("doc_id", "p", "y"))
    a, b = ml.score(model, rows, "a"), ml.score(PipelineModel.load(path), rows, "b")
    both = a.select("doc_id", "a").join(b.select("doc_id", "b"), "doc_id").join(s.read.parquet(f"{path}-calibration").select("doc_id", F.lit(True).alias("cal")), "doc_id", "left")
    return both.selectExpr("doc_id", "a = b AS same", "coalesce(cal, false) AS calibration")


q("snk7_saved_model", "SELECT doc_id, true AS same, doc_id % 4 = 0 AS calibration FROM scores", saved_model, "scores")

# ---- alerts ----

MULTI = "CASE seq % 5 WHEN 0 THEN 'MULTI_VECTOR' WHEN 1 THEN 'MULTI_VECTOR_ANOMALY' ELSE threat_class END"
q("prj13_incidents", "SELECT seq FROM alerts WHERE seq % 5 IN (0, 1)", lambda s, d: report.incidents(view(s, d, "alerts").withColumn("threat_class", F.expr(MULTI))).select("seq"), "alerts")
IMPORTANCE = {"duration": 0.5, "orig_bytes": 0.31256, "resp_bytes": 0.1}
q("fn20_contributions", "SELECT event_id, unnest(['duration', 'orig_bytes', 'resp_bytes']) AS feature, unnest([duration, orig_bytes::DOUBLE, resp_bytes::DOUBLE]) AS value, unnest([0.5::DOUBLE, 0.3126::DOUBLE, 0.1::DOUBLE]) AS importance, unnest([0, 1, 2]) AS place FROM flows",
  lambda s, d: ml.contributions(FL(s, d), ["resp_bytes", "orig_bytes", "duration"], IMPORTANCE).select("event_id", F.posexplode("feature_contributions").alias("place", "c")).select("event_id", "place", "c.*"), "flows")
SCANS = cool("(SELECT * FROM f WHERE unique_ports > 15 OR unique_hosts > 10)", ["src_ip"], 20, WN2)
q("fn21_scan_evidence", SCANS + """ SELECT uid AS flow_id, '["Unique destination ports: ' || unique_ports || '","Unique destination hosts: ' || unique_hosts || '"]' AS evidence_json FROM r""", lambda s, d: detect.scan_rule(FL(s, d)).select("flow_id", "evidence_json"), "flows")
q("dt15_alert_schema", SCANS + """ SELECT ts_us / 1e6 AS event_ts, uid AS flow_id, src_ip, NULL::INT AS src_port, dst_ip, dst_port, 'recon' AS threat_class, 'Reconnaissance' AS threat_label, CASE WHEN unique_ports <= 30 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
round(least(0.6 + least(unique_ports / 15.0 * 0.3, 0.35), 0.99)::DOUBLE, 2) AS confidence, false AS calibrated, 'recon_detector' AS detector, 60 AS window_seconds, 'rule_fallback_no_model' AS detection_method, true AS has_time, true AS no_contributions FROM r""",
  lambda s, d: detect.scan_rule(FL(s, d)).selectExpr(*(c for c in detect.ALERT if c not in ("timestamp", "evidence_json", "feature_contributions")), "timestamp LIKE '2%Z' AS has_time", "feature_contributions IS NULL AS no_contributions"), "flows")
BEACONS = "be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, event_id) AS rn FROM g WHERE observations >= 5 AND mean_interval BETWEEN 3 AND 600 AND cv <= 0.35) WHERE rn = 1)"
q("sm11_combine", SCANS + f", w3 AS (SELECT *, list(ts_us) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS t FROM flows), " + WN3[WN3.index("f AS (SELECT"):].replace("f AS (SELECT", "g AS (SELECT", 1).replace("FROM w)", "FROM w3)") + f", {BEACONS}, al AS (SELECT ts_us / 1e6 AS event_ts, uid, 0 AS detector_rank, 'recon' AS threat_class FROM r UNION ALL SELECT ts_us / 1e6, uid, 1, 'c2' FROM be) SELECT event_ts, uid AS flow_id, detector_rank, threat_class, row_number() OVER (ORDER BY event_ts, uid, detector_rank) AS turn FROM al",
  lambda s, d: ranks.numbered(correlate.combine(detect.scan_rule(FL(s, d)), detect.beacon_rule(FL(s, d))).select("event_ts", "flow_id", "detector_rank", "threat_class"), ["event_ts", "flow_id", "detector_rank"]).selectExpr("event_ts", "flow_id", "detector_rank", "threat_class", "cast(_i + 1 AS int) AS turn"), "flows")
CV_OF = "CASE WHEN list_avg({0}) > 0 THEN round(list_aggregate({0}, 'stddev_pop') / list_avg({0}), 4) ELSE 'Infinity'::DOUBLE END".format("list_transform(range(1, len(t)), lambda i: (t[i + 1] - t[i]) / 1e6)")
GAPS_OF = "list_transform(range(1, len(t)), lambda i: (t[i + 1] - t[i]) / 1e6)"


def truth_rows(s, d, step):
    truth = FL(s, d).where("event_id % 197 = 0").select("src_ip", "dst_ip", "dst_port").distinct()
    return dataset.beacon_truth_rows(FL(s, d), truth, "s1", step)


q("ds4_beacon_truth_rows", f"""WITH tr AS (SELECT DISTINCT src_ip, dst_ip, dst_port FROM flows WHERE event_id % 197 = 0), n AS (SELECT 'c2_real_s1_' || src_ip || '_' || dst_ip || '_' || dst_port AS session_id, ts_us FROM flows WHERE (src_ip, dst_ip, dst_port) IN (SELECT * FROM tr)),
se AS (SELECT session_id, min(ts_us) AS a, max(ts_us) AS b FROM n GROUP BY 1 HAVING count(*) >= 3), gr AS (SELECT session_id, unnest(range(a, b + 1, 30000000)) AS t_us FROM se), sn AS (SELECT g.session_id, g.t_us, list(n.ts_us ORDER BY n.ts_us)[-20:] AS t FROM gr g JOIN n ON n.session_id = g.session_id AND n.ts_us <= g.t_us GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT session_id, t_us, 1 AS label, len(t) AS n, round(list_avg({GAPS_OF}), 4) AS mean_interval, round(list_aggregate({GAPS_OF}, 'stddev_pop'), 4) AS std_interval, {CV_OF} AS cv, 'periodic_beacon' AS attack_subtype, 'c2_real_s1' AS scenario_id FROM sn""",
  lambda s, d: truth_rows(s, d, 30_000_000).drop("source", "label_method"), "flows")
# at the reference's step: each event holds its channel's last twenty times, an instant takes those of the event before it
q("ds4_beacon_truth_rows_full_rate", f"""WITH tr AS (SELECT DISTINCT src_ip, dst_ip, dst_port FROM flows WHERE event_id % 197 = 0), n AS (SELECT 'c2_real_s1_' || src_ip || '_' || dst_ip || '_' || dst_port AS session_id, ts_us, event_id FROM flows WHERE (src_ip, dst_ip, dst_port) IN (SELECT * FROM tr)),
se AS (SELECT session_id, min(ts_us) AS a, max(ts_us) AS b FROM n GROUP BY 1 HAVING count(*) >= 3), gr AS (SELECT session_id, unnest(range(a, b + 1, 220000)) AS t_us FROM se), h AS (SELECT session_id, ts_us, list(ts_us) OVER (PARTITION BY session_id ORDER BY ts_us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS t FROM n),
k AS (SELECT session_id, ts_us, arg_max(t, (len(t), t)) AS t FROM h GROUP BY 1, 2), m AS (SELECT *, len(t) AS n, list_avg({GAPS_OF}) AS mean, list_aggregate({GAPS_OF}, 'stddev_pop') AS std FROM k)
SELECT gr.session_id, gr.t_us, 1 AS label, n, round(mean, 4) AS mean_interval, round(std, 4) AS std_interval, CASE WHEN mean > 0 THEN round(std / mean, 4) ELSE 'Infinity'::DOUBLE END AS cv, 'periodic_beacon' AS attack_subtype, 'c2_real_s1' AS scenario_id, 'real_public_dataset' AS source, 'dataset_ground_truth' AS label_method
FROM gr ASOF JOIN m ON gr.session_id = m.session_id AND gr.t_us >= m.ts_us WHERE n >= 3""", lambda s, d: truth_rows(s, d, 220_000), "flows")
q("ml11_evaluate_unseen", "SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 0 AND p <= 0.5) AS tn, count(*) FILTER (y = 1 AND p <= 0.5) AS fn FROM scores WHERE grp IN (SELECT DISTINCT grp FROM scores WHERE md5(grp) < '5')",
  lambda s, d: ml.evaluate_unseen(view(s, d, "scores"), view(s, d, "scores").where("md5(grp) < '5'").select("grp").distinct(), lambda r: r).select("tp", "fp", "tn", "fn"), "scores")

# ---- model paths on given scores: what follows a model is the same for any ----

P = "CAST((event_id * 37) % 100 AS DOUBLE) / 1e2"
A = ["flow_id", "src_ip", "dst_ip", "dst_port", "threat_class", "severity", "confidence", "calibrated", "detection_method"]


def with_p(d: DataFrame) -> DataFrame:
    return d.withColumn("p", F.expr(P))


def alert_sql(cls, severity, method, rows, confidence="p", calibrated="true"):
    return f" SELECT uid AS flow_id, src_ip, dst_ip, dst_port, '{cls}' AS threat_class, {severity} AS severity, round(least({confidence}, 0.99)::DOUBLE, 2) AS confidence, {calibrated} AS calibrated, {method} AS detection_method FROM {rows}"


FLOOD = """w AS (SELECT *, count(*) OVER (ORDER BY ts_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS packet_rate FROM flows)"""
q("dt1_flood_scored", cool(f"(SELECT *, {P} AS p FROM w WHERE {P} > 0.5)", ["src_ip"], 30, FLOOD) + alert_sql("ddos", "CASE WHEN packet_rate > 600 THEN 'CRITICAL' ELSE 'HIGH' END", "'ml'", "r"), lambda s, d: detect.flood_ml(with_p(features.flood_features(FL(s, d)))).select(A), "flows")
q("dt5_scan_scored", cool(f"(SELECT *, {P} AS p FROM f WHERE {P} > 0.5)", ["src_ip"], 20, WN2) + alert_sql("recon", "CASE WHEN unique_ports <= 30 THEN 'MEDIUM' ELSE 'HIGH' END", "'ml'", "r"), lambda s, d: detect.scan_ml(with_p(features.scan_features(FL(s, d)))).select(A), "flows")
INSIDE = "observations <= 20 AND mean_interval <= 45"
q("dt7_beacon_scored", f"WITH {WN3}, c AS (SELECT *, {P} AS p FROM f), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, event_id) AS rn FROM c WHERE observations >= 5 AND mean_interval BETWEEN 3 AND 600 AND CASE WHEN {INSIDE} THEN p > 0.5 ELSE cv <= 0.35 END) WHERE rn = 1)"
  + alert_sql("c2", "'HIGH'", f"CASE WHEN {INSIDE} THEN 'ml' ELSE 'rule_fallback_out_of_range' END", "r", f"CASE WHEN {INSIDE} THEN p ELSE 0.6 + least((0.35 - cv) / 0.35 * 0.35, 0.35) END", "false"), lambda s, d: detect.beacon_ml(with_p(features.beacon_features(FL(s, d)))).select(A), "flows")
PD = "CAST((doc_id * 37) % 100 AS DOUBLE) / 1e2"
WB = "CAST((doc_id * 53) % 100 AS DOUBLE) / 1e2"
DNS = r"""g AS (SELECT * REPLACE (regexp_replace(query, '[.]+$', '') AS query) FROM dns), h AS (SELECT *, len(query) AS ql, len(answers) AS al FROM g WHERE len(query) >= 10 AND qtype_name <> 'PTR' AND NOT (query LIKE '%.local' OR query LIKE '%.internal' OR query LIKE '%.arpa')),
k AS (SELECT * FROM h WHERE NOT (qtype_name IN ('TXT', 'NULL') AND ql > 50 AND greatest(al / greatest(ql, 1), ql / greatest(al, 1)) > 3))"""
q("dt9_dga_scored", cool(f"(SELECT *, doc_id AS event_id, {PD} AS p, {WB} AS wbs FROM k WHERE {PD} > 0.7)", ["src_ip", "query"], 300, DNS) + " SELECT uid AS flow_id, src_ip, 53 AS dst_port, CASE WHEN p > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, p AS confidence, 'ml' AS detection_method, CASE WHEN wbs > 0.65 THEN 'DICT_DGA' ELSE 'RANDOM_DGA' END AS detection_path FROM r",
  lambda s, d: detect.dga_ml(detect.dns_gate(view(s, d, "dns")).withColumns({"p": F.expr(PD), "word_boundary_score": F.expr(WB)}), detect.dns_tunnel_rows(view(s, d, "dns"))).select("flow_id", "src_ip", "dst_port", "severity", "confidence", "detection_method", F.get_json_object("evidence_json", "$.detection_path").alias("detection_path")), "dns")
EXFIL = f"""e AS (SELECT *, {P} AS p, orig_bytes / greatest(resp_bytes, 1) AS br FROM flows WHERE NOT ({INT.format('src_ip')} AND {INT.format('dst_ip')}) AND orig_bytes >= 1000),
x AS (SELECT *, CASE WHEN lower(proto) = 'icmp' AND orig_bytes > 1000 THEN 'ICMP_COVERT' WHEN dst_port = 53 AND orig_bytes > 5000 THEN 'DNS_EXFIL' WHEN br > 5.0 AND orig_bytes > 500000 THEN 'HIGH_UPLOAD' WHEN duration > 300 AND br > 2.0 THEN 'SUSTAINED_UPLOAD' END AS pattern FROM e)"""
q("dt10_exfil_scored", f"WITH {EXFIL}" + alert_sql("exfil", "CASE WHEN pattern = 'ICMP_COVERT' THEN 'CRITICAL' WHEN p > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END", "CASE WHEN pattern IS NULL THEN 'ml_only' ELSE 'ml_rule_confirmed' END", "x WHERE CASE WHEN pattern IS NULL THEN p >= 0.8 ELSE p >= 0.6 END", "CASE WHEN pattern IS NULL THEN p ELSE greatest(p, 0.7) END", "pattern IS NULL OR p >= 0.7"),
  lambda s, d: detect.exfil_ml(with_p(features.exfil_features(detect.exfil_gate(FL(s, d))))).select(A), "flows")
GATE = f"NOT {INT.format('dst_ip')} AND duration >= 0.1 AND orig_bytes + resp_bytes >= 100"
HIGH = "CASE WHEN p > 0.85 THEN 'HIGH' ELSE 'MEDIUM' END"
q("dt12_tls_scored", f"WITH {JOINED}, t AS (SELECT *, {P} AS p FROM j WHERE {GATE})" + alert_sql("tls", HIGH, "'flow_stats_ml'", "t WHERE p > 0.72"), lambda s, d: detect.tls_flow(with_p(detect.tls_gate(joined(s, d)))).select(A), "ssl", "conn", "pktseq")
P2 = "CAST((event_id * 71) % 100 AS DOUBLE) / 1e2"
q("dt13_tier2_scored", f"WITH {JOINED}, t0 AS (SELECT *, {P} AS p FROM j WHERE {GATE}), t AS (SELECT * REPLACE (coalesce(p2, p) AS p), p2 IS NOT NULL AS again FROM (SELECT *, CASE WHEN p BETWEEN 0.4 AND 0.7 AND len(sizes) > 0 THEN {P2} END AS p2 FROM t0))" + alert_sql("tls", HIGH, "CASE WHEN again THEN 'flow_stats_ml+tier2_seq' ELSE 'flow_stats_ml' END", "t WHERE CASE WHEN again THEN p >= 0.51 ELSE p > 0.72 END"),
  lambda s, d: detect.tls_tier2_alerts(detect.tls_tier2(with_p(detect.tls_gate(joined(s, d))), lambda r: r.withColumn("p2", F.expr(P2)))).select(A), "ssl", "conn", "pktseq")
def own_detector(s, d):
    """A detector of the user's own, added by name and run like the others."""

    @detect.register("bulk_udp")
    def bulk_udp(flows):
        rows = flows.where("proto = 'udp' AND orig_bytes > 1000")
        return detect.make_alert(rows, "exfil", "if(orig_bytes > 20000, 'HIGH', 'LOW')", "0.5D", "named_struct('bytes', orig_bytes)", 0, "custom")

    return detect.REGISTRY["bulk_udp"](FL(s, d)).select(A)


q("udf1_own_detector", alert_sql("exfil", "CASE WHEN orig_bytes > 20000 THEN 'HIGH' ELSE 'LOW' END", "'custom'", "flows WHERE proto = 'udp' AND orig_bytes > 1000", "0.5", "false"), own_detector, "flows")


# ---- streams ----


ROWS_A_FILE = 250_000  # one task writes a file


def arriving(s, rows: DataFrame, parts: int = 3, ts: str = "ts_us", ends: bool = False) -> DataFrame:
    """A stream of ``rows`` that arrive in order of time, in several batches of
    as many files each; with ``ends`` a last row far in the future lets every
    window close."""
    path = folder(s, "arriving")
    rows = stored(rows, "source")
    lo, hi = rows.agg(F.min(ts), F.max(ts)).first()
    ends_ = [lo + (hi - lo + 1) * k // parts for k in range(parts + 1)]
    within = [(F.col(ts) >= a) & (F.col(ts) < b) for a, b in zip(ends_, ends_[1:])]
    least = min(rows.agg(*(F.count_if(w) for w in within)).first())
    files = max(1, least // ROWS_A_FILE)  # no file of a batch is empty, so none is missing
    for w in within:  # one after the other: files are read in the order of their making
        part = rows.where(w)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    if ends:
        rows.limit(1).withColumns({ts: F.lit(hi + 10**12), "uid": F.lit("end")} if "uid" in rows.columns else {ts: F.lit(hi + 10**12)}).coalesce(1).write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def landed(s, d: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream leaves once all has arrived."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    s.conf.set(key, stream.ROCKSDB)
    out, marks = folder(s, "landed"), folder(s, "progress")
    try:
        w = d.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
        if mode == "append":
            w = w.format("parquet").outputMode("append").start(out)
        else:
            w = w.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).start()
        w.awaitTermination()
    finally:
        s.conf.set(key, before) if before else s.conf.unset(key)
    return s.read.schema(d.schema).parquet(out)


def tailed(s, d):
    """Log files tailed as they come, in two runs of one checkpoint."""
    path, out, marks = folder(s, "tailed"), folder(s, "landed"), folder(s, "progress")
    rows = FL(s, d).select("event_id", "uid", "orig_bytes")
    for part in (rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")):
        part.drop("event_id").write.mode("append").json(path)
        d_ = tail.tail_logs(s, path, "uid string, orig_bytes long")
        d_.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return s.read.schema("uid string, orig_bytes long").parquet(out)


q("src4_tailed_logs", "SELECT uid, orig_bytes FROM flows", tailed, "flows")
q("src4_file_stream", "SELECT uid, orig_bytes FROM flows", lambda s, d: landed(s, arriving(s, FL(s, d)).select("uid", "orig_bytes")), "flows")
q("src3_src5_topic_rows", "SELECT src_ip AS key, uid, ts FROM flows", lambda s, d: stream.decoded(stream.kafka_rows(FL(s, d).select("src_ip", "uid", "ts")).selectExpr("key AS topic", "value"), "ts double, uid string").withColumnRenamed("topic", "key"), "flows")
q("sm3_scan_state", "SELECT event_id, count(*) OVER w AS n, len(list_distinct(list(dst_port) OVER w)) AS \"distinct\" FROM flows WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, event_id RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)".replace("ORDER BY ts_us, event_id", "ORDER BY ts_us"), lambda s, d: landed(s, stream.scan_state(arriving(s, FL(s, d)))), "flows")
q("sm4_beacon_state", "SELECT event_id, count(*) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM flows", lambda s, d: landed(s, stream.beacon_state(arriving(s, FL(s, d)))).select("event_id", "n"), "flows")
q("sm4_beacon_intervals", f"WITH {WN3} SELECT event_id, observations AS n, mean_interval, std_interval, cv FROM f",
  lambda s, d: landed(s, stream.beacon_state(arriving(s, FL(s, d)))).selectExpr("event_id", "n", "round(mean_interval, 2) AS mean_interval", "round(std_interval, 2) AS std_interval", "round(cv, 4) AS cv"), "flows")
q("ag12_throughput_stream", "SELECT w, count(*) / 10.0::DOUBLE AS rate FROM (SELECT unnest(range(ts_us // 1000000 - 9, ts_us // 1000000 + 1)) AS w FROM flows) GROUP BY w",
  lambda s, d: landed(s, stream.throughput(arriving(s, FL(s, d), ends=True))).selectExpr("unix_seconds(window.start) AS w", "rate"), "flows")
q("sm5_flood_state", "WITH g AS (SELECT unnest(range(ts_us // 1000000 - 9, ts_us // 1000000 + 1)) AS w, dst_port, src_ip FROM flows) SELECT w, count(*) AS packet_rate, count(DISTINCT dst_port) AS unique_dst_ports, round(entropy(dst_port), 4) AS dst_port_entropy, count(DISTINCT src_ip) AS unique_src_ips, round(entropy(src_ip), 4) AS src_ip_entropy FROM g GROUP BY w",
  lambda s, d: landed(s, stream.flood_state(arriving(s, FL(s, d), ends=True))).where(f"window.start < timestamp_micros({(10**15) * 2})").selectExpr("unix_seconds(window.start) AS w", "packet_rate", "unique_dst_ports", "dst_port_entropy", "unique_src_ips", "src_ip_entropy"), "flows")
SLOW = "sl AS (SELECT *, count(*) OVER (PARTITION BY dst_ip, dst_port ORDER BY ts_us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS slow_count FROM flows WHERE proto IN ('tcp', 'udp') AND duration > 15 AND orig_bytes < 500)"
slow = lambda s, d: features.slow_conns(FL(s, d).where("proto IN ('tcp', 'udp')")).where("slow_count >= 25")
q("sm6_cooldown_state", cool("(SELECT * FROM sl WHERE slow_count >= 25)", ["dst_ip", "dst_port"], 30, SLOW) + " SELECT event_id FROM r", lambda s, d: landed(s, stream.cooldown(arriving(s, slow(s, d)), ["dst_ip", "dst_port"], 30)).select("event_id"), "flows")
q("sm7_once_state", f"WITH {SLOW} SELECT event_id FROM sl WHERE slow_count >= 25 QUALIFY row_number() OVER (PARTITION BY dst_ip ORDER BY ts_us, event_id) = 1", lambda s, d: landed(s, stream.once(arriving(s, slow(s, d)), ["dst_ip"])).select("event_id"), "flows")
q("jn3_sm2_enrich_stream", "SELECT s.uid, coalesce(c.orig_bytes, 0) AS orig_bytes, coalesce(c.duration, 0) AS duration FROM ssl s LEFT JOIN conn c ON s.uid = c.uid AND c.ts_us BETWEEN s.ts_us - 30000000 AND s.ts_us + 30000000",
  lambda s, d: landed(s, stream.enrich_stream(arriving(s, view(s, d, "ssl"), ends=True), arriving(s, view(s, d, "conn"), ends=True)).select("uid", "orig_bytes", "duration")).where("uid <> 'end'"), "ssl", "conn")
# The fields of each topic's records that the enrichment reads.
RECORDS = {"ssl": "uid string, ts_us long", "conn": "uid string, ts_us long, orig_bytes long, resp_bytes long, duration double", "pktseq": "uid string, ts_us long, sizes array<long>, gaps array<double>"}


def routed_stream(s, d):
    """Sessions, connections and packets as records of three topics in one
    stream, told apart again and joined."""
    records = None
    for topic, fields in RECORDS.items():
        rows = view(s, d, topic).select(*(f.split()[0] for f in fields.split(", ")))
        end = rows.orderBy(F.desc("ts_us")).limit(1).withColumns({"uid": F.lit("end"), "ts_us": F.col("ts_us") + 300_000_000})
        rows = rows.union(end).select(F.lit(topic).alias("topic"), F.to_json(F.struct("*")).alias("value"), "ts_us")
        records = rows if records is None else records.union(rows)
    by = stream.routed(arriving(s, records), RECORDS)
    joined_ = stream.enrich_stream(by["ssl"], by["conn"].drop("log_type"), by["pktseq"].drop("log_type"))
    return landed(s, joined_.select("uid", "log_type", "orig_bytes", "duration", "sizes")).where("uid <> 'end'").selectExpr("uid", "log_type", "orig_bytes", "duration", "CASE WHEN sizes IS NOT NULL THEN cast(size(sizes) AS bigint) END AS n_sizes")


q("src3_jn3_routed_topics", """SELECT s.uid, 'ssl' AS log_type, coalesce(c.orig_bytes, 0) AS orig_bytes, coalesce(c.duration, 0) AS duration, len(p.sizes) AS n_sizes FROM ssl s
LEFT JOIN conn c ON s.uid = c.uid AND c.ts_us BETWEEN s.ts_us - 30000000 AND s.ts_us + 30000000 LEFT JOIN pktseq p ON s.uid = p.uid AND p.ts_us BETWEEN s.ts_us - 30000000 AND s.ts_us + 30000000""", routed_stream, "ssl", "conn", "pktseq")
q("sm9_baseline_state", EW, lambda s, d: landed(s, stream.rate_baseline(arriving(s, view(s, d, "alerts")))).select("seq", F.round("class_gap", 3).alias("class_gap"), "class_n"), "alerts")


q("sm8_correlation_state", CAND + " SELECT seq, src_ip, pattern, conf AS confidence FROM fired", lambda s, d: landed(s, stream.correlated(arriving(s, view(s, d, "alerts")))), "alerts")


def correlated_stream(s, d, part, of=lambda a: a):
    """Both layers on a stream: what it leaves of ``part`` (incidents, baseline)."""
    out = folder(s, "correlated")
    stream.correlate_stream(arriving(s, of(view(s, d, "alerts")), 2), out, folder(s, "state"), folder(s, "progress"), baseline=part == "baseline").awaitTermination()
    return s.read.parquet(f"{out}/{part}/*")


INCIDENTS = ("seq", "threat_class", "severity", "confidence", "size(contributing) AS n")
Q["sm8_adaptive_stream"] = lambda s, d: correlate.assemble(correlated_stream(s, d, "incidents", thin)).selectExpr(*INCIDENTS)
O["sm8_adaptive_stream"] = thin_sql(BOTH + INCIDENT)
q("sm9_tempo_stream", ALL_GAPS, lambda s, d: correlated_stream(s, d, "baseline").select("seq", F.round("all_gap", 3).alias("all_gap"), "all_n"), "alerts")


def sink_and_feed(s, d):
    """Alerts through the sink, then as a feed from its folder."""
    path, marks = folder(s, "sink"), folder(s, "progress")
    a = view(s, d, "alerts")
    stream.alert_sink(arriving(s, a), path, marks, lambda b, out: export.write_cef(b, out), {"availableNow": True}).awaitTermination()
    lines = s.read.text(f"{path}/export/*").count()
    feed = stream.alert_feed(s, f"{path}/alerts/*", a.schema)
    return landed(s, feed.select("seq", "threat_class")).withColumn("lines", F.lit(lines))


q("snk1_sm1_sm10_sink_feed", "SELECT seq, threat_class, (SELECT count(*) FROM alerts) AS lines FROM alerts", sink_and_feed, "alerts")
q("sm12_stats_stream", "SELECT threat_class, count(*) AS count FROM alerts GROUP BY 1", lambda s, d: landed(s, stream.running_stats(arriving(s, view(s, d, "alerts"))), "complete"), "alerts")


def exact_stream(s, d):
    out = folder(s, "exact")
    stream.exact(arriving(s, FL(s, d)), features.scan_features, 60, out, folder(s, "carry"), folder(s, "progress")).awaitTermination()
    return s.read.parquet(out).select("event_id", "unique_ports", "unique_hosts", "connection_count", "port_entropy")


def exact_flood(s, d):
    out = folder(s, "exact")
    stream.exact(arriving(s, FL(s, d)), features.flood_features, 10, out, folder(s, "carry"), folder(s, "progress")).awaitTermination()
    return s.read.parquet(out).select(F1)


q("sm5_exact_flood", f"WITH {WN1.format(src='flows', iat=IAT)} SELECT {', '.join(F1)} FROM f", exact_flood, "flows")
q("sm5_exact_frames", f"WITH {WN2} SELECT event_id, unique_ports, unique_hosts, connection_count, port_entropy FROM f", exact_stream, "flows")
