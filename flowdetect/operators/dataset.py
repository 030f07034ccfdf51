"""Labelled datasets from captures: sessions, snapshots, labels, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowdetect.functions import expr as x
from flowdetect.operators import features, ranks, text
from flowdetect.sources.shared import stored

S = 1_000_000


def _following(d: DataFrame, order: str, columns: dict[str, str], width_us: int = 3600 * S) -> DataFrame:
    """Adds values of the next row in order (name: column), and ``_i``, the row's
    number. Rows meet by hours; across hours only each one's first row does."""
    d = d.withColumn("_b", F.expr(f"{order} DIV {width_us}"))
    w = Window.partitionBy("_b").orderBy(order)
    first = d.groupBy("_b").agg(F.count("*").alias("_k"), F.min_by(F.struct(*(F.col(c).alias(n) for n, c in columns.items())), order).alias("_f"))
    over = Window.orderBy("_b")
    first = first.select("_b", F.lead("_f").over(over).alias("_f"), F.coalesce(F.sum("_k").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_k"))
    d = d.withColumns({"_i": F.row_number().over(w), "_x": F.lead(F.struct(*(F.col(c).alias(n) for n, c in columns.items()))).over(w)}).join(first, "_b")
    d = d.withColumns({"_i": F.col("_i") + F.col("_k"), "_x": F.coalesce("_x", "_f")})
    return d.withColumns({n: F.col(f"_x.{n}") for n in columns}).drop("_b", "_k", "_f", "_x")


def pair_marks(marks: DataFrame, margin_us: int = 0, ts: str = "ts_us", file: str | None = None, order: str | None = None) -> DataFrame:
    """_start / _end marks to (session_id, label, start_us, end_us, ok), and
    ``file`` if given: a start is paired with the mark of its name that follows
    it in its file, in ``order`` (else by time). ``ok`` is false, and the end
    null, where that is no end; a lost mark costs its own session alone."""
    name = F.regexp_replace("label", "_(start|end)$", "")
    d = marks.withColumns({"_name": name, "_starts": F.col("label").endswith("_start")})
    w = Window.partitionBy(*([file] if file else []), "_name").orderBy(*([order] if order else [ts, F.desc("_starts")]))
    after = F.lead(F.when(F.col("label").endswith("_end"), F.col(ts))).over(w)
    d = d.withColumn("_e", after).where("_starts")
    kept = [F.col("_name").alias("session_id"), F.expr("split(label, '_')[0]").alias("label"), (F.col(ts) + margin_us).alias("start_us"), (F.col("_e") - margin_us).alias("end_us"), F.col("_e").isNotNull().alias("ok")]
    return d.select(*([file] if file else []), *kept)


def clamp_windows(w: DataFrame, flush_us: int = 65 * S) -> DataFrame:
    """Ends moved by the flush margin, but not past the next start."""
    d = _following(w, "start_us", {"_n": "start_us"})
    return d.withColumn("end_us", F.least(F.col("end_us") + flush_us, F.coalesce("_n", F.col("end_us") + flush_us))).drop("_n", "_i")


def filter_events(events: DataFrame, dst_ips: list[str] | DataFrame | None = None, ports: tuple[int, int] | None = None, src_ip: str | None = None) -> DataFrame:
    """Capture filters: destination in a set (a list, or a table ``dst_ip``),
    port in a range, source."""
    if isinstance(dst_ips, DataFrame):
        events = events.join(dst_ips.select("dst_ip"), "dst_ip", "left_semi")
    elif dst_ips is not None:
        events = events.where(F.col("dst_ip").isin(*dst_ips))
    if ports is not None:
        events = events.where(F.col("dst_port").between(*ports))
    return events if src_ip is None else events.where(F.col("src_ip") == src_ip)


def interval_join(events: DataFrame, sessions: DataFrame, width_us: int = 60 * S) -> DataFrame:
    """Events within sessions (start <= t <= end): both sides are dealt to time
    buckets, joined on the bucket, and the range is checked."""
    s = sessions.withColumn("_b", F.explode(F.expr(f"sequence(start_us DIV {width_us}, end_us DIV {width_us})")))
    e = events.withColumn("_b", F.expr(f"ts_us DIV {width_us}"))
    # both by bucket: of narrow events Spark would send the whole table to every executor
    return e.join(s.hint("merge"), "_b").where("ts_us BETWEEN start_us AND end_us").drop("_b")


def grid(sessions: DataFrame, step_us: int) -> DataFrame:
    return sessions.withColumn("t_us", F.explode(F.expr(f"sequence(start_us, end_us, {step_us}L)")))


def _snapshots(events: DataFrame, sessions: DataFrame, step_us: int) -> tuple[DataFrame, DataFrame]:
    """(a session's events, its grid instants), both by session_id and ts_us."""
    inside = interval_join(events, sessions.select("session_id", "start_us", "end_us")).select("session_id", "ts_us", "src_ip", "dst_ip", "dst_port")
    return inside, grid(sessions, step_us).select("session_id", "label", F.col("t_us").alias("ts_us")).distinct()


def flood_rows(events: DataFrame, sessions: DataFrame, step_us: int = 140_000, seconds: int = 10) -> DataFrame:
    """The seven flood features of a session's events in [max(start, t - W), t]
    at every grid instant that has any."""
    inside, points = _snapshots(events, sessions, step_us)
    return features.flood_features(inside, seconds, keys=("session_id",), points=points).withColumnRenamed("ts_us", "t_us")


def scan_rows(events: DataFrame, sessions: DataFrame, step_us: int = 150_000, seconds: int = 60) -> DataFrame:
    """The seven scan features, likewise."""
    inside, points = _snapshots(events, sessions, step_us)
    return features.scan_features(inside, seconds, keys=("session_id",), points=points).withColumnRenamed("ts_us", "t_us")


INSTANTS = 10_000  # instants that one row makes at a time


def history(inside: DataFrame, sessions: DataFrame, step_us: int, last: int = 20, least: int = 3) -> DataFrame:
    """Statistics of a session's ``last`` events (session_id, ts_us) at every grid
    instant that has ``least`` or more. They stand still between two events, so
    each event's are computed once and it makes the instants up to the next event
    itself: no grid is shuffled, sorted or joined, and a long silence is cut into
    runs of ``INSTANTS``."""
    own = Window.partitionBy("session_id").orderBy("ts_us")
    e = inside.withColumns({"h": F.collect_list("ts_us").over(own.rowsBetween(1 - last, 0)), "_next": F.lead("ts_us").over(own)})
    e = e.where((F.size("h") >= least) & F.expr("_next IS NULL OR _next > ts_us"))
    e = e.withColumn("_i", F.expr(x.interval_stats("h"))).selectExpr("session_id", "ts_us", "_next", "size(h) AS n", "round(_i.mean, 4) AS mean_interval", "round(_i.std, 4) AS std_interval", "if(_i.mean > 0, round(_i.std / _i.mean, 4), double('Infinity')) AS cv")
    e = e.join(sessions.select("session_id", "label", "start_us", "end_us").hint("merge"), "session_id").withColumn("_upto", F.expr("least(coalesce(_next - 1, end_us), end_us)")).where("_upto >= start_us")
    e = e.withColumns({"_lo": F.expr(f"greatest((ts_us - start_us + {step_us - 1}) DIV {step_us}, 0)"), "_hi": F.expr(f"(_upto - start_us) DIV {step_us}")}).where("_lo <= _hi")
    e = e.withColumn("_c", F.explode(F.expr(f"sequence(_lo DIV {INSTANTS}, _hi DIV {INSTANTS})")))
    # few bytes here, many rows after: by number, so that no task gets them all
    e = e.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session_id", "_c", "ts_us")
    k = F.explode(F.expr(f"sequence(greatest(_lo, _c * {INSTANTS}), least(_hi, _c * {INSTANTS} + {INSTANTS - 1}))"))
    return e.withColumn("_k", k).selectExpr("session_id", "label", f"start_us + _k * {step_us} AS t_us", "n", "mean_interval", "std_interval", "cv")


def snapshot_history(events: DataFrame, sessions: DataFrame, step_us: int, last: int = 20, least: int = 3) -> DataFrame:
    """The session's last events at every grid instant, three or more."""
    inside = interval_join(events, sessions).select("session_id", "ts_us")
    return history(inside, sessions, step_us, last, least)


beacon_rows = snapshot_history


def beacon_truth_rows(flows: DataFrame, truth: DataFrame, scenario: str, step_us: int = 220_000, last: int = 20, least: int = 3) -> DataFrame:
    """Beacon rows of channels that a public capture's ground truth names: a
    snapshot of the channel's last events at every step from its first event to
    its last."""
    named = label_by_triple(flows, truth).withColumn("session_id", F.concat_ws("_", F.lit(f"c2_real_{scenario}"), "src_ip", "dst_ip", "dst_port"))
    ends = named.groupBy("session_id").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("_n")).where(f"_n >= {least}")
    d = history(named.select("session_id", "ts_us"), ends.drop("_n").withColumn("label", F.lit(1)), step_us, last, least)
    fixed = {"source": "real_public_dataset", "scenario_id": f"c2_real_{scenario}", "attack_subtype": "periodic_beacon", "label_method": "dataset_ground_truth"}
    return d.withColumns({k: F.lit(v) for k, v in fixed.items()})


def group_channels(flows: DataFrame, least: int = 3) -> DataFrame:
    return flows.groupBy("src_ip", "dst_ip", "dst_port").agg(F.sort_array(F.collect_list("ts_us")).alias("times")).where(F.size("times") >= least)


def label_by_triple(flows: DataFrame, truth: DataFrame) -> DataFrame:
    return flows.join(truth, ["src_ip", "dst_ip", "dst_port"], "left_semi")


def label_by_tuple(flows: DataFrame, truth: DataFrame) -> DataFrame:
    """``truth`` holds both directions."""
    return flows.join(truth, ["src_ip", "src_port", "dst_ip", "dst_port"], "left_semi")


def label_by_domain(tls: DataFrame, domains: DataFrame) -> DataFrame:
    return tls.join(domains, "server_name", "left_semi")


def benign_sequences(pktseq: DataFrame, ssl: DataFrame, quic: DataFrame) -> DataFrame:
    d = pktseq.join(ssl.select("uid", F.col("server_name").alias("s1")), "uid", "left").join(quic.select("uid", F.col("server_name").alias("s2")), "uid", "left")
    return d.withColumn("grp", F.coalesce("s1", "s2", F.concat(F.lit("unknown_"), F.substring("uid", 1, 6)))).drop("s1", "s2")


def tls_rows(joined: DataFrame) -> DataFrame:
    d = features.tls_features(joined.where("duration >= 0.05 AND orig_bytes + resp_bytes >= 50"))
    return d.withColumn("grp", F.coalesce(F.nullif("server_name", F.lit("")), F.concat(F.lit("unknown_"), F.substring("uid", 1, 6))))


def sequence_rows(df: DataFrame) -> DataFrame:
    return features.pack_sequence(df).where("exists(seq_mask, m -> m > 0)")


def exfil_rows(flows: DataFrame, upload_port: int = 8199) -> DataFrame:
    shape = f"CASE WHEN dst_port = {upload_port} AND conn_state = 'SF' AND orig_bytes >= 500000 THEN 1 WHEN proto = 'icmp' AND orig_bytes >= 1000 THEN 1 WHEN proto = 'udp' AND dst_port = 53 AND orig_bytes >= 2000 THEN 1 WHEN orig_bytes > 0 AND orig_bytes < 10000 THEN 0 END"
    return row_groups(features.exfil_features(flows.withColumn("label", F.expr(shape)).where("label IS NOT NULL")), "label", "local")


def row_groups(df: DataFrame, category: str, prefix: str) -> DataFrame:
    """Adds grp: every row a group of its own, numbered within its category."""
    d = ranks.numbered(df, ["ts_us", "uid"], (category,), "_n")
    return d.withColumn("grp", F.concat(F.lit(f"{prefix}_"), F.col(category).cast("string"), F.lit("_"), F.col("_n").cast("string"))).drop("_n")


def map_scenario(df: DataFrame, column: str, mapping: dict[str, tuple[str, str | None, str]], strict: bool = True) -> DataFrame:
    """(scenario_id, attack_subtype, source) by the longest matching prefix; a
    row that none matches is an error or, unless ``strict``, gets nulls."""
    text = lambda v: "cast(NULL AS string)" if v is None else "'" + v.replace("'", "\\'") + "'"
    case = " ".join(f"WHEN startswith({column}, {text(p)}) THEN named_struct('scenario_id', {text(a)}, 'attack_subtype', {text(b)}, 'source', {text(c)})" for p, (a, b, c) in sorted(mapping.items(), key=lambda m: -len(m[0])))
    other = f"ELSE raise_error(concat('no scenario for ', coalesce({column}, 'null')))" if strict else ""
    return df.withColumn("_m", F.expr(f"CASE {case} {other} END")).select("*", "_m.*").drop("_m")


# Scenario, attack subtype and source by prefix of the session's id.
FLOOD_SCENARIOS = {
    "benign_udpspoof_": ("ddos_benign_udpspoof_baseline", None, "real"), "benign_http_": ("ddos_benign_http_baseline", None, "real"), "benign_": ("ddos_benign_baseline", None, "real"),
    "ddos_udpflood_": ("ddos_udp_flood", "udp_flood", "real"), "ddos_spoofed_": ("ddos_spoofed_source", "spoofed_source", "real"), "ddos_": ("ddos_syn_flood", "syn_flood", "real"),
}


def provenance(rows: DataFrame, mapping: dict[str, tuple[str, str | None, str]], environment: str, scenario: tuple[str, str] | None = None) -> DataFrame:
    """Adds source, scenario_id, attack_subtype, label_method and environment to
    feature rows of generated sessions, by the prefix of session_id; ``scenario``
    (id, subtype of its attacks) overrides the mapping."""
    if scenario is None:
        d = map_scenario(rows, "session_id", mapping)
    else:
        d = rows.withColumns({"scenario_id": F.lit(scenario[0]), "attack_subtype": F.when(~F.col("label").cast("string").isin("benign", "0"), F.lit(scenario[1])), "source": F.lit("real")})
    return d.withColumns({"label_method": F.lit("generator_ground_truth"), "environment": F.lit(environment)})


def tag(df: DataFrame, source: str, scenario: str, environment: str, method: str = "session_marks") -> DataFrame:
    return df.withColumns({"source": F.lit(source), "scenario_id": F.lit(scenario), "attack_subtype": F.expr("CASE WHEN label = 'benign' THEN NULL ELSE label END"), "label_method": F.lit(method), "environment": F.lit(environment)})


def empty_sessions(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    return sessions.join(rows.select("session_id"), "session_id", "left_anti")


def combine(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def split_unseen(rows: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    unseen = manifests.where("split = 'unseen_test'").select("session_id")
    return rows.join(unseen, "session_id", "left_anti"), rows.join(unseen, "session_id", "left_semi")


def profile(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


def extend(base: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = combine(base, more)
    return both, profile(both)


def systematic_sample(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n equally spaced rows per group; a group too small is an error."""
    d = ranks.numbered(df, order, (group,), "_i", "_n")
    d = d.where(F.expr(f"assert_true(_n >= {n}, concat('too few rows in ', {group})) IS NULL"))
    # row i is the k-th pick if i = k * _n DIV n, that is for the least k with k * _n >= i * n
    return d.where(f"((_i * {n} + _n - 1) DIV _n) * _n DIV {n} = _i AND (_i * {n} + _n - 1) DIV _n < {n}").drop("_i", "_n")


def take_exact(df: DataFrame, order: list[str], n: int) -> DataFrame:
    d = df.orderBy(*order).limit(n)
    short = d.agg(F.count("*").alias("_n")).select(F.expr(f"assert_true(_n >= {n}, 'too few rows') AS _ok"))
    return d.crossJoin(F.broadcast(short)).drop("_ok")


def domain_rows(df: DataFrame, query: str) -> DataFrame:
    return df.selectExpr("*", f"round({x.char_entropy(query)}, 4) AS entropy", f"round({x.consonant_ratio(query)}, 4) AS consonant_ratio", f"round({x.numeric_ratio(query)}, 4) AS numeric_ratio", f"length({query}) AS n", f"bround(length({query}) / 5D) * 5 AS length_bucket")


LABELS = 2_000
LEXICAL = ["entropy", "n", "label_n", "numeric_ratio", "consonant_ratio", "ngram_score", "word_boundary_score", "known_tld"]


def lexical_rows(df: DataFrame, query: str, corpus: DataFrame) -> DataFrame:
    """Adds the eight lexical features; the language model and the word list
    are those of ``corpus`` (text), which is passed over once. Ratios and the
    score are of the first label; labels, each of which makes hundreds of
    candidate words, are dealt by ``LABELS`` to a task."""
    d = df.withColumn("_first", F.split(F.col(query), r"\.")[0])
    labels = stored(d.selectExpr("_first", "_first AS _w").where("_first IS NOT NULL").distinct(), "labels")
    labels = labels.repartition(max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-labels.count() // LABELS)), "_first")
    runs = stored(text.letter_runs(corpus, "text"), "runs")
    scores = text.ngram_score(labels, "_first", "_w", text.trigram_model_of(runs))
    words = text.word_boundary_score(labels, "_first", "_w", runs.where("length(run) <= 10").selectExpr("run AS word"), 10)
    d = d.join(scores.join(words.withColumnRenamed("wbs", "word_boundary_score"), "_first"), "_first", "left")
    own = [f"{x.char_entropy(query)} AS entropy", f"length({query}) AS n", "length(_first) AS label_n", f"{x.numeric_ratio('_first')} AS numeric_ratio", f"{x.consonant_ratio('_first')} AS consonant_ratio", f"cast({x.tld_known(f'lower({query})')} AS int) AS known_tld"]
    return d.selectExpr("*", *own).drop("_first")


def capture_window(marks: DataFrame, flush_us: int = 65 * S, ts: str = "ts_us") -> DataFrame:
    """One row (_lo, _hi): from a capture's first mark to its last one and the
    flush margin; nulls without marks."""
    return marks.agg(F.min(ts).alias("_lo"), (F.max(ts) + flush_us).alias("_hi"))


# The level of a finding that is not zero.
LEVELS = {"missing_fields": "FAIL", "absent_addresses": "FAIL", "malformed": "WARN", "loopback": "INFO", "self": "INFO", "no_window": "WARN", "outside_window": "INFO", "empty": "FAIL"}


def validate(flows: DataFrame, manifest_ips: DataFrame, errors: int = 0, marks: DataFrame | None = None, flush_us: int = 65 * S, multihost: bool = False) -> DataFrame:
    """Findings (level, check, n) of the scenario quality gate. With ``marks``,
    flows outside the capture's own window are counted apart and no other check
    sees them, so scenarios that share addresses do not vouch for each other; no
    marks is a warning and all flows count, no flow within them a failure. On
    captures of several hosts, loopback and self connections are failures."""
    levels = LEVELS | ({"loopback": "FAIL", "self": "FAIL"} if multihost else {})
    checks = ["loopback", "self", "missing_fields", "malformed"]
    inside = F.lit(True)
    if marks is not None:
        flows = flows.crossJoin(F.broadcast(capture_window(marks, flush_us)))
        inside = F.expr("_lo IS NULL OR coalesce(ts_us BETWEEN _lo AND _hi, false)")
        window = [F.expr("cast(count(*) > 0 AND max(_lo) IS NULL AS bigint)").alias("no_window"), F.count_if(~inside).alias("outside_window"), (F.count_if(inside) == 0).cast("long").alias("empty")]
        checks += ["no_window", "outside_window", "empty"]
    within = lambda c: F.count_if(inside & F.expr(c))
    seen = flows.where(inside).select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    absent = manifest_ips.join(seen, "ip", "left_anti").agg(F.count("*").alias("n")).select(F.lit("absent_addresses").alias("check"), "n")
    own = [within("src_ip LIKE '127.%' OR dst_ip LIKE '127.%'").alias("loopback"), within("src_ip = dst_ip").alias("self"), within("src_ip IS NULL OR dst_ip IS NULL OR ts_us IS NULL").alias("missing_fields"), F.lit(errors).cast("long").alias("malformed")]
    d = flows.agg(*own, *(window if marks is not None else [])).unpivot([], checks, "check", "n").unionByName(absent)
    cases = " ".join(f"WHEN check = '{c}' THEN '{v}'" for c, v in levels.items())
    return d.select(F.expr(f"CASE WHEN n = 0 THEN 'PASS' {cases} END").alias("level"), "check", "n")
