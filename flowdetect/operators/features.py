"""Trailing event-time features. A frame of W seconds at a row is [t - W, t];
rows of equal time are in each other's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowdetect.functions import expr as x
from flowdetect.operators.windows import frame_stats, last_rows, sliding_sums

S = 1_000_000


def flood_features(flows: DataFrame, seconds: int = 10, digits: int = 4, keys: tuple[str, ...] = (), points: DataFrame | None = None) -> DataFrame:
    """Adds packet_rate, unique_dst_ports, dst_port_entropy, mean_iat, std_iat,
    unique_src_ips and src_ip_entropy over all traffic (of equal ``keys``) of the
    last seconds; at ``points`` (keys, ts_us), if given, in place of the rows."""
    d = frame_stats(flows, list(keys), seconds * S, ["dst_port", "src_ip"], points=points)
    return d.selectExpr(
        *(flows if points is None else points).columns, "_n AS packet_rate", "_d_dst_port AS unique_dst_ports", f"round(_h_dst_port, {digits}) AS dst_port_entropy", f"round(_mean, {digits}) AS mean_iat",
        f"round(_std, {digits}) AS std_iat", "_d_src_ip AS unique_src_ips", f"round(_h_src_ip, {digits}) AS src_ip_entropy",
    )


def scan_features(flows: DataFrame, seconds: int = 60, digits: int = 4, keys: tuple[str, ...] = ("src_ip",), points: DataFrame | None = None) -> DataFrame:
    """Per source (or ``keys``): unique_ports, unique_hosts, connection_count,
    port_entropy, port_range_span, mean_iat and std_iat of the last seconds; at
    ``points`` (keys, ts_us), if given, in place of the rows."""
    d = frame_stats(flows.where("src_ip IS NOT NULL AND src_ip <> ''"), list(keys), seconds * S, ["dst_port", "dst_ip"], "dst_port", points=points)
    return d.selectExpr(
        *(flows if points is None else points).columns, "_d_dst_port AS unique_ports", "_d_dst_ip AS unique_hosts", "cast(_n AS int) AS connection_count", f"round(_h_dst_port, {digits}) AS port_entropy",
        "_span AS port_range_span", f"round(_mean, {digits}) AS mean_iat", f"round(_std, {digits}) AS std_iat",
    )


def beacon_features(flows: DataFrame, last: int = 20) -> DataFrame:
    """Per (source, destination, port), over the last rows: observations,
    mean_interval, std_interval and cv (infinite at mean 0)."""
    w = last_rows(last, "src_ip", "dst_ip", "dst_port")
    d = flows.withColumn("_t", F.collect_list("ts_us").over(w)).withColumn("_i", F.expr(x.interval_stats("_t")))
    cv = "CASE WHEN size(_t) < 2 THEN NULL WHEN _i.mean = 0 THEN double('Infinity') ELSE round(_i.std / _i.mean, 4) END"
    return d.selectExpr(*flows.columns, "size(_t) AS observations", "round(_i.mean, 2) AS mean_interval", "round(_i.std, 2) AS std_interval", f"{cv} AS cv", "_i.mean AS _mean")


def entropy_baseline(featured: DataFrame, seconds: int = 600, digits: int = 4) -> DataFrame:
    """Adds sigma and anomalous: the row's dst_port_entropy against the mean and
    sample deviation of the rows before it within the window. Entropies are
    whole numbers of 10 ** -digits, so their moments are exact sums and slide
    without cancelling."""
    d = featured.withColumn("_x", F.expr(f"cast(round(dst_port_entropy * 1e{digits}D) AS bigint)"))
    moments = {"_m0": F.lit(1).cast("long"), "_m1": F.col("_x"), "_m2": (F.col("_x") * F.col("_x")).cast("decimal(38,0)")}
    d = sliding_sums(d, [], seconds * S, moments).selectExpr("*", "_m0 - 1 AS _m", "_m1 - _x AS _s1", "_m2 - _x * _x AS _q1")
    spread = "cast(_m * _q1 - cast(_s1 AS decimal(19,0)) * _s1 AS double)"
    d = d.withColumn("_sd", F.expr(f"greatest(sqrt({spread} / nullif(cast(_m AS double) * (_m - 1), 0D)) / 1e{digits}D, 0.01D)"))
    far = f"abs(_x - _s1 / nullif(_m, 0)) / 1e{digits}D / _sd"
    sigma, odd = f"CASE WHEN _m < 10 THEN 0D ELSE round({far}, 3) END", f"CASE WHEN _m < 10 THEN dst_port_entropy < 1.5 ELSE {far} > 2 END"
    return d.selectExpr(*featured.columns, f"{sigma} AS sigma", f"{odd} AS anomalous")


def slow_conns(flows: DataFrame, seconds: int = 300, least: float = 15.0, most_bytes: int = 500) -> DataFrame:
    """Long, nearly silent connections with their number per target."""
    slow = flows.where((F.col("duration") > least) & (F.col("orig_bytes") < most_bytes))
    return sliding_sums(slow, ["dst_ip", "dst_port"], seconds * S, {"slow_count": F.lit(1).cast("long")})


def exfil_features(flows: DataFrame) -> DataFrame:
    dur = "coalesce(nullif(duration, 0D), 0.001D)"
    return flows.selectExpr(
        *flows.columns, "cast(orig_bytes AS double) / greatest(resp_bytes, 1) AS byte_ratio", f"orig_bytes / {dur} AS bytes_per_sec",
        "cast(lower(proto) = 'icmp' AS int) AS is_icmp", "cast(dst_port = 53 AS int) AS to_dns", "cast(dst_port IN (80, 443, 8080) AS int) AS to_common_port",
    )


EXFIL_PATTERN = """CASE WHEN is_icmp = 1 AND orig_bytes > 1000 THEN 'ICMP_COVERT' WHEN to_dns = 1 AND orig_bytes > 5000 THEN 'DNS_EXFIL'
 WHEN byte_ratio > 5.0 AND orig_bytes > 500000 THEN 'HIGH_UPLOAD' WHEN duration > 300 AND byte_ratio > 2.0 THEN 'SUSTAINED_UPLOAD' END"""


def tls_features(joined: DataFrame, digits: int = 4) -> DataFrame:
    """Twelve flow features of enriched TLS / QUIC sessions."""
    dur, total = "coalesce(nullif(duration, 0D), 0.001D)", "(orig_bytes + resp_bytes)"
    d = joined.withColumn("_z", F.expr("transform(sizes, v -> cast(v AS double))"))
    return d.selectExpr(
        *joined.columns, "orig_bytes / cast(greatest(resp_bytes, 1) AS double) AS byte_ratio", f"{total} AS total_bytes", f"round({total} / {dur}, {digits}) AS total_bps",
        f"round({x.mean_of('_z')}, {digits}) AS size_mean", f"round({x.std_of('_z')}, {digits}) AS size_std", f"round({x.mean_of('gaps')}, {digits}) AS gap_mean",
        f"round({x.std_of('gaps')}, {digits}) AS gap_std", "size(sizes) AS n_pkts", "cast(log_type = 'quic' AS int) AS is_quic",
    )


def pack_sequence(df: DataFrame, n: int = 12) -> DataFrame:
    """Adds seq_sizes, seq_gaps and seq_mask: fixed arrays of n values."""
    pad = f"slice(concat({{}}, array_repeat(0D, {n})), 1, {n})".format
    return df.withColumns({
        "seq_sizes": F.expr(pad(f"transform(slice(sizes, 1, {n}), v -> round(v / 1500D, 6))")),
        "seq_gaps": F.expr(pad(f"transform(slice(gaps, 1, {n}), g -> round(ln(1 + greatest(g, 0D)) / ln(3D), 6))")),
        "seq_mask": F.expr(pad(f"transform(slice(sizes, 1, {n}), v -> 1D)")),
    })
