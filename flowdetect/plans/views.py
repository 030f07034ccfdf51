"""Deterministic views over the driver tables that feed the registered queries.

Each view is one SELECT that Spark and DuckDB both read; ``{d}`` is integer
division and ``{us}`` the epoch micros of ``events.ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowdetect.sources.shared import folder, stored  # noqa: F401

VIEWS = {
    "flows": """SELECT event_id, 'C' || CAST(event_id AS STRING) AS uid, ts_us, ts_us / 1e6 AS ts,
  CASE WHEN event_id % 20 = 7 THEN '10.0.8.' || CAST((event_id {d} 400) % 50 + 1 AS STRING)
       WHEN event_type = 'error' AND (event_id {d} 500) % 2 = 0 THEN '10.0.9.1'
       ELSE '10.0.0.' || CAST(user_id % 20 + 1 AS STRING) END AS src_ip,
  CASE WHEN event_id % 20 = 7 THEN '203.0.113.200'
       WHEN event_type = 'view' AND (event_id {d} 1000) % 2 = 0 THEN '192.168.1.60'
       WHEN event_id % 3 = 0 THEN '203.0.113.' || CAST(event_id % 7 + 1 AS STRING)
       ELSE '192.168.1.' || CAST(event_id % 5 + 50 AS STRING) END AS dst_ip,
  CAST(CASE WHEN event_id % 20 = 7 THEN 443
       WHEN event_type = 'error' THEN (event_id * 7919) % 1024 + 1
       WHEN event_type = 'click' THEN 443 WHEN event_type = 'view' THEN 80
       WHEN event_type = 'purchase' THEN 8080 ELSE 53 END AS INT) AS dst_port,
  CASE WHEN event_type = 'signup' THEN 'udp'
       WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 'icmp' ELSE 'tcp' END AS proto,
  CASE WHEN event_type = 'view' AND (event_id {d} 1000) % 2 = 0 THEN event_id % 300
       ELSE CAST(floor(value * value * 100) AS BIGINT) END AS orig_bytes,
  (event_id * 131) % 20000 AS resp_bytes, event_id % 50 + 1 AS orig_pkts, event_id % 40 + 1 AS resp_pkts,
  CAST((event_id * 37) % 4000 AS DOUBLE) / 1e1 AS duration, 'SF' AS conn_state, 'conn' AS log_type
FROM (SELECT *, 1704067200000000 + event_id * 500000 + {us} % 400000 AS ts_us FROM events) e""",
    "dns": """SELECT doc_id, 'D' || CAST(doc_id AS STRING) AS uid, 1704067200000000 + doc_id * 2000000 AS ts_us, '10.0.0.' || CAST(doc_id % 9 + 1 AS STRING) AS src_ip,
  CASE doc_id % 4 WHEN 0 THEN md5(CAST(doc_id AS STRING)) || md5(CAST(doc_id + 1 AS STRING)) || '.t.example.com' WHEN 1 THEN 'www.example.com.'
    WHEN 2 THEN 'login-' || source || '.net' ELSE substr(md5(CAST(doc_id % 50 AS STRING)), 1, 16) || '.ru' END AS query,
  CASE doc_id % 5 WHEN 0 THEN 'TXT' WHEN 1 THEN 'NULL' WHEN 2 THEN 'PTR' ELSE 'A' END AS qtype_name,
  repeat('x', CAST(doc_id % 7 * 40 AS INT)) AS answers FROM documents""",
    "ssl": """SELECT event_id, uid, ts_us + (event_id % 45 - 5) * 1000000 AS ts_us, src_ip, dst_ip, dst_port, md5(CAST(event_id % 97 AS STRING)) AS ja3, '' AS ja4,
  'h' || CAST(event_id % 31 AS STRING) || '.example' AS server_name, CASE WHEN event_id % 5 = 0 THEN 'quic' ELSE 'ssl' END AS log_type FROM flows WHERE dst_port = 443""",
    "conn": "SELECT * FROM flows WHERE dst_port = 443 AND event_id % 9 <> 0",
    "pktseq": """SELECT event_id, uid, ts_us, {sizes} AS sizes, {gaps} AS gaps FROM flows WHERE dst_port = 443 AND event_id % 4 <> 0""",
    "alerts": """SELECT event_id AS seq, 1704067200000000 + event_id * 20000000 + {us} % 9000000 AS ts_us,
  (1704067200000000 + event_id * 20000000 + {us} % 9000000) / 1e6 AS event_ts,
  CASE (event_id * 7) % 6 WHEN 0 THEN 'ddos' WHEN 1 THEN 'recon' WHEN 2 THEN 'c2' WHEN 3 THEN 'dga' WHEN 4 THEN 'tls' ELSE 'exfil' END AS threat_class,
  '10.0.0.' || CAST(user_id % 20 + 1 AS STRING) AS src_ip, CASE WHEN event_id % 11 = 0 THEN NULL ELSE '203.0.113.' || CAST(event_id % 7 + 1 AS STRING) END AS dst_ip,
  CAST(CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 5 * 100 + 22 END AS INT) AS dst_port,
  CASE WHEN value > 60 THEN 'CRITICAL' WHEN value > 30 THEN 'HIGH' WHEN value > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  round(CAST(event_id * 37 % 100 AS DOUBLE) / 1e2, 2) AS confidence, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'A' || CAST(event_id - event_id % 50 {d} 49 AS STRING) END AS flow_id,
  'det_' || CAST(event_id % 3 AS STRING) AS detector, 'a=b|' || event_type AS evidence FROM events""",
    "marks": """SELECT event_id, ts_us, CASE WHEN (event_id {d} 200) % 2 = 0 THEN 'scan_' ELSE 'benign_' END || CAST(event_id {d} 200 AS STRING) || CASE WHEN event_id % 200 = 0 THEN '_start' ELSE '_end' END AS label
  FROM flows WHERE event_id % 200 = 0 OR event_id % 200 = 120""",
    "scores": """SELECT d.doc_id, l.toxic AS y, CAST((d.n_chars * 37) % 100 AS DOUBLE) / 1e2 AS p, CAST((d.n_chars * 53) % 100 AS DOUBLE) / 1e2 AS q, d.source AS grp, d.lang AS provenance
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}

_SPARK = {
    "d": "DIV", "us": "unix_micros(CAST(ts AS TIMESTAMP))",
    "sizes": "transform(slice(sequence(1, 15), 1, CAST(event_id % 15 AS INT)), i -> (event_id * 31 + i * 97) % 1460 + 40)",
    "gaps": "transform(slice(sequence(1, 15), 1, CAST(event_id % 15 AS INT)), i -> CAST((event_id * 17 + i * 53) % 3000 AS DOUBLE) / 1e3)",
}
_DUCK = {
    "d": "//", "us": "epoch_us(ts)",
    "sizes": "list_transform(range(1, event_id % 15 + 1), lambda i: (event_id * 31 + i * 97) % 1460 + 40)",
    "gaps": "list_transform(range(1, event_id % 15 + 1), lambda i: ((event_id * 17 + i * 53) % 3000)::DOUBLE / 1e3)",
}
_BASE = {"flows": ["events"], "dns": ["documents"], "ssl": ["flows"], "conn": ["flows"], "pktseq": ["flows"], "alerts": ["events"], "marks": ["flows"], "scores": ["labels", "documents"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_named(VIEWS[name].format(**_SPARK), _BASE[name]), **{b: view(spark, sf_dir, b) for b in _BASE[name]})


def _named(text: str, names: list[str]) -> str:
    for n in names:
        text = text.replace(f"FROM {n}", "FROM {" + n + "}").replace(f"JOIN {n}", "JOIN {" + n + "}")
    return text


def duck(text: str, *names: str) -> str:
    """``text`` with the views it needs in front."""
    need: list[str] = []

    def add(n: str) -> None:
        for b in _BASE.get(n, []):
            add(b)
        if n in VIEWS and n not in need:
            need.append(n)

    for n in names:
        add(n)
    heads = ", ".join(f"{n} AS ({VIEWS[n].format(**_DUCK)})" for n in need)
    recursive = "RECURSIVE " if text.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = text.lstrip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return f"WITH {recursive}{heads + ', ' if heads else ''}{body[len(lead):]}"
    return f"WITH {heads} {body}" if heads else body
