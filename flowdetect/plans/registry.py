"""Collects the registered queries and their DuckDB twins."""

from __future__ import annotations

from flowdetect.plans import q_data, q_detect, q_io, q_report

MODULES = (q_detect, q_report, q_data, q_io)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.O.items()}
