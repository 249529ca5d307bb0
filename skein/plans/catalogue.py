"""All queries of the core, gathered from the modules that define them."""

from __future__ import annotations

from skein.plans import graphs, ingest, records, reports

_MODULES = (records, graphs, reports, ingest)

FLAGSHIP = records.p3_found


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
