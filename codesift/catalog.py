"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from codesift.queries import deps, detect, files, findings, many, quality, scan

FLAGSHIP = "summary_findings"
MODULES = (detect, files, findings, quality, deps, scan, many)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
