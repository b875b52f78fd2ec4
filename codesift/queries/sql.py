"""SQL counterparts of the matching operators, for the oracles."""

from __future__ import annotations

from collections.abc import Sequence

from codesift.detectors import COMMENT, DEFINITION, Pattern
from codesift.sources.corpus import files_sql, quoted


def rx(column: str, expression: str) -> str:
    return f"regexp_matches({column}, {quoted(expression)})"


def any_rx(column: str, expressions: Sequence[str]) -> str:
    return "(" + " OR ".join(rx(column, e) for e in expressions) + ")" if expressions else "false"


def match_sql(source: str, regex: str, prefix: str = "") -> str:
    """Rows of ``source`` (path, line_no, line, ...) for each match: col and hit."""
    wrapped = quoted(f"{prefix}([\\s\\S]*?)({regex})")
    return (
        f"SELECT *, 1 + list_sum(list_transform(gaps[1:k], lambda x: length(x)))::INT + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)::INT AS col, hits[k] AS hit "
        f"FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT *, regexp_extract_all(line, {wrapped}, 1) AS gaps, regexp_extract_all(line, {wrapped}, 2) AS hits FROM {source}))"
    )


def detect_sql(patterns: Sequence[Pattern]) -> str:
    """Common table expression ``found``: path, line_no, col, rule_id, severity, category, message, content, pattern_ord, hit."""
    parts = []
    for k, p in enumerate(patterns):
        tests = [rx("line", p.java)]
        tests += [rx("line", p.need_line)] if p.need_line else []
        tests += [f"NOT {any_rx('line', p.skip_line)}"] if p.skip_line else []
        tests += [f"NOT {any_rx('path', p.skip_path)}"] if p.skip_path else []
        tests += [f"NOT {any_rx('content', p.skip_file)}"] if p.skip_file else []
        source = f"(SELECT * FROM plain WHERE {' AND '.join(tests)})"
        values = ", ".join(f"{quoted(v)} AS {n}" for n, v in (("rule_id", p.rule), ("severity", p.severity), ("confidence", p.confidence), ("category", p.category), ("message", p.message)))
        hits = f" WHERE NOT {any_rx('hit', p.skip_hit)}" if p.skip_hit else ""
        parts.append(f"SELECT path, line_no, col, {k} AS pattern_ord, {values}, content, line, hit FROM ({match_sql(source, p.regex, '' if p.case else '(?i)')}){hits}")
    plain = f"plain AS (SELECT * FROM lines WHERE length(content) >= 10 AND NOT {rx('line', COMMENT)} AND NOT {any_rx('line', DEFINITION)})"
    return f"{files_sql()}, {plain}, found AS ({' UNION ALL '.join(parts)})"
