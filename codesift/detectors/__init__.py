"""Detectors are data: each family lists patterns, and one operator interprets them all.

Expressions keep to what Java and RE2 share: no look-around, no back-references,
and no capturing groups, as the matcher wraps them in its own.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Words that name request-controlled data, and SQL verbs.
USER = r"(?:req|request|params|query|body|args|input|user)\b"
SQL = r"(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|UNION)"
QUOTE, TEXT = "[\"'`]", "[^\"'`]*"


@dataclass(frozen=True)
class Pattern:
    """One expression of a rule.  skip_*: not reported where one of them matches; need_line: only where it matches."""

    rule: str
    regex: str
    message: str
    severity: str
    confidence: str
    category: str
    subcategory: str
    cwe: str
    skip_line: tuple[str, ...] = ()
    skip_path: tuple[str, ...] = ()
    skip_file: tuple[str, ...] = ()
    need_line: str | None = None
    skip_hit: tuple[str, ...] = ()
    case: bool = False

    @property
    def java(self) -> str:
        return self.regex if self.case else f"(?i){self.regex}"


#: A line that is a comment, whatever the language.
COMMENT = r"^\s*(?://|#|\*|/\*)"
#: Lines that define rules rather than use what they name.
DEFINITION = (
    r"^\s*(?:regex|pattern|message|description)\s*[:=]\s",
    r"\bpattern\s*:\s*['\"].*(?:\$TAINTED|\$BUF|\$X)",
    r"\btype\s*:\s*'(?:code_injection|command_injection|sql_injection|xss|path_traversal|buffer_overflow|format_string|file_inclusion|deserialization|network)'",
    r"\bcwe\s*:\s*\[.*\bseverity\s*:\s*['\"]",
    r"\bseverity\s*:\s*['\"].*\bcwe\s*:\s*\[",
)


def family(category: str, *rows: tuple) -> tuple[Pattern, ...]:
    """rows: (rule, severity, confidence, subcategory, cwe, [(regex, message, options)...])."""
    out = []
    for rule, severity, confidence, subcategory, cwe, patterns in rows:
        for regex, message, *more in patterns:
            options = dict(more[0]) if more else {}
            values = {"severity": severity, "confidence": confidence, "subcategory": subcategory} | {k: options.pop(k) for k in ("severity", "confidence", "subcategory") if k in options}
            out.append(Pattern(rule, regex, message, values["severity"], values["confidence"], category, values["subcategory"], cwe, **options))
    return tuple(out)
