"""SQL, ORM, command, LDAP and template injection.

A weakness is a place where text is run, a sink, and a form of argument that
mixes fixed text with a value.  Sinks and forms are listed apart; a rule names
the pairs that matter to it.
"""

from codesift.detectors import QUOTE, SQL, TEXT, USER, family

#: Forms of text with a value in it; {0} is what the text must begin with.
FORMS = {
    "joined": rf"{QUOTE}{{0}}{TEXT}{QUOTE}\s*\+",
    "interpolated": r"`{0}[^`]*\$\{{[^}}]+\}}",
    "formatted": r"[\"']{0}[^\"']*[\"']\s*(?:%|\.\s*format\b)",
    "f-string": r"f[\"']{0}[^\"']*\{{",
    "hash-brace": r"[\"']{0}[^\"']*#\{{",
    "dot-joined": r"[\"']{0}[^\"']*[\"']\s*\.\s*\$\w+",
}
#: What follows an opening parenthesis when the value comes from a request.
REQUEST = {"request": USER}

#: The calls of drivers, mappers, directories and template engines, and the attributes of a directory filter.
SQL_CALLS = ("query", "execute", "exec", "raw", "prepare", "where", "whereRaw", "havingRaw", "orderByRaw")
ORM_CALLS = (r"sequelize\.query", r"knex\.raw", r"(?:connection|conn|db|client|pool)\.query", r"cursor\.execute", r"DB\s*::\s*(?:select|statement|insert|update|delete|raw)")
SHELL_CALLS = ("exec", "execSync", "spawn", "spawnSync", r"os\.system", r"os\.popen", r"subprocess\.\w+")
CODE_CALLS = ("eval", r"new\s+Function", "spawn", "execSync")
LDAP_CALLS = (r"ldap\w*\.(?:search|bind|modify)",)
TEMPLATE_CALLS = ("render_template_string", "Template", "Jinja2?", "Environment", r"res\.render", r"(?:nunjucks|swig|pug|ejs|handlebars|mustache)\s*\.\s*(?:render|renderString|compile)", r"\)\s*\.from_string")


def calls(names: tuple[str, ...]) -> str:
    return "(?:" + "|".join(n if n.startswith(r"\)") else rf"\b{n}" for n in names) + r")\s*\(\s*"


def mixed(names: tuple[str, ...], start: str, what: str, *forms: str) -> list[tuple[str, str]]:
    """A pattern for each form of argument of the calls."""
    return [(calls(names) + FORMS[f].format(start), f"{what}: {f} text") for f in forms]


def requested(names: tuple[str, ...], what: str) -> tuple[str, str]:
    return calls(names) + USER, f"{what}: request data"


VERB = rf"\s*{SQL}\b"
#: Attributes of a directory entry.
ATTRIBUTES = ("uid", "cn", "sn", "mail", "memberOf", "objectClass")
FILTER = rf"\s*\([^\"'`]*\b(?:{'|'.join(ATTRIBUTES)})\s*="

INJECTION = family(
    "injection",
    ("SEC-INJ-001", "critical", "high", "sql-injection", "CWE-89", [
        *mixed(SQL_CALLS, VERB, "SQL call", "joined", "interpolated", "formatted"),
        (rf"\bwhere(?:Raw)?\s*\(\s*{FORMS['joined'].format('')}", "SQL condition: joined text"),
        (FORMS["f-string"].format(VERB), "SQL text: f-string"),
        (FORMS["formatted"].format(VERB), "SQL text: formatted text"),
        (FORMS["hash-brace"].format(VERB), "SQL text: hash-brace text"),
        (rf"{QUOTE}{SQL}\s[\w\s*,]+\b(?:FROM|INTO|SET|TABLE)\s+{QUOTE}\s*\+\s*\w+", "SQL text: joined table name"),
    ]),
    ("SEC-INJ-002", "critical", "medium", "sql-injection", "CWE-89", [
        *mixed(ORM_CALLS, "", "database library", "joined", "formatted"),
        *mixed((*ORM_CALLS[-1:], *SQL_CALLS[-3:]), VERB, "database library", "dot-joined"),
    ]),
    ("SEC-INJ-003", "critical", "high", "command-injection", "CWE-78", [
        *mixed(SHELL_CALLS, "", "command", "joined", "interpolated", "formatted", "f-string"),
        (rf"\bexec\s*\(\s*\w+\s*\+\s*{QUOTE}", "command: value and text"),
        (r"\bsubprocess\.\w+\s*\([^)]*\bshell\s*=\s*True", "command: through a shell"),
        (r"\bgetRuntime\s*\(\s*\)\s*\.\s*exec\s*\(\s*\w+", "command: a variable"),
        requested(CODE_CALLS, "code or command"),
    ]),
    ("SEC-INJ-004", "high", "medium", "ldap-injection", "CWE-90", [
        *mixed(LDAP_CALLS, "", "directory call", "joined"),
        (FORMS["joined"].format(FILTER), "directory filter: joined text"),
        (FORMS["interpolated"].format(FILTER), "directory filter: interpolated text"),
    ]),
    ("SEC-INJ-005", "critical", "high", "template-injection", "CWE-1336", [
        requested(TEMPLATE_CALLS, "template"),
    ]),
)
