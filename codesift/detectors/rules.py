"""The built-in rule set: rules as data, the shape that rule files have too."""

from codesift.detectors import QUOTE, SQL, USER
from codesift.detectors.secrets import DATABASE, GITHUB, PRIVATE_KEY, STRIPE

WEB = ("javascript", "typescript", "python", "java", "php", "ruby", "go")
JS = ("javascript", "typescript")
ANY = ("*",)


def rule(id_: str, severity: str, category: str, cwe: str, languages: tuple[str, ...], *patterns: tuple[str, str]) -> dict:
    return {"id": id_, "name": id_.split("/")[1].replace("-", " "), "severity": severity, "confidence": "high", "category": category, "cwe": [cwe], "languages": list(languages), "patterns": [{"regex": r, "message": m} for r, m in patterns], "enabled": True}


RULES = [
    rule("security/sql-injection", "critical", "injection", "CWE-89", WEB,
         (rf"\b(?:query|execute|exec)\s*\(\s*{QUOTE}\s*{SQL}\b.*\$\{{", "SQL template with an interpolated value"),
         (rf"\b(?:query|execute|exec)\s*\(\s*[\"']\s*{SQL}\b.*[\"']\s*\+", "SQL joined with a value"),
         (rf"\bf[\"']\s*{SQL}\b.*\{{", "SQL in an f-string"),
         (r"\.raw\s*\(\s*[\"'`$]", "raw SQL")),
    rule("security/command-injection", "critical", "injection", "CWE-78", WEB,
         (r"\b(?:exec|spawn)(?:Sync)?\s*\(\s*(?:[\"'`].*\$\{|[\"'].*\+)", "command built from parts"),
         (r"\bchild_process.*\b(?:exec|spawn)\s*\(", "child_process is used"),
         (r"\bos\.system\s*\(\s*(?:f[\"']|[\"'].*%|.*\+)", "os.system of built text"),
         (r"\bsubprocess\.(?:call|run|Popen)\s*\(\s*(?:f[\"']|.*[+%])", "subprocess of built text"),
         (r"\bRuntime\.getRuntime\(\)\.exec\s*\(", "Runtime.exec is used")),
    rule("security/code-injection", "critical", "injection", "CWE-94", ("javascript", "typescript", "python", "php", "ruby"),
         (r"\beval\s*\(\s*[^\"'`)\s]", "eval of a value"),
         (r"\bnew\s+Function\s*\(", "function built from text"),
         (r"\bset(?:Timeout|Interval)\s*\(\s*[\"'`]", "timer runs text")),
    rule("security/xss-innerhtml", "high", "xss", "CWE-79", JS,
         (r"\.(?:inner|outer)HTML\s*\+?=\s*[^=\s]", "HTML is set"),
         (r"\bdocument\.write(?:ln)?\s*\(", "document.write is used"),
         (r"\.insertAdjacentHTML\s*\(", "insertAdjacentHTML is used")),
    rule("security/xss-response", "high", "xss", "CWE-79", ("javascript", "typescript", "python", "php"),
         (rf"\bres\.(?:send|write|end)\s*\(.*\b{USER}", "response holds request data"),
         (r"\becho\s+\$_(?:GET|POST|REQUEST|COOKIE)\b", "echo of request data"),
         (r"\bmark_safe\s*\(", "mark_safe is used")),
    rule("security/hardcoded-secret", "critical", "secrets", "CWE-798", ANY,
         (r"\b(?:password|passwd|pwd|secret|api_?key|api_secret|access_key|access_token|auth_token|private_key)\s*[:=]\s*[\"'][^\"']{8,}[\"']", "secret is a literal"),
         (r"AKIA[0-9A-Z]{16}", "AWS access key"),
         (GITHUB, "GitHub token"),
         (STRIPE, "Stripe live key"),
         (PRIVATE_KEY, "private key"),
         (DATABASE, "database address with credentials")),
    rule("security/weak-auth", "high", "auth", "CWE-287", WEB,
         (r"\bpassword\s*={2,3}\s*[\"'][^\"']+[\"']", "password compared with a literal"),
         (rf"\bjwt\.(?:sign|verify)\s*\([^,]+,\s*{QUOTE}", "token secret is a literal"),
         (r"\bhttpOnly\s*:\s*false", "cookie without httpOnly"),
         (r"\bsecure\s*:\s*false", "cookie without secure"),
         (rf"\balgorithms?\s*[:=]\s*\[?\s*{QUOTE}none{QUOTE}", "algorithm none")),
    rule("security/weak-crypto", "high", "crypto", "CWE-327", ANY,
         (rf"\bcreateHash\s*\(\s*{QUOTE}(?:md5|sha1){QUOTE}", "weak hash"),
         (r"\bhashlib\.(?:md5|sha1)\b", "weak hash"),
         (r"\bMath\.random\s*\(", "Math.random"),
         (r"\bMessageDigest\.getInstance\s*\(\s*\"(?:MD5|SHA-?1)\"", "weak hash")),
    rule("security/path-traversal", "high", "file-ops", "CWE-22", ANY,
         (rf"\b(?:readFile|writeFile|unlink|sendFile)(?:Sync)?\s*\(.*\b{USER}", "file operation on request data"),
         (r"\.\./\.\./", "repeated parent folders"),
         (rf"\bpath\.(?:join|resolve)\s*\(.*\b{USER}", "path from request data")),
    rule("security/xxe", "critical", "api-security", "CWE-611", ("java", "python", "php"),
         (r"\bDocumentBuilderFactory\.newInstance\b", "XML factory with default settings"),
         (r"\betree\.(?:parse|fromstring)\s*\(", "etree parses external XML")),
    rule("security/ssrf", "critical", "api-security", "CWE-918", WEB,
         (rf"\b(?:axios(?:\.\w+)?|fetch)\s*\(\s*{USER}", "request to a caller's address"),
         (rf"\brequests\.\w+\s*\(\s*(?:{USER}|url\b)", "request to a caller's address")),
    rule("security/cors-wildcard", "high", "api-security", "CWE-942", WEB,
         (r"Access-Control-Allow-Origin[\"']?\s*[,:]\s*[\"']\*", "all origins by header"),
         (r"\borigin\s*:\s*[\"']\*[\"']", "all origins by option")),
    rule("security/csrf-disabled", "high", "api-security", "CWE-352", ("java", "python", "javascript"),
         (r"\bcsrf\s*\(\s*\)\s*\.disable\s*\(|@csrf_exempt", "CSRF is disabled")),
    rule("security/missing-rate-limit", "medium", "api-security", "CWE-307", JS,
         (r"\b(?:app|router)\.post\s*\(\s*[\"'][^\"']*/(?:login|signin|register|signup)[\"']\s*,\s*\w+\s*\)", "route without a limiter")),
    {**rule("quality/high-complexity", "medium", "complexity", "CWE-1121", ANY), "patterns": []},
    {**rule("quality/deep-nesting", "medium", "complexity", "CWE-1124", ANY), "patterns": []},
    {**rule("quality/long-function", "medium", "complexity", "CWE-1080", ANY), "patterns": []},
    {**rule("quality/long-file", "low", "code-smell", "CWE-1080", ANY), "patterns": []},
    {**rule("quality/magic-number", "low", "code-smell", "CWE-1106", ANY), "patterns": []},
    {**rule("quality/todo-comment", "low", "code-smell", "CWE-546", ANY), "patterns": []},
    {**rule("quality/empty-catch", "medium", "code-smell", "CWE-390", ANY), "patterns": []},
    {**rule("quality/console-log", "low", "code-smell", "CWE-489", JS), "patterns": []},
    {**rule("quality/code-duplication", "low", "duplication", "CWE-1041", ANY), "patterns": []},
    {**rule("quality/low-comment-ratio", "low", "metrics", "CWE-1116", ANY), "patterns": []},
]
