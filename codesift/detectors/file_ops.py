"""Path traversal, permissions, temporary files and uploads."""

from codesift.detectors import QUOTE, USER, family

OP = r"(?:readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream|unlink|appendFile)"
#: Imports, configuration files, and constants where paths start.
IMPORTS = (r"^\s*(?:import |export |from )|require\(|require |require_once |include |include_once ",)
CONFIGS = (r"\.config\.(?:js|ts)$|vite\.config|webpack\.|tailwind\.",)
BASE = r"__DIR__|__dirname|__filename|__FILE__|import\.meta\.url"
OUTSIDE = r"(?i)(?:req|request|params|query|body|args|input|user|GET|POST|REQUEST)\b"
SKIP = {"skip_line": IMPORTS, "skip_path": CONFIGS}

FILE_OPS = family(
    "file-ops",
    ("SEC-FILE-001", "high", "medium", "path-traversal", "CWE-22", [
        (rf"\b{OP}\s*\(\s*{USER}", "file operation on request data", SKIP | {"severity": "critical", "confidence": "high"}),
        (rf"\b{OP}\s*\(\s*(?:{QUOTE}[^\"'`]*{QUOTE}\s*\+|\w+\s*\+)", "file operation on a joined path", SKIP),
        (rf"\b{OP}\s*\(\s*`[^`]*\$\{{", "file operation on a path template", SKIP),
        (rf"\bpath\.(?:join|resolve)\s*\([^)]*\b{USER}", "path from request data", SKIP | {"severity": "medium"}),
        (r"\.\./", "parent folder in a path", SKIP | {"severity": "low", "confidence": "low", "need_line": r"(?i)(?:read|write|open|include|require|send|path|fs|file)\b"}),
        (rf"\bopen\s*\(\s*{USER}", "open() of request data", SKIP),
        (r"\bres\.sendFile\s*\(\s*req\b", "sendFile of request data", SKIP | {"severity": "critical", "confidence": "high"}),
        (r"\b(?:include|require)(?:_once)?\s*\(?\s*\$_(?:GET|POST|REQUEST|COOKIE)\b", "include of request data", {"severity": "critical", "confidence": "high"}),
        (r"\b(?:os|ioutil)\.(?:ReadFile|Open|OpenFile)\s*\(\s*[A-Za-z_]\w*", "file opened by a variable", SKIP),
        (r"\b(?:filepath\.Join|os\.path\.join)\s*\([^)]*,\s*[A-Za-z_]\w*", "path joined with a variable", SKIP | {"severity": "medium"}),
    ]),
    ("SEC-FILE-002", "high", "high", "permissions", "CWE-732", [
        (r"\bchmod\w*\s*\([^)]*0?o?777\b", "mode 777", SKIP),
        (r"\bchmod\w*\s*\([^)]*0?o?666\b", "mode 666", SKIP | {"severity": "medium"}),
        (r"\bwriteFile(?:Sync)?\s*\([^)]*mode\s*:\s*0?o?(?:777|666)\b", "file written with an open mode", SKIP),
        (r"\bumask\s*\(\s*0+\s*\)", "umask 0", SKIP),
    ]),
    ("SEC-FILE-003", "medium", "medium", "temp-file", "CWE-377", [
        (r"\b(?:tmpnam|mktemp)\s*\(|\bos\.tmpnam\b", "predictable temporary name", SKIP),
        (r"\bNamedTemporaryFile\s*\([^)]*delete\s*=\s*False", "temporary file stays", SKIP),
        (rf"\bwriteFile(?:Sync)?\s*\(\s*{QUOTE}/tmp/", "file written under /tmp", SKIP),
    ]),
    ("SEC-FILE-004", "low", "low", "upload", "CWE-434", [
        (r"\bmulter\s*\(\s*\{\s*(?:dest|storage)\b", "upload without a filter", SKIP),
        (r"\bfile\.(?:originalname|filename)\b", "name of an upload is used", SKIP | {"severity": "medium", "confidence": "medium"}),
    ]),
)
