"""XML parsers, server-side requests, CORS, CSRF and rate limits."""

from codesift.detectors import USER, family

#: Signs of a hardened XML parser and of a checked address, anywhere in the file.
HARDENED = {"skip_file": (r"disallow-doctype-decl|SUPPORT_DTD|IS_SUPPORTING_EXTERNAL_ENTITIES", r"(?s)external-general-entities.*external-parameter-entities|external-parameter-entities.*external-general-entities")}
CHECKED = {"skip_file": (r"startsWith|validate|whitelist|trusted",)}
LIMITER = {"skip_line": (r"(?i)limit|throttle",)}

API = family(
    "api-security",
    ("SEC-XXE-001", "critical", "high", "xxe", "CWE-611", [
        (r"\bDocumentBuilderFactory\.newInstance\s*\(", "XML factory with default settings", HARDENED),
        (r"\bXMLInputFactory\.newInstance\s*\(|\bXMLInputFactory\.newFactory\s*\(", "XML reader with default settings", HARDENED),
    ]),
    ("SEC-XXE-002", "critical", "high", "xxe", "CWE-611", [
        (r"\bparseXml(?:String)?\s*\([^)]*noent\s*:\s*true", "entities are expanded"),
        (r"\bnew\s+xml2js\.Parser\s*\(", "xml2js parser", {"severity": "medium"}),
    ]),
    ("SEC-XXE-003", "medium", "medium", "xxe", "CWE-611", [(r"\betree\.(?:parse|fromstring)\s*\(", "etree parses external XML")]),
    ("SEC-SRF-001", "critical", "high", "ssrf", "CWE-918", [
        (rf"\baxios(?:\.(?:get|post|put|delete|request))?\s*\(\s*(?:{USER}|url\b)", "axios with a caller's address", CHECKED),
        (rf"\bfetch\s*\(\s*(?:{USER}|url\b)", "fetch with a caller's address", CHECKED),
    ]),
    ("SEC-SRF-002", "critical", "high", "ssrf", "CWE-918", [
        (rf"\burlopen\s*\(\s*(?:{USER}|url\b)", "urlopen with a caller's address", CHECKED),
        (rf"\brequests\.(?:get|post|put|delete|head)\s*\(\s*(?:{USER}|url\b)", "requests with a caller's address", CHECKED),
    ]),
    ("SEC-SRF-003", "high", "medium", "ssrf", "CWE-918", [(r"\bHttpRequest\.newBuilder\s*\(\s*\)?\s*\.?\s*(?:uri\s*\()?\s*URI\.create\s*\(\s*\w+|\bhttpClient\.send\s*\(\s*\w+", "HTTP client with a variable address")]),
    ("SEC-COR-001", "high", "high", "cors", "CWE-942", [
        (r"Access-Control-Allow-Origin[\"']?\s*[,:]\s*[\"']\*", "all origins by header"),
        (r"\borigin\s*:\s*[\"']\*[\"']", "all origins by option", {"severity": "medium"}),
    ]),
    ("SEC-COR-002", "critical", "high", "cors", "CWE-942", [(r"Access-Control-Allow-Origin[\"']?\s*,\s*req\.headers?\.?\(?[\"']?origin", "origin is reflected")]),
    ("SEC-CSRF-001", "high", "high", "csrf", "CWE-352", [(r"\.csrf\s*\(\s*\)\s*\.disable\s*\(", "CSRF is disabled")]),
    ("SEC-CSRF-002", "low", "low", "csrf", "CWE-352", [(r"\bcsurf\s*\(", "csurf is used")]),
    ("SEC-RAT-001", "medium", "low", "rate-limit", "CWE-307", [
        (r"\b(?:app|router)\.post\s*\(\s*[\"'][^\"']*/(?:login|signin)[\"']", "login without a limiter", LIMITER),
        (r"\b(?:app|router)\.post\s*\(\s*[\"'][^\"']*/(?:register|signup)[\"']", "registration without a limiter", LIMITER),
    ]),
)
