"""Passwords, CSRF, sessions, tokens and middleware."""

from codesift.detectors import QUOTE, family

VALUE = r"\s*[:=]\s*"

AUTH = family(
    "auth",
    ("SEC-AUTH-001", "critical", "high", "password", "CWE-798", [
        (r"\b(?:password|passwd|pwd)\s*={2,3}\s*[\"'][^\"']+[\"']", "password compared with a literal"),
        (r"\bif\s*\(\s*(?:password|passwd|pwd)\s*={2,3}\s*req\b", "password compared with request data"),
        (r"\b(?:password|passwd|pwd)\s*==\s*[A-Za-z_]\w*", "loose comparison of a password", {"severity": "high", "confidence": "medium"}),
        (r"\bcompare(?:Sync)?\s*\(\s*password\s*,\s*password\s*\)", "password compared with itself", {"severity": "low", "confidence": "low"}),
    ]),
    ("SEC-AUTH-002", "high", "medium", "csrf", "CWE-352", [
        (rf"\bcsrf\w*{VALUE}(?:false|disabled|off)\b", "CSRF protection is off"),
        (r"\bapp\.(?:disable|set)\s*\(\s*[\"']csrf", "CSRF setting is changed"),
        (r"@csrf_exempt\b", "view is exempt from CSRF checks", {"severity": "medium"}),
        (r"\bskip_before_action\s+:verify_authenticity_token\b", "authenticity token is skipped"),
    ]),
    ("SEC-AUTH-003", "high", "medium", "session", "CWE-614", [
        (rf"\bsecure{VALUE}false\b", "cookie without secure"),
        (rf"\bhttp_?only{VALUE}false\b", "cookie without httpOnly"),
        (rf"\bsame_?site{VALUE}[\"']none[\"']", "cookie with sameSite none", {"severity": "medium"}),
        (rf"\bsession\b.*\bsecret{VALUE}{QUOTE}[^\"'`]{{1,15}}{QUOTE}", "short session secret"),
        (r"\bSESSION_COOKIE_SECURE\s*=\s*False\b", "session cookie without secure"),
    ]),
    ("SEC-AUTH-004", "critical", "high", "jwt", "CWE-347", [
        (rf"\bjwt\.sign\s*\([^,]+,\s*{QUOTE}[^\"'`]+{QUOTE}", "token signed with a literal"),
        (rf"\bjwt\.verify\s*\([^,]+,\s*{QUOTE}[^\"'`]+{QUOTE}", "token verified with a literal"),
        (rf"\bjwt_?secret{VALUE}{QUOTE}[^\"'`]+{QUOTE}", "token secret is a literal"),
        (rf"\balgorithms?{VALUE}\[?\s*{QUOTE}none{QUOTE}", "algorithm none"),
    ]),
    ("SEC-AUTH-005", "medium", "medium", "middleware", "CWE-16", [
        (r"\b(?:helmet|auth|authenticate|csrf)\w*\s*\(\s*\{\s*enabled\s*:\s*false", "middleware is disabled"),
        (r"\bcors\s*\(\s*\{\s*origin\s*:\s*(?:true|[\"']\*[\"'])", "any origin is allowed"),
        (r"\bapp\.disable\s*\(\s*[\"'](?:x-powered-by|etag)[\"']", "header is disabled", {"severity": "low", "confidence": "low"}),
        (r"\bALLOWED_HOSTS\s*=\s*\[\s*[\"']\*[\"']", "all hosts are allowed", {"severity": "high"}),
        (r"\bDEBUG\s*=\s*True\b", "debug mode is on", {"case": True}),
    ]),
)
