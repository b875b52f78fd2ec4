"""Weak hashes, ciphers, random numbers, keys and TLS settings."""

from codesift.detectors import QUOTE, family

WEAK = r"(?:des|des3|3des|rc2|rc4|blowfish)"
#: Places where a random number is no secret.
HARMLESS = (r"id:|id =|key:|key =|reactKey|index|assert|tc\.", r"(?i)^\s*(?:const|let|var)\s+\w*(?:id|key|uuid|idx|index)\w*\s*=")

CRYPTO = family(
    "crypto",
    ("SEC-CRYPTO-001", "high", "high", "weak-hash", "CWE-328", [
        (rf"\bcreateHash\s*\(\s*{QUOTE}md5{QUOTE}", "MD5 through createHash"),
        (rf"\bcreateHash\s*\(\s*{QUOTE}sha-?1{QUOTE}", "SHA-1 through createHash", {"severity": "medium"}),
        (r"\bhashlib\.md5\b|\bMessageDigest\.getInstance\s*\(\s*\"MD5\"", "MD5 digest"),
        (r"\bhashlib\.sha1\b|\bMessageDigest\.getInstance\s*\(\s*\"SHA-?1\"", "SHA-1 digest", {"severity": "medium"}),
        (r"\bDigestUtils\.md5\w*\s*\(", "MD5 through DigestUtils"),
        (r"\bmd5\s*\(\s*\$?(?:password|passwd|pwd|secret)", "MD5 of a password", {"severity": "critical"}),
    ]),
    ("SEC-CRYPTO-002", "high", "high", "weak-cipher", "CWE-327", [
        (rf"\bcreateCipher(?:iv)?\s*\(\s*{QUOTE}{WEAK}\b", "weak cipher through createCipher"),
        (rf"\b(?:new\s+{WEAK}\b|{WEAK}\.new\s*\()", "weak cipher object"),
        (rf"\bCipher\.getInstance\s*\(\s*\"{WEAK}\b", "weak cipher instance"),
        (r"\b(?:aes[-/_\w]*ecb|MODE_ECB)\b", "ECB mode"),
        (r"\bcreateCipher\s*\(", "createCipher without an IV"),
    ]),
    ("SEC-CRYPTO-003", "medium", "medium", "insecure-random", "CWE-330", [
        (r"\bMath\.random\s*\(", "Math.random", {"skip_line": HARMLESS}),
        (r"\b(?:token|secret|password|nonce|salt)\w*\s*=.*\bMath\.random\s*\(", "secret from Math.random", {"severity": "critical", "skip_line": HARMLESS}),
        (r"\brandom\.(?:random|randint|choice)\s*\(", "random module"),
        (r"\bnew\s+(?:java\.util\.)?Random\s*\(", "java.util.Random"),
        (r"(?:^|[^\w.>:])s?rand\s*\(", "rand()"),
    ]),
    ("SEC-CRYPTO-004", "critical", "medium", "hardcoded-key", "CWE-321", [
        (rf"\b(?:encryption|cipher|aes|secret)_?key\s*[:=]\s*{QUOTE}[^\"'`]{{8,}}{QUOTE}", "encryption key is a literal"),
        (rf"\bprivate_?key\s*[:=]\s*{QUOTE}[^\"'`]{{8,}}{QUOTE}", "private key is a literal"),
        (rf"\b(?:iv|initialization_?vector)\s*[:=]\s*{QUOTE}[0-9a-f]{{16,}}{QUOTE}", "IV is a literal", {"severity": "high"}),
        (rf"\bBuffer\.from\s*\(\s*{QUOTE}[0-9a-f]{{16,}}{QUOTE}\s*,\s*{QUOTE}hex{QUOTE}", "key bytes are a literal", {"severity": "medium"}),
    ]),
    ("SEC-CRYPTO-005", "critical", "high", "tls", "CWE-295", [
        (r"\brejectUnauthorized\s*:\s*false\b", "certificates are not checked"),
        (r"\bNODE_TLS_REJECT_UNAUTHORIZED\b['\"\]]*\s*[:=]\s*['\"]?0", "certificates are not checked in the process"),
        (r"\bverify\s*=\s*False\b|\bVERIFY_NONE\b", "verification is off"),
        (r"\bdisable_warnings\s*\([^)]*InsecureRequestWarning", "warnings are silenced", {"severity": "medium"}),
        (r"\b_create_unverified_context\b", "unverified context"),
        (r"\bcheckServerIdentity\s*:\s*\(\s*\)\s*=>", "server identity is not checked"),
    ]),
)
