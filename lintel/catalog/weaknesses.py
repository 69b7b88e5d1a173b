"""Weakness classes: base vectors, parents, layers and what changes them. Fixed values."""

# CWE | name | parent | layer | AV AC PR UI S C I A | signal:overrides, in order.
_CLASSES = """
CWE-78|OS Command Injection|CWE-77|taint|NLNNUHHH|auth_required:PR=L;sandboxed_or_restricted:S=U,A=L
CWE-89|SQL Injection|CWE-943|taint|NLNNUHLN|write_operation:I=H;auth_required:PR=L;stacked_or_admin:I=H,A=H
CWE-22|Path Traversal|CWE-706|taint|NLNNUHNN|write_operation:I=H;auth_required:PR=L
CWE-79|Reflected Cross-Site Scripting (XSS)|CWE-74|structural|NLNNCLLN|auth_required:PR=L
CWE-200|Sensitive Information Exposure|CWE-668|structural|NLNNULNN|stacked_or_admin:C=H
CWE-1336|Server-Side Template Injection|CWE-94|taint|NLNNUHHH|sandboxed_or_restricted:I=L,A=N,C=H;auth_required:PR=L
CWE-94|Code Injection|CWE-913|taint|NLNNUHHH|auth_required:PR=L
CWE-502|Insecure Deserialization|CWE-913|taint|NLNNUHHH|needs_gadget:AC=H;auth_required:PR=L
CWE-918|Server-Side Request Forgery (SSRF)|CWE-441|taint|NLNNULNN|sensitive_target:S=C,C=H,I=L;internal_reachable:S=C,C=H;blind:AC=H,C=L,I=N;auth_required:PR=L
CWE-601|Open Redirect|CWE-610|taint|NLNRCLNN|auth_context:C=H
CWE-611|XML External Entity (XXE)|CWE-610|taint|NLNNCHNL|auth_required:PR=L
CWE-943|NoSQL Injection|CWE-74|taint|NLNNUHLN|where_js_eval:C=H,I=H,A=H;auth_bypass:I=H;auth_required:PR=L
CWE-90|LDAP Injection|CWE-74|taint|NLNNUHLN|auth_bypass:I=H;auth_required:PR=L
CWE-643|XPath Injection|CWE-74|taint|NLNNUHNN|auth_bypass:I=H;auth_required:PR=L
CWE-113|HTTP Response Splitting / CRLF Injection|CWE-93|taint|NLNRCLLN|sets_cookie_or_auth_header:I=H;auth_required:PR=L
CWE-639|Insecure Direct Object Reference|CWE-863|structural|NLLNUHNN|write_operation:I=H;no_auth:PR=N
CWE-602|Broken Authorization (client-controlled role)|CWE-863|structural|NLLNUHHN|no_auth:PR=N
CWE-306|Missing Authentication|CWE-862|structural|NLNNUHHN|
CWE-287|Broken Authentication (static credential)|CWE-1211|structural|NLNNUHHN|
CWE-347|JWT Verification Weakness|CWE-345|structural|NLNNUHHN|
CWE-798|Hardcoded Secret / Credential|CWE-344|structural|NLNNUHLN|local_only:AV=L,C=L
CWE-327|Weak / Broken Cryptography|CWE-693|structural|NHNNULLN|password_storage:C=H
CWE-942|Permissive CORS Configuration|CWE-668|structural|NLNRCLNN|with_credentials:C=H
CWE-489|Debug Mode / Verbose Errors|CWE-710|structural|NLNNULNN|console_enabled:C=H,I=H
CWE-915|Mass Assignment / Over-posting|CWE-913|structural|NLLNULHN|privilege_field:C=H
CWE-367|Race Condition (TOCTOU)|CWE-362|structural|NHLNULHL|financial:I=H,A=N,C=L
CWE-307|Missing Rate Limiting|CWE-799|structural|NLNNULNL|
CWE-840|Business Logic (Price/Quantity Manipulation)|CWE-840|structural|NLLNUNHN|
CWE-295|Disabled TLS Certificate Verification|CWE-287|structural|NHNNUHHN|sends_credentials:AC=L,C=H,I=H
CWE-1004|Insecure Cookie Flags (session/auth)|CWE-732|structural|NLNRUHLN|no_secure_flag:AC=L
CWE-352|CSRF Protection Disabled|CWE-345|structural|NLNRULHL|
CWE-330|Insecure Randomness for Security Value|CWE-693|structural|NHNNUHHN|password_reset:AC=L,I=H
CWE-732|Overly Permissive File Permissions|CWE-732|structural|LLLNULHL|
CWE-377|Insecure Temporary File|CWE-668|structural|LHLNULHL|
CWE-20|Unclassified Finding|CWE-707|structural|NLNNULLN|
"""
FALLBACK = "CWE-20"
METRICS = ("AV", "AC", "PR", "UI", "S", "C", "I", "A")

# Other names of the classes.
_OTHER_NAMES = """
CWE-78|command injection
CWE-79|cross-site scripting (xss);cross-site scripting;reflected xss;xss
CWE-200|information disclosure;sensitive data exposure
CWE-918|server-side request forgery;ssrf
CWE-611|xxe
CWE-639|idor
CWE-602|broken authorization
CWE-287|broken authentication
CWE-798|hardcoded secret
CWE-327|weak cryptography
CWE-113|crlf injection
CWE-377|insecure temp file
"""


def classes() -> list[dict]:
    """cwe, name, parent, layer, vector (metric to code) and signals (name, overrides) of each class."""
    out = []
    for line in _CLASSES.strip().splitlines():
        cwe, name, parent, layer, codes, signals = line.split("|")
        parsed = [(s.split(":")[0], dict(p.split("=") for p in s.split(":")[1].split(","))) for s in signals.split(";") if s]
        out.append({"cwe": cwe, "name": name, "parent": parent, "layer": layer, "vector": dict(zip(METRICS, codes, strict=True)), "signals": parsed})
    return out


def names() -> list[tuple[str, str]]:
    """(lower-case name, cwe): own names first, then the others."""
    own = [(c["name"].lower(), c["cwe"]) for c in classes() if c["cwe"] != FALLBACK]
    others = [(n, line.split("|")[0]) for line in _OTHER_NAMES.strip().splitlines() for n in line.split("|")[1].split(";")]
    return own + others


# CVSS 3.1 weights of the metrics' codes; PR by scope.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.50},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.00},
}

# Marks of authentication, of inner targets and of writes.
AUTH_MARKS = (
    r"@login_required|@requires_auth|@auth\.|@jwt_required|current_user|session\[|session\.get\s*\(|g\.user|request\.user"
    r"|is_authenticated|verify_jwt|@permission|check_auth|requires_login|@authenticated"
)
INNER_TARGETS = (
    r"169\.254\.169\.254|metadata\.google|metadata\.azure|100\.100\.100\.200|127\.0\.0\.1|localhost|0\.0\.0\.0|10\.\d"
    r"|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|internal|\.local\b|/latest/meta-data|/computeMetadata"
)
SQL_WRITES = r"\b(INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|CREATE|REPLACE|GRANT|MERGE)\b"
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
