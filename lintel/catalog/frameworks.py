"""Compliance frameworks and attack chains: fixed values."""

# Requirements and the weaknesses that break them.
FRAMEWORKS = {
    "owasp": {
        "A01: Broken Access Control": "22 78 287 306 602 639 862 863 913 915",
        "A02: Cryptographic Failures": "327 328 329 347 798 916",
        "A03: Injection": "79 89 90 94 113 643 943 1336",
        "A04: Insecure Design": "209 256 501 522 787",
        "A05: Security Misconfiguration": "16 489 942 1188 1390",
        "A06: Vulnerable and Outdated Components": "937 1035",
        "A07: Identification and Authentication Failures": "287 290 294 307 308 346 384 798",
        "A08: Software and Data Integrity Failures": "502 829 494",
        "A09: Security Logging and Monitoring Failures": "778 117 223 532",
        "A10: Server-Side Request Forgery (SSRF)": "918 921",
    },
    "pci_dss": {
        "6.5.1: Injection flaws": "89 78 90 94 943 643 113",
        "6.5.2: Broken authentication": "287 290 307 798",
        "6.5.3: Sensitive data exposure": "327 328 347 200 209",
        "6.5.4: XXE": "611",
        "6.5.5: Broken access control": "22 602 639 862 863",
        "6.5.6: Security misconfiguration": "16 489 942",
        "6.5.7: XSS": "79",
        "6.5.8: Insecure deserialization": "502",
        "6.5.9: Known vulnerable components": "937 1035",
        "6.5.10: Insufficient logging": "778 223 532",
        "6.5.11: SSRF": "918",
    },
    "nist": {
        "AC-3: Access Enforcement": "22 602 639 862 863",
        "AC-7: Unsuccessful Login Attempts": "307",
        "AU-2: Event Logging": "778 223 532",
        "IA-2: Identification and Authentication": "287 290 798",
        "IA-5: Authenticator Management": "798 327 347",
        "SC-8: Transmission Confidentiality and Integrity": "327 329",
        "SC-13: Cryptographic Protection": "327 328 347",
        "SI-10: Information Input Validation": "79 89 78 90 94 918 943 611 502 113 643",
        "SI-15: Information Filtering": "79 89 78 918",
    },
    "iso": {
        "A.9: Access Control": "22 287 306 602 639 862 863",
        "A.10: Cryptography": "327 328 329 347 798",
        "A.12.6: Technical Vulnerability Management": "937 1035",
        "A.14.2: Security in Development and Support": "89 78 79 502 918 22 489 942",
    },
}

# The 22 weaknesses of the top list.
TOP_25 = "787 79 89 20 22 78 494 98 502 287 522 416 862 476 306 918 119 798 125 190 352 276"

# Chains of weaknesses, the severity they have together and their steps in order.
CHAINS = (
    ("Upload + Execution = RCE", "CRITICAL", "22 94"),
    ("Upload + Inclusion = RCE", "CRITICAL", "434 98"),
    ("SSRF + Internal Service = Data Exfiltration", "CRITICAL", "918 200"),
    ("SQLi + Hardcoded Creds = Full DB Compromise", "CRITICAL", "89 798"),
    ("XSS + Session = Account Takeover", "HIGH", "79 384"),
    ("Deserialization + Command Exec = RCE", "CRITICAL", "502 78"),
    ("IDOR + Info Exposure = Mass Data Leak", "HIGH", "639 200"),
    ("Open Redirect + XSS = Phishing", "MEDIUM", "601 79"),
    ("Race + IDOR = Privilege Escalation", "HIGH", "367 639"),
    ("Mass Assignment + Missing Auth = Admin Takeover", "CRITICAL", "915 306"),
)


def cwes(text: str) -> list[str]:
    return [f"CWE-{n}" for n in text.split()]


def requirements() -> list[tuple[str, int, str, str]]:
    """(framework, place, requirement, cwe) rows."""
    return [(f, i, r, c) for f, rows in FRAMEWORKS.items() for i, (r, text) in enumerate(rows.items()) for c in cwes(text)]


def chain_steps() -> list[tuple[int, str, str, int, str]]:
    """(rule, name, severity, step, cwe) rows."""
    return [(i, name, sev, k, c) for i, (name, sev, text) in enumerate(CHAINS) for k, c in enumerate(cwes(text))]
