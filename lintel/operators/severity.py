"""Severity by context: class lookup, signals, CVSS vector, score and rating, in one pass of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.catalog import weaknesses as W
from lintel.functions import cvss
from lintel.functions.paths import lookup

_CLASSES = {c["cwe"]: c for c in W.classes()}


def resolve(cwe: Column, type_: Column) -> Column:
    """The class of a finding: by CWE, by name, by the names' first 18 characters, else the fallback."""
    number = F.regexp_extract(F.upper(F.trim(F.coalesce(cwe, F.lit("")))), r"^(?:CWE)?-?(\d+)$", 1)
    key = F.concat(F.lit("CWE-"), number)
    by_cwe = F.when(key.isin(*_CLASSES), F.when(key != W.FALLBACK, key))
    name = F.lower(F.trim(F.coalesce(type_, F.lit(""))))
    by_name = lookup(dict(reversed(W.names())), name)
    by_prefix = F.lit(None).cast("string")
    for known, c in reversed(W.names()):
        by_prefix = F.when(F.startswith(name, F.lit(known[:18])) | F.startswith(F.lit(known), F.substring(name, 1, 18)), c).otherwise(by_prefix)
    return F.coalesce(by_cwe, by_name, F.when(name != "", by_prefix), F.lit(W.FALLBACK))


def signals(cwe: Column, source: Column, explanation: Column) -> Column:
    """Names of the signals that a finding's text gives, of those its class knows."""
    text = F.concat_ws("\n", F.coalesce(source, F.lit("")), F.coalesce(explanation, F.lit("")))
    has = lambda pattern: text.rlike("(?i)" + pattern)
    auth = has(W.AUTH_MARKS)
    blind = has(r"\bblind\b|out[- ]of[- ]band|no\s+response|fire[- ]and[- ]forget")
    guard = has(r"allowlist|whitelist|is_allowed|urlparse|ipaddress|hostname\s+(in|not in)")
    inner = has(W.INNER_TARGETS)
    writes = (
        ((cwe == "CWE-89") & has(W.SQL_WRITES))
        | ((cwe == "CWE-22") & text.rlike(r"open\s*\([^)]*['\"][wa]\+?['\"]|['\"]\s*,\s*['\"][wa]"))
        | ((cwe == "CWE-639") & has(r"\.save\s*\(|\.delete\s*\(|\.update\s*\(|INSERT|UPDATE|DELETE"))
    )
    access = cwe.isin("CWE-602", "CWE-639", "CWE-306", "CWE-287", "CWE-915")
    ssrf = cwe == "CWE-918"
    given = {
        "auth_required": auth & ~access,
        "no_auth": ~auth,
        "sensitive_target": ssrf & inner & ~blind,
        "internal_reachable": ssrf & ~inner & ~guard & ~blind,
        "blind": ssrf & blind,
        "write_operation": writes,
        "password_storage": (cwe == "CWE-327") & has("password|passwd|pwd|credential"),
        "with_credentials": (cwe == "CWE-942") & has("allow[_-]?credentials"),
        "financial": (cwe == "CWE-367") & has("balance|amount|stock|inventory|quantity|wallet|credit|payment"),
    }
    known = F.lit(None).cast("array<string>")
    for c in _CLASSES.values():
        names = [n for n, _ in c["signals"]]
        known = F.when(cwe == c["cwe"], F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")).otherwise(known)
    active = F.array_compact(F.array(*[F.when(v, k) for k, v in given.items()]))
    return F.filter(known, lambda s: F.array_contains(active, s))


def vector(cwe: Column, active: Column) -> dict[str, Column]:
    """Codes of the class' base vector with the signals' overrides applied in the class' order."""
    out = {}
    for m in W.METRICS:
        code = F.lit(None).cast("string")
        for c in _CLASSES.values():
            value = F.lit(c["vector"][m])
            for name, overrides in c["signals"]:
                if m in overrides:
                    value = F.when(F.array_contains(active, name), overrides[m]).otherwise(value)
            code = F.when(cwe == c["cwe"], value).otherwise(code)
        out[m] = code
    return out


def apply_severity(findings: DataFrame) -> DataFrame:
    """findings (cwe, type, source, explanation, confidence, status) re-scored.

    cwe, severity and, for confirmed rows, confidence are replaced; parent_cwe,
    signals, cvss_score and cvss_vector are added. No row comes or goes.
    """
    found = findings.withColumn("cwe", resolve(F.col("cwe"), F.col("type")))
    found = found.withColumn("signals", signals(F.col("cwe"), F.col("source"), F.col("explanation")))
    codes = vector(F.col("cwe"), F.col("signals"))
    found = found.withColumn("_v", F.struct(*[c.alias(m) for m, c in codes.items()]))
    parts = {m: F.col(f"_v.{m}") for m in W.METRICS}
    found = found.withColumn("cvss_score", cvss.base_score(parts)).withColumn("cvss_vector", cvss.vector_string(parts)).drop("_v")
    confirmed = F.upper(F.coalesce("status", F.lit(""))) == "CONFIRMED"
    return (
        found.withColumn("severity", cvss.rating(F.col("cvss_score")))
        .withColumn("parent_cwe", lookup({c["cwe"]: c["parent"] for c in _CLASSES.values()}, F.col("cwe")))
        .withColumn("confidence", F.when(confirmed, F.lit(1.0)).otherwise(F.col("confidence")))
    )
