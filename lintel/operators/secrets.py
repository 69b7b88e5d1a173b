"""Hard-coded secrets, natively: a catalogue of patterns and what clears a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a secret looks like, in the order that they are tried.
PATTERNS = (
    ("credential assignment", r"(?i)(api[_-]?key|secret|passwd|password|token)\s*[:=]\s*['\"][^'\"]{8,}['\"]"),
    ("AWS access key", r"AKIA[0-9A-Z]{16}"),
    ("bearer token", r"(?i)bearer\s+[a-z0-9\-_\.]{20,}"),
    ("private key", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("Stripe live secret key", r"\bsk_live_[0-9a-zA-Z]{20,}"),
    ("Stripe test secret key", r"\bsk_test_[0-9a-zA-Z]{20,}"),
    ("GitHub personal access token", r"\bghp_[0-9A-Za-z]{36}\b"),
    ("GitHub fine-grained token", r"\bgithub_pat_[0-9A-Za-z_]{50,}"),
    ("GitLab personal access token", r"\bglpat-[0-9A-Za-z_\-]{20,}"),
    ("Google API key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("Slack token", r"\bxox[baprs]-[0-9A-Za-z\-]{10,}"),
    ("database connection string with credentials", r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|amqps|mssql)://[^\s\"'/@]*:[^\s\"'/@]+@[^\s\"'/]+"),
    ("URL with embedded credentials", r"(?i)\bhttps?://[a-z0-9_\-]+:[a-z0-9_\-]{4,}@[a-z0-9.\-]+"),
    ("connection string assignment", r"(?i)\b(?:db_url|database_url|redis_url|mongo_url|amqp_url|connection_string|dsn)\s*[:=]\s*['\"][^'\"]{10,}['\"]"),
)
# Lines and values that clear a match: placeholders, interpolation, queries, values that are read.
PLACEHOLDER = r"(?i)(your[_-]?|example|placeholder|xxxx|<.*>|changeme)"
INTERPOLATED = r"[\{\}\$%]|^\s*:\w+\s*$|^[:%]"
QUERY_LINE = r"(?i)\b(select|insert|update|delete|where|from)\b"
F_STRING = r"f[\"']"
CALLED = r"=\s*[A-Za-z_][\w\.]*\s*(\(|\[)"
READ = r"(?i)(request\.|getenv|environ|os\.environ|config\[|\.get\(|input\(|argv|prompt|getpass)"


def cleared(line: Column, matched: Column) -> Column:
    value = F.regexp_extract(matched, r"['\"]([^'\"]+)['\"]", 1)
    return line.rlike(PLACEHOLDER) | value.rlike(INTERPOLATED) | line.rlike(QUERY_LINE) | line.rlike(F_STRING) | line.rlike(CALLED) | line.rlike(READ)


def secrets(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, label, lineno, matched): for each text the first pattern's first match that nothing clears.

    A match and what clears it stand on one line.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    any_ = "|".join(f"(?:{p})" for _, p in PATTERNS)
    lines = lines.where(F.col("line").rlike(any_))
    found = [F.struct(F.lit(i).alias("order"), F.lit(label).alias("label"), F.regexp_extract("line", f"({p})", 1).alias("matched")) for i, (label, p) in enumerate(PATTERNS)]
    each = lines.select(key, "at", "line", F.explode(F.array(*found)).alias("m")).where("m.matched <> ''").where(~cleared(F.col("line"), F.col("m.matched")))
    first = each.groupBy(key).agg(F.min(F.struct("m.order", "at", "m.label", "m.matched")).alias("f"))
    return first.select(key, F.col("f.label").alias("label"), (F.col("f.at") + 1).alias("lineno"), F.col("f.matched").alias("matched"))
