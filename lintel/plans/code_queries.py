"""Queries over source code: the tables hold none, so each customer gets a file from templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import detectors, fixers, taint, units
from lintel.plans import engine
from lintel.plans.rule_cases import CASES
from lintel.sources.shared import dealt

TEMPLATES = (
    ("python", '@app.route("/u{n}")\ndef show_{n}():\n    name = request.args.get("n")\n    db.execute("SELECT * FROM t WHERE n = " + name)\n    return "ok"\n'),
    ("python", "def clean_{n}(x):\n    return int(x)\n\ndef page_{n}():\n    v = request.args.get('v')\n    w = clean_{n}(v)\n    return str(w)\n"),
    ("python", "def run_{n}(c):\n    os.system('ls ' + c)\n\ndef entry_{n}():\n    run_{n}(request.args['c'])\n\napp.run(debug=True)\n"),
    ("php", "<?php\nfunction q{n}($x) {{\n  return mysqli_query($db, 'SELECT ' . $x);\n}}\nfunction f{n}() {{\n  $v = $_GET['v'];\n  return q{n}($v);\n}}\n"),
    ("javascript", "app.get('/r{n}', (req, res) => {{\n  const u = req.query.u;\n  res.redirect(u);\n}});\n"),
    ("python", "def load_{n}(data):\n    return pickle.loads(data)\n\ndef key_{n}():\n    password = 'hunter{n}hunter'\n    return hashlib.md5(password)\n"),
)
ENDINGS = {"python": "py", "php": "php", "javascript": "js"}


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    which = F.pmod(n, F.lit(len(TEMPLATES))).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), which)
    text = F.replace(F.replace(F.replace(pick([t for _, t in TEMPLATES]), F.lit("{n}"), n.cast("string")), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    path = F.concat(F.lit("src/m"), F.floor(n / 50).cast("string"), F.lit("/f"), n.cast("string"), F.lit("."), pick([ENDINGS[lang] for lang, _ in TEMPLATES]))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(path.alias("rel_path"), pick([lang for lang, _ in TEMPLATES]).alias("language"), text.alias("text"))


#: Rows that the templates must give, by template; {n} is the customer's key.
UNITS = (
    (0, "<module>", 1, 6, "", True), (0, "show_{n}", 2, 5, "", False),
    (1, "clean_{n}", 1, 2, "x", False), (1, "page_{n}", 4, 7, "", False),
    (2, "<module>", 1, 8, "", True), (2, "entry_{n}", 4, 5, "", False), (2, "run_{n}", 1, 2, "c", False),
    (3, "<module>", 1, 9, "", True), (3, "f{n}", 5, 8, "", False), (3, "q{n}", 2, 4, "x", False),
    (4, "handler[GET /r{n}]", 1, 4, "req,res", False),
    (5, "key_{n}", 4, 6, "", False), (5, "load_{n}", 1, 2, "data", False),
)
FLOWS = (
    (0, "show_{n}", 4, "SQL Injection", 0.85, "derived from tainted `name`"),
    (2, "entry_{n}", 5, "OS Command Injection", 0.8, "through run_{n}()"),
    (3, "f{n}", 7, "SQL Injection", 0.8, "through q{n}()"),
    (4, "handler[GET /r{n}]", 3, "Open Redirect", 0.8, "tainted input reaches sink"),
)
FOUND = (
    (0, "show_{n}", 4, "sql-injection", "SQL Injection", "CWE-89", "HIGH", 8.2, 0.85, "taint-dataflow"),
    (2, "<module>", 7, "debug-mode", "Debug Mode / Verbose Errors Enabled", "CWE-489", "MEDIUM", 5.3, 0.5, "static"),
    (2, "run_{n}", 2, "command-injection", "OS Command Injection", "CWE-78", "CRITICAL", 9.8, 0.8, "taint-dataflow"),
    (3, "f{n}", 7, "taint-engine", "SQL Injection", "CWE-89", "HIGH", 8.2, 0.8, "taint-dataflow"),
    (4, "handler[GET /r{n}]", 3, "taint-engine", "Open Redirect", "CWE-601", "MEDIUM", 4.7, 0.8, "taint-dataflow"),
    (5, "key_{n}", 5, "hardcoded-secret", "Hardcoded Secret / Credential", "CWE-798", "HIGH", 8.2, 0.6, "static"),
    (5, "key_{n}", 6, "weak-crypto", "Weak / Broken Cryptography", "CWE-327", "MEDIUM", 6.5, 0.5, "static"),
    (5, "load_{n}", 2, "dangerous-sink", "Insecure Deserialization", "CWE-502", "CRITICAL", 9.8, 0.7, "static"),
)
FIXED = (
    (0, "show_{n}", "SQL Injection", "applied", "the finding is gone", '@@ -3 +3 @@\n-    db.execute("SELECT * FROM t WHERE n = " + name)\n+    db.execute("SELECT * FROM t WHERE n = ?", (name,))'),
    (2, "<module>", "Debug Mode / Verbose Errors Enabled", "applied", "the finding is gone", "@@ -7 +7 @@\n-app.run(debug=True)\n+app.run(debug=False)"),
    (2, "run_{n}", "OS Command Injection", "applied", "the finding is gone", "@@ -2 +2 @@\n-    os.system('ls ' + c)\n+    os.system('ls ' + shlex.quote(c))"),
    (3, "f{n}", "SQL Injection", "suggested", "no rewrite of this shape", ""),
    (4, "handler[GET /r{n}]", "Open Redirect", "rejected", "the finding is still there", ""),
    (5, "key_{n}", "Hardcoded Secret / Credential", "applied", "the finding is gone", "@@ -2 +2 @@\n-    password = 'hunter{n}hunter'\n+    password = os.environ[\"PASSWORD\"]"),
    (5, "key_{n}", "Weak / Broken Cryptography", "applied", "the finding is gone", "@@ -3 +3 @@\n-    return hashlib.md5(password)\n+    return hashlib.sha256(password)"),
    (5, "load_{n}", "Insecure Deserialization", "applied", "the finding is gone", "@@ -2 +2 @@\n-    return pickle.loads(data)\n+    return json.loads(data)"),
)


def _literal(x: object) -> str:
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, float):
        return f"{x}::DOUBLE"
    return f"{x}::INTEGER" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _sql(columns: str, rows: tuple, modulus: int, file: str) -> str:
    """The rows written out, for each customer whose key has the row's remainder."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(_literal(x) for x in r) + ")" for r in rows)
    filled = lambda i, c: f"replace(v.{c}, '{{n}}', c_custkey::VARCHAR) AS {c}" if isinstance(rows[0][i + 1], str) else f"v.{c}"
    return f"SELECT {file} AS file, {', '.join(filled(i, c) for i, c in enumerate(names))} FROM customer JOIN (VALUES {values}) AS v(k, {', '.join(names)}) ON c_custkey % {modulus} = v.k"


_FILE = "'src/m' || (c_custkey // 50)::VARCHAR || '/f' || c_custkey::VARCHAR || CASE c_custkey % 6 WHEN 3 THEN '.php' WHEN 4 THEN '.js' ELSE '.py' END"
_LANGUAGE = "CASE c_custkey % 6 WHEN 3 THEN 'php' WHEN 4 THEN 'javascript' ELSE 'python' END AS language"


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.extract(dealt(code_files(spark, sf_dir), "rel_path")).select("file", "language", "qualname", "lineno", "end_lineno", F.array_join("params", ",").alias("params"), "is_module")


def code_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.analyse(dealt(code_files(spark, sf_dir), "rel_path")).select("file", "function", "lineno", "type", "confidence", "via")


def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.scan(code_files(spark, sf_dir))
    return found.select("file", "function", "lineno", "matcher_id", "type", "cwe", "severity", "cvss_score", "confidence", "detection_method")


def fix_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, found = engine.parsed(code_files(spark, sf_dir))
    return fixers.patches(engine.scan_parsed(files, found), found).select("file", "function", "type", "status", "note", "diff")


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer: a rule's flagged snippet, or its safe one for odd keys."""
    n = F.col("c_custkey")
    cases = [(i, rule, language, snippet) for i, (rule, language, snippet) in enumerate((r, c[0], s) for r, c in CASES.items() for s in c[1:])]
    kinds = spark.createDataFrame(cases, "k int, rule string, language string, text string")
    held = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("src/r"), n.cast("string")).alias("rel_path"), F.pmod(n, F.lit(len(cases))).cast("int").alias("k"))
    return held.join(kinds, "k").drop("k")


def code_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule finds in its own snippets."""
    files = rule_files(spark, sf_dir)
    found = units.extract(files.drop("rule")).withColumn("linked", F.lit(False))
    hits = detectors.detect(found).join(files.select(F.col("rel_path").alias("file"), "rule"), "file")
    return hits.where("matcher_id = rule").select("file", "matcher_id", "function", "lineno", "type", "cwe", "severity", "confidence", "status")


#: What the flagged snippets must give, in order of the cases; the safe ones give nothing.
RULES = (
    (0, "race-condition", "withdraw", 2, "Race Condition (TOCTOU)", "CWE-367", "HIGH", 0.78, "OPEN"),
    (2, "price-manipulation", "buy", 3, "Price / Quantity Manipulation", "CWE-840", "HIGH", 0.55, "OPEN"),
    (4, "idor", "order", 3, "Insecure Direct Object Reference (IDOR)", "CWE-639", "HIGH", 0.5, "OPEN"),
    (6, "sql-injection", "f", 3, "SQL Injection", "CWE-89", "CRITICAL", 0.6, "OPEN"),
    (8, "broken-auth", "page", 2, "Broken Authorization (client-trusted role)", "CWE-602", "HIGH", 0.55, "OPEN"),
    (10, "weak-auth", "admin", 3, "Broken Authentication (static credential)", "CWE-287", "HIGH", 0.6, "OPEN"),
    (12, "negative-quantity", "cart", 3, "Negative / Zero Quantity", "CWE-840", "MEDIUM", 0.45, "OPEN"),
    (14, "hardcoded-secret", "f", 2, "Hardcoded Secret / Credential", "CWE-798", "HIGH", 0.6, "OPEN"),
    (16, "missing-rate-limit", "login", 2, "Sensitive Action Without Rate Limiting", "CWE-307", "MEDIUM", 0.4, "OPEN"),
    (18, "command-injection", "f", 2, "OS Command Injection", "CWE-78", "CRITICAL", 0.55, "OPEN"),
    (20, "path-traversal", "f", 3, "Path Traversal", "CWE-22", "HIGH", 0.5, "OPEN"),
    (22, "path-join-traversal", "f", 2, "Path Traversal", "CWE-22", "HIGH", 0.6, "OPEN"),
    (24, "ssti", "f", 3, "Server-Side Template Injection", "CWE-1336", "HIGH", 0.5, "OPEN"),
    (26, "weak-crypto", "f", 2, "Weak / Broken Cryptography", "CWE-327", "MEDIUM", 0.5, "OPEN"),
    (28, "open-redirect", "f", 3, "Open Redirect", "CWE-601", "MEDIUM", 0.45, "OPEN"),
    (30, "mass-assignment", "f", 3, "Mass Assignment / Over-posting", "CWE-915", "MEDIUM", 0.4, "OPEN"),
    (32, "xxe", "f", 2, "XML External Entity (XXE)", "CWE-611", "HIGH", 0.55, "OPEN"),
    (34, "insecure-deserialization", "f", 2, "Insecure Deserialization", "CWE-502", "HIGH", 0.5, "OPEN"),
    (36, "missing-auth", "delete_user", 1, "Missing Authentication on Sensitive Action", "CWE-306", "HIGH", 0.4, "OPEN"),
    (38, "debug-mode", "f", 2, "Debug Mode / Verbose Errors Enabled", "CWE-489", "LOW", 0.5, "OPEN"),
    (40, "cors-misconfig", "f", 2, "Permissive CORS Configuration", "CWE-942", "MEDIUM", 0.5, "OPEN"),
    (42, "jwt-weakness", "f", 2, "JWT Verification Weakness", "CWE-347", "HIGH", 0.5, "OPEN"),
    (44, "tls-verification-disabled", "f", 2, "Disabled TLS Certificate Verification", "CWE-295", "HIGH", 0.6, "OPEN"),
    (46, "insecure-cookie", "f", 3, "Insecure Cookie Flags (session/auth)", "CWE-1004", "MEDIUM", 0.55, "OPEN"),
    (48, "csrf-disabled", "f", 2, "CSRF Protection Disabled", "CWE-352", "MEDIUM", 0.55, "OPEN"),
    (50, "insecure-randomness", "reset_token", 2, "Insecure Randomness for Security Value", "CWE-330", "MEDIUM", 0.55, "OPEN"),
    (52, "permissive-file-permissions", "f", 2, "Overly Permissive File Permissions", "CWE-732", "MEDIUM", 0.6, "OPEN"),
    (54, "insecure-temp-file", "f", 2, "Insecure Temporary File", "CWE-377", "MEDIUM", 0.6, "OPEN"),
    (56, "dangerous-sink", "f", 2, "Code Injection", "CWE-94", "CRITICAL", 0.7, "OPEN"),
    (58, "reflected-xss", "f", 3, "Reflected Cross-Site Scripting (XSS)", "CWE-79", "HIGH", 0.8, "OPEN"),
    (60, "sensitive-info-exposure", "f", 3, "Sensitive Information Exposure", "CWE-200", "MEDIUM", 0.75, "OPEN"),
    (62, "ssrf", "f", 3, "Server-Side Request Forgery (SSRF)", "CWE-918", "HIGH", 0.5, "OPEN"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "code_units": code_units, "code_flows": code_flows, "code_scan": code_scan, "fix_verify": fix_verify, "code_rules": code_rules,
}
ORACLES = {
    "code_units": _sql("qualname lineno end_lineno params is_module", UNITS, 6, f"{_LANGUAGE}, {_FILE}"),
    "code_flows": _sql("function lineno type confidence via", FLOWS, 6, _FILE),
    "code_scan": _sql("function lineno matcher_id type cwe severity cvss_score confidence detection_method", FOUND, 6, _FILE),
    "code_rules": _sql("matcher_id function lineno type cwe severity confidence status", RULES, 2 * len(CASES), "'src/r' || c_custkey::VARCHAR"),
    "fix_verify": _sql("function type status note diff", FIXED, 6, _FILE),
}
