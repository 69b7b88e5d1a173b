"""Whether a finding stands in code that runs: file role, browser scripts, text, mitigations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import paths
from lintel.functions.code import halved

# Types that need executed, built input; those that mean nothing in a browser; their trigger words.
TEXT_SENSITIVE = {
    "SQL Injection": ("SELECT|INSERT|UPDATE|DELETE|WHERE|FROM|select |where ", r"\b(execute|executemany|query|raw|exec)\s*\(\s*\w"),
    "OS Command Injection": (r"system\(|exec\(|popen\(|Runtime|ProcessBuilder|subprocess|shell_exec|spawn", r"\b(system|popen|exec|spawn|shell_exec|call|run|Popen)\s*\(\s*\w"),
    "Server-Side Template Injection": (r"render_template_string|template\(|from_string|Template", r"\b(render_template_string|from_string|Template)\s*\(\s*\w"),
    "Path Traversal": (r"open\(|readfile|file_get_contents|fopen\(|sendfile|path\.join|os\.path\.join|File\(", r"\b(open|readfile|file_get_contents|fopen|sendfile)\s*\(\s*\w"),
    "Server-Side Request Forgery (SSRF)": (r"requests\.get|requests\.post|urlopen|fetch\(|HttpClient|curl_exec|file_get_contents|axios", r"\b(get|post|urlopen|fetch|request)\s*\(\s*\w"),
    "Insecure Deserialization": (r"pickle\.loads|yaml\.load|unserialize|readObject|Marshal\.load", r"\b(loads|load|unserialize|readObject)\s*\(\s*\w"),
}
SERVER_ONLY = (
    *TEXT_SENSITIVE, "XML External Entity (XXE)", "NoSQL Injection", "LDAP Injection", "XPath Injection", "HTTP Response Splitting / CRLF Injection",
    "Code Injection", "Broken Authorization (client-trusted role)", "Insecure Direct Object Reference (IDOR)", "Missing Authentication on Sensitive Action",
    "Sensitive Action Without Rate Limiting", "Race Condition (TOCTOU)", "Hardcoded Secret / Credential",
)
# Marks of server and of browser scripts.
SERVER_MARKS = (
    r"require\s*\(\s*['\"](?:child_process|fs|fs/promises|net|http|https|http2|dgram|tls|express|koa|fastify|next|nuxt|mysql2?|pg|pg-promise|mongodb"
    r"|mongoose|sequelize|typeorm|prisma|sqlite3|better-sqlite3|tedious|ioredis|redis|dns|cluster|worker_threads|node:[a-z_/]+)['\"]"
    r"|\bfrom\s+['\"](?:child_process|fs|fs/promises|net|http|https|express|koa|fastify|mysql2?|pg|mongodb|mongoose|sequelize|knex|prisma|node:[a-z_/]+)['\"]"
    r"|\bprocess\.(?:argv|env|exit|cwd|binding)\b|\bapp\.(?:get|post|put|delete|patch|use|listen)\s*\(|\brouter\.(?:get|post|put|delete|patch|use)\s*\("
    r"|\b(?:http|net|https|http2)\.createServer\b"
)
BROWSER_MARKS = (
    r"\b(?:document|window|navigator|location\.(?:href|search|hash|pathname)|localStorage|sessionStorage|jQuery|addEventListener|querySelector\w*"
    r"|getElementById|getElementsBy\w+|XMLHttpRequest|customElements|HTMLElement|createElement|tinymce|tinyMCE|MediaElement|Backbone|_\.template|wp\.\w+)\b"
    r"|\$\(\s*['\"#.]"
)
XXE_GUARDS = "libxml_disable_entity_loader|libxml_nonet|php_version_id < 80000|php_version_id < 8|defusedxml|feature_secure_processing"

# What a repaired piece of code shows, by a part of the type: the forms that the rewrites of `fixers` leave.
MITIGATIONS = (
    ("os command injection", r"shlex\.quote\(|escapeshellarg\("),
    ("code injection", r"ast\.literal_eval\("),
    ("use of eval", r"ast\.literal_eval\("),
    ("eval injection", r"ast\.literal_eval\("),
    ("insecure deserialization", r"RestrictedUnpickler|yaml\.safe_load\("),
    ("path traversal", r"os\.path\.basename\(|secure_filename\("),
    ("randomness", r"secrets\.token_|SystemRandom\("),
    ("xss", r"\|\s*e\s*\}\}"),
    ("cross-site scripting", r"\|\s*e\s*\}\}"),
    ("template", r"\|\s*e\s*\}\}"),
)


def browser_script(language: Column, text: Column) -> Column:
    """JavaScript or TypeScript with a mark of the browser and none of a server."""
    return language.isin("javascript", "typescript", "tsx", "jsx") & ~text.rlike(SERVER_MARKS) & text.rlike(BROWSER_MARKS)


def is_text(line: Column) -> Column:
    """A line that holds its trigger only in a comment, a literal or a pattern."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r'"[^"]*"', '""'), r"'[^']*'", "''"), r"`[^`]*`", "``")
    blank = F.regexp_replace(F.regexp_replace(line, r'"[^"]*"', "Q"), r"'[^']*'", "Q")
    comment = F.trim(line).rlike(r"^(#|//|\*|/\*|\"\"\"|'''|--)")
    calls = bare.rlike(r"\b[A-Za-z_]\w*\s*\(\s*[A-Za-z_$]") | bare.rlike(
        r"\.\s*(execute|executemany|query|system|popen|run|read|write|get_var|get_results|get_row|render_template_string|loads|load)\s*\("
    )
    filled = line.rlike(r"f\"[^\"]*\{[^}]+\}|f'[^']*\{[^}]+\}|`[^`]*\$\{[^}]+\}|\"[^\"]*\$\{[^}]+\}|\"[^\"]*#\{[^}]+\}")
    pattern = line.rlike(r"re\.(compile|search|match|findall|sub)\s*\(") | line.rlike(r"(PATTERN|REGEX|_RE|patterns?|signatures?|tokens?|sinks?|hints?)\s*=")
    quotes = F.length(line) - F.length(F.translate(line, "\"'", ""))
    table = line.rlike(r"=\s*[\[\{\(]") & (quotes >= 2) & ~bare.rlike(r"[A-Za-z_]\w*\s*\([A-Za-z_$]")
    built = blank.rlike(r"Q\s*\+\s*[\w$]|[\w$\)]\s*\+\s*Q|Q\s*%\s*[\w(]|Q\s*\.\s*\$?\w|\$?\w\s*\.\s*Q|\.\s*$") | line.rlike(r"\.\s*format\s*\(|f[\"']|\$\{|#\{|[\"'][^\"']*\$\w")
    constant = (quotes > 0) & ~built
    return comment | (~calls & ~filled & (pattern | table | constant))


def evaluate(type_: Column, language: Column, source: Column, role: Column, file_text: Column) -> Column:
    """keep, penalize or drop."""
    sensitive = type_.isin(*TEXT_SENSITIVE)
    sinks, bare = F.lit(False), source
    for literal in (r'"[^"]*"', r"'[^']*'", r"#[^\n]*", r"//[^\n]*"):
        bare = F.regexp_replace(bare, literal, "")
    hits = F.array().cast("array<string>")
    for name, (words, sink) in TEXT_SENSITIVE.items():
        hits = F.when(type_ == name, F.filter(F.split(source, "\n", -1), lambda x: x.rlike(words))).otherwise(hits)  # noqa: B023
        sinks = F.when(type_ == name, bare.rlike(sink)).otherwise(sinks)
    only_text = (F.size(hits) > 0) & F.forall(hits, is_text)
    text = F.coalesce(file_text, F.lit(""))
    return (
        F.when(type_.isin(*SERVER_ONLY) & F.coalesce(browser_script(language, text), F.lit(False)), "drop")
        .when((type_ == "XML External Entity (XXE)") & F.lower(text).rlike(XXE_GUARDS), "drop")
        .when(role.isin("doc", "vendor"), "drop")
        .when(role == "security_tool", F.when(sensitive & sinks, "penalize").otherwise("drop"))
        .when((role == "test") & sensitive, "penalize")
        .when(sensitive & only_text, "drop")
        .otherwise("keep")
    )


def is_mitigated(type_: Column, source: Column) -> Column:
    kind = F.lower(type_)
    return paths.any_of([F.contains(kind, F.lit(part)) & source.rlike("(?i)" + shape) for part, shape in MITIGATIONS])


def apply_context(findings: DataFrame, files: DataFrame, least: float = 0.3) -> DataFrame:
    """findings that stay, penalised ones at half confidence and only from `least` on."""
    text = files.select(F.col("rel_path").alias("file"), F.col("text").alias("_text"))
    judged = findings.join(text.hint("merge"), "file", "left").withColumn(
        "_action", evaluate(F.col("type"), F.col("language"), F.coalesce("source", F.lit("")), paths.role(F.col("file")), F.col("_text"))
    )
    kept = judged.where("_action <> 'drop'").withColumn("confidence", F.when(F.col("_action") == "penalize", halved(F.col("confidence"))).otherwise(F.col("confidence")))
    kept = kept.where(f"_action = 'keep' OR confidence >= {least}").where(~is_mitigated(F.col("type"), F.coalesce("source", F.lit(""))))
    return kept.drop("_text", "_action")
