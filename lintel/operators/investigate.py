"""Claims checked against the code, proofs and patches joined to findings, and what is handed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.code import normal_spaces
from lintel.functions.cvss import severity_rank
from lintel.operators.dedupe import keep_first
from lintel.operators.verdict import anchor, sink_on_line

LEAST_RATIO = 0.70


def numbered_lines(files: DataFrame) -> DataFrame:
    """(file, ln, line) of files (rel_path, text)."""
    rows = files.select(F.col("rel_path").alias("file"), F.posexplode(F.split("text", "\r?\n", -1)).alias("at", "line"))
    return rows.select("file", (F.col("at") + 1).alias("ln"), "line")


def validate(claims: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    """claims (claim_id, file, snippet, sink, source, family, claimed_line, ...) with line, accepted and reason.

    The claimed line holds if its text is the snippet's, as far as an anchor asks;
    else the snippet is anchored. The sink must stand on that line. A flow's source
    must stand in the function around it, the outermost unit that holds the line,
    else in the file.
    """
    lines = numbered_lines(files)
    text, snippet = normal_spaces(F.col("line")), normal_spaces(F.coalesce("snippet", F.lit("")))
    alike = F.contains(text, snippet) | F.contains(snippet, text)
    ratio = F.least(F.length(text), F.length(snippet)) / F.greatest(F.length(text), F.length(snippet), F.lit(1))
    claimed = claims.join(lines, "file").where((F.col("ln") == F.col("claimed_line")) & (text != "") & (snippet != "") & alike & (ratio >= LEAST_RATIO))
    claimed = claimed.select("claim_id", F.col("ln").alias("own_line"))
    anchored = anchor(claims.select("claim_id", "file", "snippet"), lines, "file", LEAST_RATIO).select("claim_id", F.col("line").alias("found_line"))
    placed = claims.join(claimed, "claim_id", "left").join(anchored, "claim_id", "left").withColumn("line", F.coalesce("own_line", "found_line"))
    at = lines.select("file", F.col("ln").alias("line"), F.col("line").alias("cited"))
    cited = placed.join(at, ["file", "line"], "left")
    around = units.where("NOT is_module").select(F.col("file").alias("_file"), F.col("lineno").alias("_from"), F.col("end_lineno").alias("_to"), F.col("source").alias("_body"))
    held = cited.select("claim_id", "file", "line").join(around, (F.col("file") == F.col("_file")) & F.col("line").between(F.col("_from"), F.col("_to")))
    body = held.groupBy("claim_id").agg(F.min_by("_body", F.struct("_from", -F.col("_to"))).alias("body"))
    whole = files.select(F.col("rel_path").alias("file"), F.col("text").alias("_text"))
    judged = cited.join(body, "claim_id", "left").join(whole, "file", "left")
    source = F.trim(F.coalesce("source", F.lit("")))
    property_ = F.col("family").isin("property", "broken-mitigation") | (source == "") | (F.upper(source) == "N/A")
    sink_ok = sink_on_line(F.col("sink"), F.coalesce("cited", F.lit("")))
    source_ok = F.contains(normal_spaces(F.coalesce("body", "_text", F.lit(""))), normal_spaces(source))
    reason = (
        F.when(F.col("line").isNull(), "the snippet isn't in the file")
        .when(~sink_ok, "the sink isn't on the cited line")
        .when(F.coalesce(property_, F.lit(False)), "the primitive is on the cited line")
        .when(~source_ok, "the source isn't in the function of the sink")
        .otherwise("the source reaches the cited line's function")
    )
    good = F.col("line").isNotNull() & sink_ok & (F.coalesce(property_, F.lit(False)) | source_ok)
    return judged.select(*claims.columns, F.coalesce("line", F.lit(0)).alias("line"), good.alias("accepted"), reason.alias("reason"))


def to_findings(accepted: DataFrame) -> DataFrame:
    """Accepted claims in the findings' shape; their confidence is a percentage."""
    return accepted.where("accepted").select(
        F.lit("ai-detector").alias("matcher_id"), F.col("name").alias("type"), "cwe", F.upper(F.coalesce("severity", F.lit("MEDIUM"))).alias("severity"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") / 100)).alias("confidence"), "file", "language", F.lit("").alias("function"),
        F.col("line").alias("lineno"), F.col("line").alias("end_lineno"), F.col("snippet").alias("source"), F.col("why").alias("explanation"),
        F.lit("ai").alias("detection_method"), F.lit("CONFIRMED").alias("status"),
    )


def diagnostics(judged: DataFrame) -> DataFrame:
    """raw, accepted and rejected claims of each file, and of all in the row whose file is null."""
    return judged.rollup("file").agg(F.count("*").alias("raw"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def link_proofs(findings: DataFrame, probes: DataFrame) -> DataFrame:
    """findings with the probe (probe_id, type, vulnerable) that proves them: the nth proof of a type goes to
    its nth finding, Python files first, then by confidence."""
    proofs = probes.where("vulnerable").withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy("probe_id"))).select("type", "_n", "probe_id")
    order = Window.partitionBy("type").orderBy(F.when(F.col("language") == "python", 0).otherwise(1), F.desc("confidence"), "file", "lineno")
    linked = findings.withColumn("_n", F.row_number().over(order)).join(proofs, ["type", "_n"], "left").drop("_n")
    proven = F.col("probe_id").isNotNull()
    return (
        linked.withColumn("status", F.when(proven, "CONFIRMED").otherwise(F.col("status")))
        .withColumn("confidence", F.when(proven, F.greatest("confidence", F.lit(0.95))).otherwise(F.col("confidence")))
        .withColumn("detection_method", F.when(proven, F.concat("detection_method", F.lit(" + dynamic"))).otherwise(F.col("detection_method")))
    )


def retarget(flows: DataFrame, units: DataFrame) -> DataFrame:
    """Flows through calls moved to the function that holds the sink."""
    at = units.select("file", F.col("qualname").alias("sink_function"), F.col("lineno").alias("_line"), F.col("source").alias("_source"))
    moved = flows.join(at, ["file", "sink_function"], "left")
    return moved.withColumns({
        "function": F.coalesce(F.when(F.col("_line").isNotNull(), F.col("sink_function")), F.col("function")),
        "lineno": F.coalesce("_line", "lineno"), "source": F.coalesce("_source", "source"),
    }).drop("_line", "_source")


# What makes a file look like the start of a web program: (language, names, marks with points).
ENTRY_MARKS = {
    "python": ("app.py main.py server.py wsgi.py manage.py", 5, ((r"Flask\(__name__\)|FastAPI\(", 5), (r"app\.run\(|uvicorn", 3), ("if __name__", 1))),
    "javascript": ("server.js app.js index.js main.js", 5, ((r"express\(|require\(['\"]express['\"]\)", 5), (r"\.listen\(", 4), (r"createServer\(", 3))),
    "typescript": ("server.ts app.ts index.ts", 5, ((r"express\(|require\(['\"]express['\"]\)", 5), (r"\.listen\(", 4), (r"createServer\(", 3))),
    "php": ("index.php app.php server.php router.php", 5, ((r"\$_(?:GET|POST|REQUEST)", 3), (r"header\(|echo|json_encode\(", 2))),
    "ruby": ("app.rb server.rb config.ru main.rb", 5, (("Sinatra|require 'sinatra'|Rack", 5), (r"get '/|post '/|\.run", 3))),
    "go": ("main.go server.go app.go", 4, (("package main", 3), (r"http\.ListenAndServe|http\.HandleFunc|gin\.", 5))),
}


def entry_points(files: DataFrame) -> DataFrame:
    """Files that look like the start of a program, best first: rel_path, language, score."""
    base, score = F.lower(F.substring_index("rel_path", "/", -1)), F.lit(0)
    for language, (names, points, marks) in ENTRY_MARKS.items():
        own = F.when(base.isin(*names.split()), points).otherwise(0)
        for pattern, value in marks:
            own = own + F.when(F.col("text").rlike(pattern), value).otherwise(0)
        score = F.when(F.col("language") == language, own).otherwise(score)
    return files.select("rel_path", "language", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("rel_path"))


def first_patch(findings: DataFrame, patches: DataFrame) -> DataFrame:
    """findings with the first patch (ord) of their type and file."""
    first = keep_first(patches, ["type", "file"], [F.asc("ord")]).select("type", "file", F.col("status").alias("patch_status"), "diff")
    return findings.join(first, ["type", "file"], "left")


def patch_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.when(F.col("status") == "CONFIRMED", 0).otherwise(1), F.desc("confidence"), "ord")


def request_body(patches: DataFrame) -> str:
    """Text of a change request: what was applied, what is only suggested."""
    counts = {r["status"]: r["n"] for r in patches.groupBy("status").agg(F.count("*").alias("n")).collect()}
    lines = [f"- {r['type']} in `{r['file']}` ({r['function']})" for r in patches.where("status = 'applied'").select("type", "file", "function").orderBy("file", "type", "function").toLocalIterator()]
    return "\n".join([f"Applied {counts.get('applied', 0)}, suggested {counts.get('suggested', 0)}, rejected {counts.get('rejected', 0)}.", "", *lines])


def export_patches(patches: DataFrame, folder: str) -> None:
    """Diffs as text, a folder for each status."""
    patches.where("diff <> ''").select("status", F.concat_ws("\n", F.concat(F.lit("--- "), "file"), "diff").alias("value")).write.mode("overwrite").partitionBy("status").text(folder)


def console(findings: DataFrame, n: int = 50) -> None:
    """Show the gravest findings."""
    ranked: list[Column] = [severity_rank(F.col("severity")).desc(), F.desc("confidence"), F.asc("file"), F.asc("lineno")]
    findings.orderBy(*ranked).select("severity", "type", "file", "lineno", "confidence").show(n, truncate=60)
