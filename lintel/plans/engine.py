"""A whole scan as one plan: files, units, routes, detectors, flows, context, dedupe, severity, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.operators import context, dedupe, detectors, routes, severity, taint, units, verdict
from lintel.sources import files as sources
from lintel.sources.shared import dealt, written

COLUMNS = ("matcher_id", "type", "cwe", "severity", "confidence", "file", "language", "function", "lineno", "end_lineno", "source", "explanation", "detection_method", "status")


def numbered(findings: DataFrame) -> DataFrame:
    """findings with ord, an order by file, line and rule that doesn't depend on partitions.

    Ranks run within a file: a row's ord is only compared with those of its file.
    """
    w = Window.partitionBy("file").orderBy("lineno", "matcher_id", "type", "function")
    return findings.withColumn("ord", F.row_number().over(w).cast("long"))


def linked_units(files: DataFrame, found: DataFrame) -> DataFrame:
    """units with linked: a route of their file leads to them."""
    named = found.select("file", "qualname", "lineno").where("qualname <> '<module>'")
    led = routes.linked(routes.distinct_routes(routes.file_routes(files)), named)
    led = led.where("handler IS NOT NULL").select("file", F.col("handler").alias("qualname")).distinct().withColumn("linked", F.lit(True))
    return found.join(led.hint("merge"), ["file", "qualname"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, their units), each written once to the shared folder in parts for all cores."""
    files = written(dealt(files.select("rel_path", "language", "text"), "rel_path"), "files")
    return files, written(units.extract(files), "units")


def scan(files: DataFrame, enabled: tuple[str, ...] | None = None, with_flows: bool = True) -> DataFrame:
    """Findings of files (rel_path, language, text), with severity, CVSS and verdict.

    Files, units, hits and flows are each written once to the shared folder; what
    follows reads those, so no file is parsed twice. Their joins are merged: such rows
    grow with the input and have few bytes on disk, by which Spark would broadcast them
    through the driver.
    """
    return scan_parsed(*parsed(files), enabled, with_flows)


def scan_parsed(files: DataFrame, found: DataFrame, enabled: tuple[str, ...] | None = None, with_flows: bool = True) -> DataFrame:
    """The scan over what `parsed` gives."""
    hits = detectors.detect(linked_units(files, found), enabled).where("status <> 'ERROR'")
    kept = written(context.apply_context(hits, files), "hits")
    kept = written(dedupe.fold_same_line(dedupe.collapse_matchers(numbered(kept))), "folded")
    if with_flows:
        flows = taint.analyse(files).withColumns({
            "matcher_id": F.lit("taint-engine"), "end_lineno": F.col("lineno"), "detection_method": F.lit("taint-dataflow"), "status": F.lit("OPEN"),
            "explanation": F.concat(F.lit("Untrusted input reaches a sink: "), F.col("via"), F.lit(". "), F.col("source")),
        })
        kept, fresh = dedupe.merge_flows(kept, written(numbered(flows.select(*COLUMNS)), "flows"))
        kept = kept.select(*COLUMNS).unionByName(context.apply_context(fresh.select(*COLUMNS), files))
    # Few bytes and many expressions a row: dealt anew, since the joins above are cut by bytes.
    scored = severity.apply_severity(dealt(kept, "file"))
    judged = verdict.judge(scored.withColumn("evidence", F.lit(None).cast("struct<line:int,source:string,sink:string>")))
    return verdict.confirmed(judged)


def scan_directory(spark: SparkSession, target: str, **options) -> DataFrame:
    return scan(sources.analysable(sources.scan_tree(spark, target)), **options)


def suspicious_units(found: DataFrame, findings: DataFrame) -> DataFrame:
    """Units that read input and act on something sensitive, have a body, and no finding in them."""
    from lintel.catalog.flows import SOURCES

    reads = F.col("source").rlike(r"request|\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER)|req\.(query|body|params|headers|get)|\binput\s*\(|argv")
    for language, pattern in SOURCES.items():
        reads = reads | ((F.col("language") == language) & F.col("source").rlike(pattern))
    acts = F.col("source").rlike(
        r"(?i)\b(exec|eval|system|popen|spawn|query|execute|cursor|open|unlink|remove|rmtree|rename|delete|insert|update|send_?file|redirect|render|deserial|unserialize|pickle|yaml|urlopen"
        r"|curl|fetch|password|passwd|token|secret|auth|admin|grant|role|privile|capab|payment|balance|transfer|refund)\b"
    )
    bodies = found.where(~F.col("is_module") & reads & acts & F.contains("source", F.lit("\n")))
    by_name = bodies.join(findings.select("file", F.col("function").alias("qualname")).distinct(), ["file", "qualname"], "left_anti").alias("u")
    at = findings.select("file", F.col("lineno").alias("line")).alias("f")
    inside = (F.col("u.file") == F.col("f.file")) & F.col("f.line").between(F.col("u.lineno"), F.col("u.end_lineno") + 1)
    return by_name.join(at, inside, "left_anti").orderBy("file", "lineno", "qualname")
