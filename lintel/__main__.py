"""Scan a folder: python -m lintel --target DIR [--sarif FILE] [--json FILE] [--html FILE] [--compliance FRAMEWORK]."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from lintel.operators import investigate, reports
from lintel.plans import engine
from lintel.sources.shared import written


def arguments() -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lintel", description="Analyse source code as tables.")
    p.add_argument("--target", required=True)
    p.add_argument("--rules", nargs="*", help="only these rules")
    p.add_argument("--no-flows", action="store_true", help="leave the data-flow analysis out")
    p.add_argument("--min-confidence", type=float, default=0.0)
    p.add_argument("--json")
    p.add_argument("--sarif")
    p.add_argument("--html")
    p.add_argument("--compliance", help="all, OWASP, PCI-DSS, NIST or ISO")
    p.add_argument("--gate", action="store_true", help="exit 1 if a finding is critical or high")
    return p.parse_args()


def main() -> int:
    a = arguments()
    spark = SparkSession.builder.appName("lintel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    found = engine.scan_directory(spark, a.target, enabled=tuple(a.rules) if a.rules else None, with_flows=not a.no_flows)
    found = written(found.where(F.col("confidence") >= a.min_confidence), "findings")
    investigate.console(found)
    shown = found.withColumn("ord", F.row_number().over(Window.orderBy("file", "lineno", "matcher_id", "type", "function"))).select("ord", "cwe", F.col("type").alias("name"), "severity", "file", F.col("lineno").alias("line"), F.col("explanation").alias("why"))
    if a.json:
        Path(a.json).write_text(reports.document(found.select("file", "lineno", "type", "cwe", "severity", "confidence", "explanation"), {"target": a.target}).first()["document"])
    if a.sarif:
        Path(a.sarif).write_text(reports.sarif(shown).first()["document"])
    if a.html:
        Path(a.html).write_text(reports.html_page(found))
    if a.compliance:
        reports.compliance(shown, a.compliance).orderBy("framework", "place").show(100, truncate=False)
    code = reports.gate(found).first()["exit_code"] if a.gate else 0
    spark.stop()
    return code


if __name__ == "__main__":
    raise SystemExit(main())
