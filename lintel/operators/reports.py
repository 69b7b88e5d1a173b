"""Reports over findings: compliance, chains, SARIF, audit, severity, accuracy, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.catalog import frameworks as C
from lintel.catalog.weaknesses import SEVERITIES
from lintel.functions.cvss import severity_rank


def requirement_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.requirements(), "framework string, place int, requirement string, cwe string")


def compliance(findings: DataFrame, framework: str = "all") -> DataFrame:
    """framework, requirement, place, findings_count, status of every requirement; framework names in any case."""
    rows = requirement_table(findings.sparkSession)
    wanted = framework.lower().replace("-", "_")
    if wanted != "all":
        rows = rows.where(F.col("framework") == {"pci": "pci_dss"}.get(wanted, wanted))
    counts = findings.groupBy(F.upper(F.coalesce("cwe", F.lit(""))).alias("cwe")).count()
    found = rows.join(counts, "cwe", "left")
    total = found.groupBy("framework", "place", "requirement").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("findings_count"))
    return total.withColumn("status", F.when(F.col("findings_count") > 0, "FAIL").otherwise("PASS"))


def compliance_totals(report: DataFrame) -> DataFrame:
    """Per framework whether any requirement fails, and the findings over its requirements (one may count often)."""
    return report.groupBy("framework").agg(
        F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").otherwise("PASS").alias("overall_status"), F.sum("findings_count").alias("total_findings")
    )


def map_finding(findings: DataFrame) -> DataFrame:
    """findings with an array of requirements for each framework and whether the weakness is in the top list."""
    rows = requirement_table(findings.sparkSession)
    wide = rows.groupBy("cwe").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("framework") == f, F.struct("place", "requirement")))), lambda x: x["requirement"]).alias(f) for f in C.FRAMEWORKS
    ])
    found = findings.withColumn("cwe", F.upper(F.coalesce("cwe", F.lit("")))).join(F.broadcast(wide), "cwe", "left")
    empty = F.array().cast("array<string>")
    found = found.withColumns({f: F.coalesce(f, empty) for f in C.FRAMEWORKS})
    return found.withColumn("is_top_25", F.col("cwe").isin(*C.cwes(C.TOP_25)))


def chains(findings: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Rules all of whose steps have a finding: rule, name, severity and the first finding (ord) of each step."""
    steps = steps if steps is not None else findings.sparkSession.createDataFrame(C.chain_steps(), "rule int, name string, severity string, step int, cwe string")
    first = findings.groupBy(F.upper("cwe").alias("cwe")).agg(F.min_by(F.struct("file", "lineno", "type"), "ord").alias("finding"))
    held = steps.join(first, "cwe", "left").groupBy("rule", "name", "severity").agg(
        F.count("*").alias("n_steps"), F.count("finding").alias("n_held"), F.sort_array(F.collect_list(F.struct("step", "cwe", "finding"))).alias("steps")
    )
    return held.where("n_steps = n_held").select("rule", "name", "severity", "steps")


def severity_counts(findings: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """A column for each severity, zero where there is none."""
    return findings.groupBy(*by).agg(*[F.count_if(F.upper(severity) == s).alias(s.lower()) for s in reversed(SEVERITIES)])


def gate(findings: DataFrame) -> DataFrame:
    """exit_code: 1 if any finding is critical or high."""
    bad = F.coalesce(F.bool_or(F.upper("severity").isin("CRITICAL", "HIGH")), F.lit(False))
    return findings.agg(bad.cast("int").alias("exit_code"))


# Report levels of severities.
def level(severity: Column) -> Column:
    s = F.upper(severity)
    return F.when(s.isin("CRITICAL", "HIGH"), "error").when(s == "MEDIUM", "warning").when(s == "LOW", "note").when(s == "INFO", "none").otherwise("warning")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule for each CWE, numbered in order of first sight: cwe, rule_index, name, level."""
    first = findings.where("coalesce(cwe, '') <> ''").groupBy(F.upper("cwe").alias("cwe")).agg(F.min(F.struct("ord", "name", "severity")).alias("f"))
    # One row a CWE: at most some hundreds, so one task numbers them.
    index = F.row_number().over(Window.orderBy("f.ord")) - 1
    return first.select("cwe", index.alias("rule_index"), F.col("f.name").alias("name"), level(F.col("f.severity")).alias("level"))


def sarif(findings: DataFrame, tool: str = "lintel", version: str = "1.0.0") -> DataFrame:
    """One row with a SARIF 2.1.0 document of findings (ord, cwe, name, severity, file, line, why)."""
    rules = sarif_rules(findings)
    rule = F.struct(F.col("cwe").alias("id"), "name", F.struct(F.col("name").alias("text")).alias("shortDescription"), F.struct("level").alias("defaultConfiguration"))
    all_rules = rules.agg(F.sort_array(F.collect_list(F.struct("rule_index", rule.alias("rule")))).alias("rules"))
    rows = findings.join(F.broadcast(rules.select(F.col("cwe").alias("_cwe"), "rule_index")), F.upper(F.coalesce("cwe", F.lit(""))) == F.col("_cwe"), "left")
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    text = F.concat_ws(" ", "name", "why")
    result = F.struct(F.upper("cwe").alias("ruleId"), F.coalesce("rule_index", F.lit(0)).alias("ruleIndex"), level(F.col("severity")).alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    results = rows.agg(F.sort_array(F.collect_list(F.struct("ord", result.alias("result")))).alias("results"))
    both = all_rules.join(F.broadcast(results))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rules", lambda r: r["rule"]).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("results", lambda r: r["result"]).alias("results"))
    return both.select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def sarif_faults(document: str) -> list[str]:
    """What is missing from a SARIF document; empty if it is valid as far as this engine writes it."""
    import json

    try:
        d = json.loads(document)
    except ValueError:
        return ["not JSON"]
    out = [f"{k} is missing" for k in ("$schema", "version", "runs") if k not in d]
    if d.get("version") != "2.1.0":
        out.append("version is not 2.1.0")
    for run in d.get("runs", []):
        rules = run.get("tool", {}).get("driver", {}).get("rules", [])
        out += [f"result {i} names no rule" for i, r in enumerate(run.get("results", [])) if r.get("ruleIndex", -1) >= max(1, len(rules))]
    return out


def audit_summary(entries: DataFrame) -> DataFrame:
    """Per phase the number of entries and of each action."""
    each = entries.groupBy("phase", "action").count()
    return each.groupBy("phase").agg(
        F.sum("count").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "count")))).alias("actions")
    )


def share(n: Column, of: Column) -> Column:
    """Percent, 0 where there is nothing to divide by."""
    return F.when(of == 0, F.lit(0.0)).otherwise(F.lit(100.0) * n / of)


def accuracy(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """cases (expected, found booleans): tp, fn, fp, tn, precision, recall, f1, fpr in percent."""
    e, f = F.col("expected"), F.col("found")
    grouped = cases.groupBy(*(by or []))
    n = grouped.agg(F.count_if(e & f).alias("tp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & f).alias("fp"), F.count_if(~e & ~f).alias("tn"))
    n = n.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    sum_ = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(sum_ == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / sum_)).withColumn("fpr", share(F.col("fp"), F.col("fp") + F.col("tn")))


def breakdown(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Correct and total by each key on its own, in one pass: key, value, correct, total."""
    cases.createOrReplaceTempView("_cases")
    sets = ", ".join(f"({k})" for k in keys)
    which = " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys)
    value = ", ".join(f"CASE WHEN grouping({k}) = 0 THEN coalesce(cast({k} AS string), '?') END" for k in keys)
    return cases.sparkSession.sql(
        f"SELECT CASE {which} END AS key, coalesce({value}) AS value, count_if(expected = found) AS correct, count(*) AS total "
        f"FROM _cases GROUP BY GROUPING SETS ({sets})"
    )


def document(findings: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One row with the whole report as JSON."""
    rows = findings.agg(F.sort_array(F.collect_list(F.struct(*findings.columns))).alias("findings"))
    about = F.struct(*[F.lit(v).alias(k) for k, v in sorted(meta.items())])
    return rows.select(F.to_json(F.struct(about.alias("meta"), "findings")).alias("document"))


def html_page(findings: DataFrame, title: str = "Findings") -> str:
    """A page of findings in order of severity; the rows are escaped in Spark."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in ("severity", "type", "file", "lineno", "confidence")], F.lit("</tr>"))
    rows = findings.orderBy(severity_rank(F.col("severity")).desc(), F.desc("confidence"), "file", "lineno").select(row.alias("r"))
    body = "\n".join(r["r"] for r in rows.toLocalIterator())
    return f"<!doctype html><title>{title}</title><h1>{title}</h1><table>\n{body}\n</table>\n"
