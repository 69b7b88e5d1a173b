"""Claims from model replies and other outside results, made rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.code import lenient_json, normal_spaces
from lintel.functions.cvss import severity_rank
from lintel.operators.dedupe import keep_first

_ITEM = (
    "struct<name:string,cwe:string,severity:string,confidence:string,snippet:string,source:string,sink:string,why:string,"
    "fix:string,impact:string,category:string,family:string,line:string,data_flow:array<string>,"
    "exploit:struct<type:string,payload:string,expected:string>>"
)


def normal_cwe(raw: Column) -> Column:
    digits = F.regexp_replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), r"CWE|[-_ ]", "")
    return F.when(digits.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), digits)).otherwise("")


def normal_severity(raw: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(s.isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), s).otherwise("MEDIUM")


def percent(raw: Column) -> Column:
    n = F.rint(raw.try_cast("double"))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), n)), F.lit(70.0)).cast("int")


def fingerprint(file: Column, snippet: Column, sink: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", file, normal_spaces(snippet), sink)), 1, 16)


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies (file, language, pass, reply) to claims, one row each; replies that don't parse give none.

    A claim needs a name, a severity, a snippet and a sink.
    """
    json = lenient_json(F.col("reply"))
    items = F.from_json(json, f"struct<findings:array<{_ITEM}>>")["findings"]
    rows = replies.select("file", "language", "pass", F.posexplode(items).alias("place", "c")).select("file", "language", "pass", "place", "c.*")
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    rows = rows.where(filled("name") & filled("severity") & filled("snippet") & filled("sink"))
    kind = F.lower(F.trim(F.coalesce("exploit.type", F.lit("none"))))
    return rows.select(
        "file", "language", "pass", "place", F.trim("name").alias("name"), normal_cwe(F.col("cwe")).alias("cwe"), normal_severity(F.col("severity")).alias("severity"),
        percent(F.col("confidence")).alias("confidence"), "snippet", F.trim(F.coalesce("source", F.lit(""))).alias("source"), F.trim("sink").alias("sink"),
        F.trim(F.coalesce("why", F.lit(""))).alias("why"), F.trim(F.coalesce("fix", F.lit(""))).alias("fix"), F.trim(F.coalesce("family", F.lit(""))).alias("family"),
        F.greatest(F.coalesce(F.col("line").try_cast("int"), F.lit(0)), F.lit(0)).alias("claimed_line"),
        F.filter(F.coalesce("data_flow", F.array().cast("array<string>")), lambda x: F.trim(x) != "").alias("data_flow"),
        F.when(kind.isin("http", "function"), kind).otherwise("none").alias("exploit_type"),
        fingerprint(F.col("file"), F.col("snippet"), F.col("sink")).alias("fingerprint"),
    )


def consensus(claims: DataFrame, n_passes: int) -> DataFrame:
    """Claims of several passes as one per fingerprint, the first pass' foremost.

    Found in every pass a first-pass claim gains 15, in two or more 5, up to 100.
    """
    passes = claims.groupBy("file", "fingerprint").agg(F.count_distinct("pass").alias("n_passes"))
    boost = F.when((F.col("pass") != 1) | (F.col("n_passes") < 2), 0).when(F.col("n_passes") == n_passes, 15).otherwise(5)
    if n_passes < 2:
        boost = F.lit(0)
    boosted = claims.join(passes, ["file", "fingerprint"]).withColumn("confidence", F.least(F.lit(100), F.col("confidence") + boost)).withColumn("consensus", F.col("n_passes") >= 2)
    # Pass-1 claims all stand; of others the first of a fingerprint that no earlier pass has.
    first = boosted.groupBy("file", "fingerprint").agg(F.min("pass").alias("_first"))
    stands = boosted.join(first, ["file", "fingerprint"]).where("pass = _first").drop("_first")
    return keep_first(stands, ["file", "fingerprint"], [F.desc("confidence"), F.asc("pass"), F.asc("place")])


def in_order(claims: DataFrame) -> DataFrame:
    return claims.orderBy(severity_rank(F.col("severity")).desc(), F.desc("confidence"), "name", normal_spaces(F.col("snippet")))


def rule_results(raw: DataFrame) -> DataFrame:
    """Rule-scanner results (path, line, check_id, severity, message, cwe_raw) in the findings' shape."""
    given = F.coalesce("cwe_raw", F.lit(""))
    cwe = F.upper(F.regexp_extract(given, r"(?i)(CWE-\d{1,5})", 1))
    named = F.trim(F.regexp_extract(given, r"^[^:]*:(.*)", 1))
    rule = F.initcap(F.translate(F.substring_index("check_id", ".", -1), "-_", "  "))
    type_ = F.when(named != "", named).when(rule != "", rule).otherwise("Rule Finding")
    level = F.upper(F.coalesce("severity", F.lit("")))
    return raw.select(
        F.col("path").alias("file"), F.coalesce("line", F.lit(0)).alias("lineno"), type_.alias("type"), F.when(cwe != "", cwe).otherwise("CWE-1035").alias("cwe"),
        F.when(level == "ERROR", "HIGH").when(level == "INFO", "LOW").otherwise("MEDIUM").alias("severity"),
        F.when(F.trim(F.coalesce("message", F.lit(""))) != "", F.trim("message")).otherwise(type_).alias("message"), "check_id", F.lit(0.6).alias("confidence"),
    )


_VULN = "array<struct<title:string,fixed_in:string,references:struct<cve:array<string>,url:array<string>>>>"
_PART = f"struct<version:struct<number:string>,vulnerabilities:{_VULN}>"


def component_vulnerabilities(reports: DataFrame) -> DataFrame:
    """Site reports (url, report) to rows of known vulnerabilities of core, plugins and themes."""
    shape = f"struct<version:struct<number:string,vulnerabilities:{_VULN}>,plugins:map<string,{_PART}>,themes:map<string,{_PART}>>"
    r = reports.select("url", F.from_json("report", shape).alias("r"))
    core = r.select("url", F.lit("core").alias("kind"), F.trim(F.concat(F.lit("core "), F.coalesce("r.version.number", F.lit("")))).alias("component"), F.explode("r.version.vulnerabilities").alias("v"))
    rows = core
    for kind in ("plugin", "theme"):
        parts = r.select("url", F.explode(f"r.{kind}s").alias("name", "p"))
        label = F.trim(F.concat(F.lit(f"{kind}: "), F.col("name"), F.lit(" "), F.coalesce("p.version.number", F.lit(""))))
        rows = rows.unionByName(parts.select("url", F.lit(kind).alias("kind"), label.alias("component"), F.explode("p.vulnerabilities").alias("v")))
    cve = F.transform(F.coalesce("v.references.cve", F.array().cast("array<string>")), lambda c: F.when(F.upper(c).startswith("CVE-"), c).otherwise(F.concat(F.lit("CVE-"), c)))
    return rows.select("url", "kind", "component", F.coalesce("v.title", F.lit("Known vulnerability")).alias("title"), "v.fixed_in", cve.alias("cves"), F.slice(F.coalesce("v.references.url", F.array().cast("array<string>")), 1, 5).alias("links"))


def enrichment(raw: DataFrame) -> DataFrame:
    """Weakness texts (cwe, mitre, nvd as JSON) flattened: five mitigations, eight relatives, the highest score."""
    mitre = F.from_json("mitre", "struct<Weaknesses:array<struct<Name:string,Description:string,PotentialMitigations:array<struct<Description:string>>,RelatedWeaknesses:array<struct<CweID:string,Nature:string>>>>>")
    metric = "array<struct<cvssData:struct<baseScore:double,vectorString:string>>>"
    nvd = F.from_json("nvd", f"struct<vulnerabilities:array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:{metric},cvssMetricV30:{metric},cvssMetricV2:{metric}>>>>>")
    w = F.get(mitre["Weaknesses"], F.lit(0))
    score = lambda c: F.coalesce(*[F.get(c["metrics"][k], F.lit(0))["cvssData"]["baseScore"] for k in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    cves = F.transform(nvd["vulnerabilities"], lambda v: F.struct(v["cve"]["id"].alias("id"), F.substring(F.coalesce(F.get(F.filter(v["cve"]["descriptions"], lambda d: d["lang"] == "en"), F.lit(0))["value"], F.lit("")), 1, 200).alias("summary"), score(v["cve"]).alias("cvss")))
    fixes = F.filter(F.transform(w["PotentialMitigations"], lambda m: F.substring(F.trim(m["Description"]), 1, 300)), lambda t: t != "")
    kin = F.transform(F.filter(w["RelatedWeaknesses"], lambda x: x["CweID"].isNotNull()), lambda x: F.concat(F.lit("CWE-"), x["CweID"], F.coalesce(F.concat(F.lit(" ("), x["Nature"], F.lit(")")), F.lit(""))))
    return raw.select("cwe", w["Name"].alias("name"), w["Description"].alias("description"), F.slice(fixes, 1, 5).alias("mitigations"), F.slice(kin, 1, 8).alias("related_weaknesses"), cves.alias("similar_cves"), F.array_max(F.transform(cves, lambda c: c["cvss"])).alias("cvss"))


def suppress(findings: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """findings without false positives, and how many each pattern (id, file_pattern, cwe, snippet_substring) suppressed.

    The first pattern by id that matches is credited.
    """
    f, p = findings.alias("f"), patterns.alias("p")
    on = (
        (F.upper(F.coalesce("f.cwe", F.lit(""))) == F.upper("p.cwe"))
        & F.expr("f.file rlike concat('(?i)', p.file_pattern)")
        & ((F.coalesce("p.snippet_substring", F.lit("")) == "") | F.contains(F.lower(F.coalesce("f.source", F.lit(""))), F.lower("p.snippet_substring")))
    )
    hit = f.join(p, on).groupBy("f.ord").agg(F.min("p.id").alias("id"))
    counts = hit.groupBy("id").agg(F.count("*").alias("suppressions"))
    return findings.join(hit, "ord", "left_anti"), patterns.join(counts, "id", "left").withColumn("suppressions", F.coalesce("suppressions", F.lit(0)))


def to_scan(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose content has no result yet: an anti join on the content's hash."""
    return files.withColumn("sha", F.sha2("text", 256)).join(done.select("sha"), "sha", "left_anti")


def batch_totals(per_file: DataFrame) -> DataFrame:
    """per_file (n_findings, cached, error): completed, failed, skipped, findings."""
    return per_file.agg(
        F.count("*").alias("completed"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.col("error").isNull() & F.col("cached")).alias("skipped"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("findings"),
    )
