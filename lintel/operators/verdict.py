"""Rulings: verdicts on findings, triage by replies, grounding of claims, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.code import normal_spaces, words

# Words that are found in any program and prove nothing.
STOP_WORDS = (
    "request req response resp res data file files user users query input name names value values val result results id ids path "
    "paths url urls uri get post put patch head the and for with this self that return def var let const function func true false "
    "none null nil from import json str string int num bool dict list obj object key item items type text body form field line code "
    "msg message out tmp buf"
).split()


def distinctive(text: Column) -> Column:
    return F.array_except(words(F.coalesce(text, F.lit(""))), F.array(*[F.lit(w) for w in STOP_WORDS]))


def grounded(code: Column, source: Column, sink: Column, line: Column) -> Column:
    """The cited source and sink have distinctive words in the code, two in all, and a word of the sink
    stands on the cited line or next to it."""
    lines, have = F.split(code, "\n", -1), words(code)
    in_source, in_sink = F.array_intersect(distinctive(source), have), F.array_intersect(distinctive(sink), have)
    around = F.array_join(F.slice(lines, F.greatest(line - 1, F.lit(1)), F.when(line <= 1, 2).otherwise(3)), " ")
    return F.coalesce(
        (F.size(in_source) > 0)
        & (F.size(in_sink) > 0)
        & (F.size(F.array_union(in_source, in_sink)) >= 2)
        & (line >= 1)
        & (line <= F.size(lines))
        & F.arrays_overlap(distinctive(sink), words(around)),
        F.lit(False),
    )


def judge(findings: DataFrame) -> DataFrame:
    """findings (matcher_id, detection_method, status, confidence, source and the nullable evidence
    struct<line, source, sink>) with a verdict struct: ruling, reason, confidence, sources."""
    method, matcher = F.lower(F.coalesce("detection_method", F.lit(""))), F.lower(F.coalesce("matcher_id", F.lit("")))
    rules = (matcher == "rules") | F.contains(method, F.lit("rules"))
    net = matcher == "safety-net"
    engine, evidence = ~rules & ~net, F.col("evidence").isNotNull()
    refuted = F.coalesce(F.col("status") == "LIKELY_FALSE_POSITIVE", F.lit(False))
    ok = grounded(F.coalesce("source", F.lit("")), F.col("evidence.source"), F.col("evidence.sink"), F.col("evidence.line"))
    layers = F.when(net, F.array(F.lit("llm"))).otherwise(
        F.sort_array(F.array_compact(F.array(F.when(engine, "engine"), F.when(rules, "rules"), F.when(evidence, "llm"))))
    )
    dropped = refuted | (net & ~ok)
    reason = (
        F.when(refuted, "ruled safe: sanitiser effective or sink unreachable")
        .when(net & ~ok, "cited source or sink is not in the code")
        .when(net, "claim verified against the code")
        .when(F.contains(method, F.lit("taint")), "untrusted input reaches the sink unsanitised")
        .when(engine, "reachable issue flagged by the engine")
        .otherwise("external rule matched")
    )
    sure = F.least(F.lit(0.99), F.round(F.coalesce("confidence", F.lit(0.5)) + F.lit(0.04) * F.greatest(F.size(layers) - 1, F.lit(0)), 2))
    return findings.withColumn(
        "verdict",
        F.struct(
            F.when(dropped, "dropped").otherwise("confirmed").alias("ruling"), reason.alias("reason"),
            F.when(dropped, F.lit(0.0)).otherwise(sure).alias("confidence"), F.when(dropped, F.array().cast("array<string>")).otherwise(layers).alias("sources"),
        ),
    )


def confirmed(judged: DataFrame) -> DataFrame:
    kept = judged.where("verdict.ruling = 'confirmed'")
    return kept.withColumn("status", F.lit("CONFIRMED")).withColumn("confidence", F.col("verdict.confidence"))


def triage(findings: DataFrame, replies: DataFrame, key: str = "prompt_key") -> DataFrame:
    """findings corrected by replies (key, is_vulnerable, correct_type, correct_cwe, severity, confidence, evidence, explanation).

    A reply without evidence is only noted. Not vulnerable with confidence 0.6 or
    more demotes; else the reply's valid type, CWE, severity and confidence hold.
    """
    r = replies.select(key, F.struct([c for c in replies.columns if c != key]).alias("r"))
    joined = findings.join(r, key, "left")
    grounds = F.col("r.evidence").isNotNull() & (
        (F.coalesce("r.evidence.source", F.lit("")) != "") | (F.coalesce("r.evidence.sink", F.lit("")) != "") | (F.coalesce("r.evidence.line", F.lit(0)) != 0)
    )
    demote = grounds & (F.col("r.is_vulnerable") == F.lit(False)) & (F.coalesce("r.confidence", F.lit(0.0)) >= 0.6)
    relabel = grounds & ~F.coalesce(demote, F.lit(False))
    new_type, new_cwe, new_sev = F.trim(F.coalesce("r.correct_type", F.lit(""))), F.trim(F.coalesce("r.correct_cwe", F.lit(""))), F.upper(F.trim(F.coalesce("r.severity", F.lit(""))))
    pick = lambda ok, new, old: F.when(relabel & ok, new).otherwise(F.col(old))
    return (
        joined.withColumn("note", F.when(F.col("r").isNotNull() & ~F.coalesce(grounds, F.lit(False)), "unverified"))
        .withColumn("type", pick(new_type != "", new_type, "type"))
        .withColumn("cwe", pick(new_cwe.rlike(r"^(?i)CWE-\d{1,5}$"), F.upper(new_cwe), "cwe"))
        .withColumn("severity", pick(new_sev.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), new_sev, "severity"))
        .withColumn("status", F.when(demote, "LIKELY_FALSE_POSITIVE").otherwise(F.col("status")))
        .withColumn(
            "confidence",
            F.when(demote, F.round(F.least("confidence", F.lit(0.2)), 2)).when(relabel & (F.coalesce("r.confidence", F.lit(0.0)) != 0), F.round("r.confidence", 2)).otherwise(F.col("confidence")),
        )
        .drop("r")
    )


# Points of a finding's confidence.
def confidence_points(consensus: Column, anchored: Column, ratio: Column, flow: Column, source: Column, proven: Column, critique_ok: Column) -> dict[str, Column]:
    """The five parts of a score of 100 and their total."""
    parts = {
        "consensus": F.when(consensus >= 3, 30.0).when(consensus == 2, 20.0).otherwise(10.0),
        "anchor": F.when(~anchored, 0.0).when(ratio >= 1.0, 25.0).when(ratio >= 0.9, 22.0).when(ratio >= 0.7, 15.0).otherwise(5.0),
        "taint": F.when(flow & source, 20.0).when(source, 10.0).otherwise(20.0),
        "exploit": F.when(proven, 20.0).otherwise(5.0),
        "critique": F.when(critique_ok, 5.0).otherwise(0.0),
    }
    return parts | {"total": F.least(F.lit(100.0), sum(list(parts.values())[1:], parts["consensus"]))}


def confidence_label(score: Column) -> Column:
    return F.when(score >= 90, "VERY HIGH").when(score >= 75, "HIGH").when(score >= 50, "MEDIUM").when(score >= 25, "LOW").otherwise("VERY LOW")


def anchor(snippets: DataFrame, lines: DataFrame, key: str, least: float = 0.70) -> DataFrame:
    """snippets (key, snippet) each with the line of its file that it cites, and the ratio of lengths.

    lines: key, ln, line. Spaces are normalised. An equal line wins, the first of
    them; else of lines that hold the snippet or are held by it, with lengths at
    least `least` of each other, the shortest, then the first. Snippets that
    nothing matches go.
    """
    s = snippets.withColumn("_t", normal_spaces(F.coalesce("snippet", F.lit("")))).where("_t <> ''")
    n = lines.select(key, "ln", normal_spaces(F.col("line")).alias("_n"))
    n = n.where("_n <> ''")
    held = (F.contains(F.col("_n"), F.col("_t"))) | F.contains(F.col("_t"), F.col("_n"))
    ratio = F.least(F.length("_t"), F.length("_n")) / F.greatest(F.length("_t"), F.length("_n"))
    found = s.join(n, key).where(held & (ratio >= least))
    rank = F.struct(F.when(F.col("_t") == F.col("_n"), 0).otherwise(1).alias("a"), F.length("_n").alias("b"), F.col("ln").alias("c"))
    best = found.groupBy(*snippets.columns).agg(F.min(F.struct(rank.alias("r"), F.col("ln").alias("ln"), ratio.alias("ratio"))).alias("m"))
    return best.select(*snippets.columns, F.col("m.ln").alias("line"), F.col("m.ratio").alias("ratio"))


def sink_on_line(sink: Column, line: Column) -> Column:
    core = F.regexp_extract(F.trim(F.coalesce(sink, F.lit(""))), r"^([^(\s]*)", 1)
    n = normal_spaces(line)
    return (core != "") & (F.contains(n, core) | F.contains(n, normal_spaces(sink)))
