"""One ranked list from several layers: leader clustering with a consensus boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.cvss import severity_rank

WINDOW = 3
UNIFIED = ("file", "line", "cwe", "name", "severity", "confidence", "layer")


def from_matcher(findings: DataFrame) -> DataFrame:
    return _unified(findings, "type", "lineno", F.coalesce("confidence", F.lit(0.5)), "matcher")


def from_flow(flows: DataFrame) -> DataFrame:
    return _unified(flows, "type", "lineno", F.coalesce("confidence", F.lit(0.7)), "taint")


def from_claims(claims: DataFrame) -> DataFrame:
    """Claims give their confidence in percent."""
    return _unified(claims, "name", "line", F.coalesce(F.col("confidence").cast("double"), F.lit(70.0)) / 100, "ai")


def _unified(rows: DataFrame, name: str, line: str, confidence: Column, layer: str) -> DataFrame:
    return rows.select(
        "file", F.coalesce(line, F.lit(0)).alias("line"), F.upper(F.coalesce("cwe", F.lit(""))).alias("cwe"), F.coalesce(name, F.lit("")).alias("name"),
        F.upper(F.coalesce("severity", F.lit("MEDIUM"))).alias("severity"), confidence.alias("confidence"), F.lit(layer).alias("layer"), "ord",
    )


def merge_layers(rows: DataFrame, window: int = WINDOW, compounding: bool = False) -> DataFrame:
    """Rows (UNIFIED and ord, the input order) merged within (file, cwe).

    In order, a row joins the first cluster whose leader is within `window`
    lines, else it leads one; rows without cwe never cluster. A cluster has its
    leader's line, the most confident row's name, the greatest severity, its
    layers in order, and 0.10 more confidence for each layer beyond the first, up
    to 1; with compounding that is added again at every merge.
    """
    item = F.struct(
        F.col("ord").cast("bigint").alias("ord"), F.col("line").cast("bigint").alias("line"), "name", severity_rank(F.col("severity")).alias("rank"),
        "severity", F.col("confidence").cast("double").alias("confidence"), "layer",
    )
    alone = F.when(F.col("cwe") == "", F.col("ord").cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    groups = rows.groupBy("file", "cwe", alone.alias("_alone")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    shape = "array<struct<line:bigint,name:string,rank:int,severity:string,confidence:double,layers:array<string>,n:bigint>>"

    def lead(x: Column) -> Column:
        return F.struct(x["line"].alias("line"), x["name"].alias("name"), x["rank"].alias("rank"), x["severity"].alias("severity"), x["confidence"].alias("confidence"), F.array(x["layer"]).alias("layers"), F.lit(1).cast("bigint").alias("n"))

    def join(g: Column, x: Column) -> Column:
        stronger = x["confidence"] > g["confidence"]
        layers = F.array_union(g["layers"], F.array(x["layer"]))
        top = F.greatest(g["confidence"], x["confidence"])
        boost = F.when(F.size(layers) >= 2, F.lit(0.1) * (F.size(layers) - 1)).otherwise(F.lit(0.0))
        kept = F.when(F.size(layers) >= 2, F.least(F.lit(1.0), top + boost)).otherwise(g["confidence"]) if compounding else top
        # The stronger row's severity holds, unless the other's is greater.
        base_rank = F.when(stronger, x["rank"]).otherwise(g["rank"])
        base = F.when(stronger, x["severity"]).otherwise(g["severity"])
        return F.struct(
            g["line"].alias("line"), F.when(stronger, x["name"]).otherwise(g["name"]).alias("name"), F.greatest(base_rank, x["rank"]).alias("rank"),
            F.when(x["rank"] > base_rank, x["severity"]).otherwise(base).alias("severity"), kept.alias("confidence"), layers.alias("layers"), (g["n"] + 1).alias("n"),
        )

    def step(clusters: Column, x: Column) -> Column:
        places = F.filter(F.transform(clusters, lambda g, i: F.when(F.abs(g["line"] - x["line"]) <= window, i)), lambda i: i.isNotNull())
        hit = F.get(places, F.lit(0))
        return F.when(hit.isNull(), F.concat(clusters, F.array(lead(x)))).otherwise(F.transform(clusters, lambda g, i: F.when(i == hit, join(g, x)).otherwise(g)))

    folded = groups.select("file", "cwe", F.explode(F.aggregate("items", F.array().cast(shape), step)).alias("g"))
    boost = F.lit(0.0) if compounding else F.lit(0.1) * (F.size("g.layers") - 1)
    return folded.select(
        "file", F.col("g.line").alias("line"), "cwe", F.col("g.name").alias("name"), F.col("g.severity").alias("severity"),
        F.least(F.lit(1.0), F.col("g.confidence") + boost).alias("confidence"), F.col("g.layers").alias("sources"),
        F.size("g.layers").alias("consensus_count"), F.col("g.n").alias("n_merged"),
    )


def ranked(merged: DataFrame) -> DataFrame:
    return merged.orderBy(severity_rank(F.col("severity")).desc(), F.desc("confidence"), "file", "line")


def agreement(rows: DataFrame, key: list[str]) -> DataFrame:
    """Distinct layers per key; two or more raise the confidence by 0.10, up to 0.99."""
    found = rows.groupBy(*key).agg(F.sort_array(F.collect_set("layer")).alias("layers"), F.max("confidence").alias("base"))
    many = F.size("layers") >= 2
    return found.withColumn("cross_validated", many).withColumn("confidence", F.when(many, F.least(F.lit(0.99), F.round(F.col("base") + 0.1, 2))).otherwise(F.col("base")))
