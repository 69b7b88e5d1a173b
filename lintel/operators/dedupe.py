"""Joins and folds between findings: overlap, near duplicates, collapse, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.code import type_words

# Words of a type that don't make two types alike.
COMMON_WORDS = "of in the for a an to use via and".split()


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of_forward(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with the `take` columns of the first right row of the same `by` at or after it.

    One shuffle by key and a sorted window; rows never meet in a range join.
    """
    names = left.columns
    side = left.select(F.col(by), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_left"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("_right"))
    other = right.select(F.col(by), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(side.schema["_left"].dataType).alias("_left"), F.struct(*take).alias("_right"))
    # Seen from the far end the next right row is the last one passed; at equal places right rows come first.
    w = Window.partitionBy(by).orderBy(F.desc("_at"), F.asc("_side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = side.unionByName(other).withColumn("_next", F.last("_right", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_left.*", *[F.col(f"_next.{c}").alias(c) for c in take])


def collapse_matchers(findings: DataFrame) -> DataFrame:
    """Of (type, file, function) groups with several matchers the strongest row; of one matcher all rows.

    Strongest: confidence, then line, then the earlier row (ord).
    """
    key = Window.partitionBy("type", "file", "function")
    best = key.orderBy(F.desc("confidence"), F.desc("lineno"), F.asc("ord"))
    rows = findings.withColumn("_many", F.min("matcher_id").over(key) != F.max("matcher_id").over(key)).withColumn("_rn", F.row_number().over(best))
    return rows.where("NOT _many OR _rn = 1").drop("_many", "_rn")


def fold_same_line(findings: DataFrame, name: str = "type") -> DataFrame:
    """On one line of a file, types that share a word are one finding: in order, the first with a
    greater confidence takes the place of the one it meets. Returns the rows that stay."""
    item = F.struct("ord", "confidence", F.array_except(type_words(F.col(name)), F.array(*[F.lit(w) for w in COMMON_WORDS])).alias("words"))
    at_line = findings.where("lineno > 0").groupBy("file", "lineno").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept_type = "array<struct<ord:bigint,confidence:double,words:array<string>>>"

    def step(kept: Column, x: Column) -> Column:
        meets = F.filter(kept, lambda e: F.arrays_overlap(e["words"], x["words"]))
        first = F.get(meets, F.lit(0))
        rest = F.filter(kept, lambda e: e["ord"] != first["ord"])
        stronger = F.concat(rest, F.array(x))
        return F.when(F.size(meets) == 0, F.concat(kept, F.array(x))).when(x["confidence"] > first["confidence"], stronger).otherwise(kept)

    items = F.transform("items", lambda x: F.struct(x["ord"].cast("bigint").alias("ord"), x["confidence"].cast("double").alias("confidence"), x["words"].alias("words")))
    stay = at_line.select("file", F.explode(F.aggregate(items, F.array().cast(kept_type), step)).alias("e")).select(F.col("file").alias("_file"), F.col("e.ord").alias("_ord"))
    same = (findings["file"] == stay["_file"]) & (findings["ord"] == stay["_ord"])
    return findings.join(stay.hint("merge"), same, "left").where("_ord IS NOT NULL OR lineno <= 0 OR lineno IS NULL").drop("_file", "_ord")


def near(left: DataFrame, right: DataFrame, by: list[str], window: int, same: Column | None = None) -> DataFrame:
    """Pairs l, r of equal keys whose lines are at most `window` apart, or that `same` joins."""
    l, r = left.alias("l"), right.alias("r")
    close = F.abs(F.col("l.lineno") - F.col("r.lineno")) <= window
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in by]
    return l.join(r, [*on, close if same is None else close | same])


def merge_flows(findings: DataFrame, flows: DataFrame, window: int = 6) -> tuple[DataFrame, DataFrame]:
    """Data-flow rows against matcher rows: (findings upgraded where a flow overlaps, flows that are new).

    A flow overlaps the first finding of its type and file that is in its
    function or within `window` lines. ord is one within a file. Two equi joins find
    it, on the function and on each line of the window, with findings reduced to
    the first of each beforehand: a file with many of both costs their sum, not
    their product.
    """
    firsts = lambda c: findings.groupBy("type", "file", c).agg(F.min("ord").alias("hit")).hint("merge")
    flow = flows.select("type", "file", "function", "lineno", "confidence", F.col("ord").alias("flow"))
    around = flow.drop("function").withColumn("lineno", F.explode(F.sequence(F.col("lineno") - window, F.col("lineno") + window)))
    pairs = [x.select("file", "flow", "confidence", "hit") for x in (flow.drop("lineno").join(firsts("function"), ["type", "file", "function"]), around.join(firsts("lineno"), ["type", "file", "lineno"]))]
    first = pairs[0].union(pairs[1]).groupBy("file", "flow").agg(F.min("hit").alias("hit"), F.max("confidence").alias("c"))
    best = first.groupBy(F.col("file").alias("_file"), "hit").agg(F.max("c").alias("c"))
    upgraded = (
        findings.join(best.hint("merge"), (findings["file"] == best["_file"]) & (findings["ord"] == best["hit"]), "left")
        .withColumn("confidence", F.when(F.col("hit").isNotNull(), F.greatest("confidence", "c")).otherwise(F.col("confidence")))
        .withColumn("detection_method", F.when(F.col("hit").isNotNull(), "taint-dataflow").otherwise(F.col("detection_method")))
        .drop("_file", "hit", "c")
    )
    fresh = flows.join(first.hint("merge"), (flows["file"] == first["file"]) & (flows["ord"] == first["flow"]), "left_anti")
    return upgraded, keep_first(fresh, ["type", "file", "function", "lineno"], [F.asc("ord")])


def merge_rules(findings: DataFrame, results: DataFrame, window: int = 3) -> tuple[DataFrame, DataFrame]:
    """External rule results: findings they corroborate, raised to 0.9, and results that are new."""
    number = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d+)", 1)
    alike = (number(F.col("l.cwe")) == number(F.col("r.cwe"))) | (number(F.col("l.cwe")) == "") | (number(F.col("r.cwe")) == "")
    pairs = near(results, findings, ["file"], window).where(alike)
    first = pairs.groupBy(F.col("l.file").alias("_file"), F.col("l.ord").alias("res")).agg(F.min("r.ord").alias("hit"))
    hit = first.select("_file", "hit").distinct()
    raised = (
        findings.join(hit, (findings["file"] == hit["_file"]) & (findings["ord"] == hit["hit"]), "left")
        .withColumn("confidence", F.when(F.col("hit").isNotNull(), F.greatest("confidence", F.lit(0.9))).otherwise(F.col("confidence")))
        .withColumn("detection_method", F.when(F.col("hit").isNotNull() & ~F.contains("detection_method", F.lit("rules")), F.concat("detection_method", F.lit(" + rules"))).otherwise(F.col("detection_method")))
        .drop("_file", "hit")
    )
    return raised, results.join(first, (results["file"] == first["_file"]) & (results["ord"] == first["res"]), "left_anti")


def new_claims(claims: DataFrame, existing: DataFrame, window: int = 3) -> DataFrame:
    """Claims that no existing finding covers: none of the same file and CWE within the window, none on
    the same line whose type shares a word."""
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    words = lambda c: F.array_except(type_words(c), common)
    c, e = claims.alias("c"), existing.alias("e")
    close = (F.col("c.cwe") == F.col("e.cwe")) & (F.abs(F.col("c.lineno") - F.col("e.lineno")) <= window)
    alike = (F.col("c.lineno") == F.col("e.lineno")) & (F.col("e.lineno") > 0) & F.arrays_overlap(words(F.col("c.type")), words(F.col("e.type")))
    return c.join(e, (F.col("c.file") == F.col("e.file")) & (close | alike), "left_anti")


def link_one_to_one(left: DataFrame, right: DataFrame, by: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The nth left row of a key with its nth right row, each used once."""
    l = left.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*left_order)))
    r = right.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*right_order)))
    return l.join(r, [by, "_rn"]).drop("_rn")
