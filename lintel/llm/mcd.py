"""Quality rules: multivariate outliers by minimum covariance determinant, per language and source.

Only DataFrame functions are used. Statistics of whole texts are transformed to a
vector of five; per group of language and source, concentration steps look for
the share H of its rows whose covariance has the least determinant: distances
from two robust starts choose the rows, their mean and covariance give new
distances, and so on. The start with the smaller determinant wins. Rows far from
the group's centre, by Mahalanobis distance, are rejected.

Groups meet only in sums, covariances and mergeable quantile sketches, so a
source that holds a third of all rows costs what its rows cost. Groups of fewer
than `LEAST` rows use their language's estimate, small languages that of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import WHITE, staged

WORD = f"[^{WHITE}]"
SYMBOLS = "#*$%&|<>"
H = 0.75
STEPS = 12  # at most; a step that moves the log determinants by less than SETTLED a group is the last
SETTLED = 1e-3
LEAST = 100
#: The quantile of chi square with 5 degrees of freedom at 0.999.
CUTOFF = 20.515
#: H over the share of chi square with 7 degrees below its H quantile with 5: makes the covariance of the nearest H of normal rows that of all.
CONSISTENCY = 1.4121
#: Deviations whose squares are added to the covariance, as groups may be constant in a statistic: a share counts from about 5 %, or 1 % of symbols.
FLOORS = (0.1, 0.02, 0.02, 0.05, 0.05)
P = len(FLOORS)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text."""

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def again(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(rows, k)["g"] == x["g"], F.lit(False))
        found = F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def windows(grams: Column) -> Column:
        rows = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(rows, again))

    def of(hashes: Column) -> Column:
        grams = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
        return let(F.slice(grams, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), windows)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_lines and STATISTICS of every whole text; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    counted = docs.select(
        "doc_id", "lang", "source",
        let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.char_length(F.regexp_replace(text, f"[{WHITE}]+", "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
    )
    long = {"n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.d", "n_repeat_words": "w.r"}
    return counted.select("doc_id", "lang", "source", F.col("l.n").alias("n_lines"), *(F.col(c).cast("long").alias(k) for k, c in long.items()))


def transformed() -> list[Column]:
    """The vector that the estimates are of."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]


def _distance(with_floors: bool = True) -> Column:
    """Squared Mahalanobis distance: forward substitution with the Cholesky factor l{i}{j}."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _estimates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Mean, Cholesky factor of the floored covariance and log determinant per key."""
    cov = [F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    found = rows.groupBy(*key).agg(*(F.avg(f"z{i}").alias(f"m{i}") for i in range(P)), *cov)
    for i in range(P):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") * CONSISTENCY + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            found = found.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    logs = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))
    return found.select(*key, *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)), (2 * logs).alias("logdet"))


def _grouped(rows: DataFrame, fitted: Column) -> DataFrame:
    """rows with the group whose estimate they use: (lang, source), its language or all."""
    sizes = rows.groupBy("lang", "source").agg(F.count_if(fitted).alias("n"))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("of_lang"))
    sizes = sizes.alias("s").join(langs.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang"))).select(
        F.col("s.lang").alias("_lang"), F.col("s.source").alias("_source"),
        F.when(F.col("n") >= LEAST, F.to_json(F.struct("s.lang", "s.source"))).when(F.col("of_lang") >= LEAST, F.to_json(F.struct("s.lang"))).otherwise("").alias("group"),
        (F.col("n") >= LEAST).alias("own"), (F.col("of_lang") >= LEAST).alias("by_lang"),
    )
    return rows.join(sizes, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, STATISTICS, base_failed, kept and distance of every row; rows that repeat each count and get the same.

    base_failed: fewer than 50 words, or more than half of them in repeated
    three-word windows. Such rows teach nothing. kept: not base_failed and a
    distance of at most cutoff. Null languages or sources form groups of their
    own; a table without a row to learn from rejects only by the base. Columns
    other than doc_id, text, lang and source are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = statistics(docs).select("*", failed.alias("base_failed"), *(z.alias(f"z{i}") for i, z in enumerate(transformed())))
    rows = staged(rows, "statistics")
    vector = [f"z{i}" for i in range(P)]
    rows = _grouped(rows, ~F.col("base_failed"))
    # A row teaches its own group, and its language and all as far as smaller groups need them.
    json = F.to_json
    levels = F.array(json(F.struct("lang", "source")), json(F.struct("lang")), F.lit(""))
    pool = rows.where("NOT base_failed").select("group", *vector, levels.alias("levels"))
    used = rows.select("group").distinct()
    pool = staged(
        pool.select(*vector, F.explode("levels").alias("g")).join(used, F.col("g") == F.col("group"), "left_semi").withColumnRenamed("g", "group"), "pool"
    )
    key = ["group", "start"]
    quarts = [F.percentile_approx(z, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q{z}") for z in vector]
    starts = pool.join(pool.groupBy("group").agg(*quarts), "group")
    scaled = []
    for z, floor in zip(vector, FLOORS, strict=True):
        q = F.col(f"q{z}")
        scaled.append(F.pow((F.col(z) - q[1]) / F.greatest((q[2] - q[0]) / 1.349, F.lit(floor)), 2))
    first = F.array(sum(scaled[1:], scaled[0]), F.greatest(*scaled))
    rated = starts.select("group", *vector, F.posexplode(first).alias("start", "d"))

    def near(rated: DataFrame, step: int) -> DataFrame:
        # Written, so that the planner knows its size: small, it is broadcast and no group's rows are gathered.
        cut = staged(rated.groupBy(*key).agg(F.percentile_approx("d", F.lit(H), F.lit(1000)).alias("h")), f"cut{step}")
        return rated.join(cut, key)

    before = None
    for step in range(STEPS):
        estimates = staged(_estimates(near(rated, step).where("d <= h"), key), f"estimates{step}")
        # A step never raises a determinant but for the sketches' error; below that error it has converged.
        total, n = estimates.agg(F.coalesce(F.sum("logdet"), F.lit(0.0)), F.count("*")).first()
        if before is not None and abs(before - total) <= SETTLED * n:
            break
        before = total
        rated = pool.join(estimates, "group").select("group", "start", *vector, _distance().alias("d"))
    best = estimates.groupBy("group").agg(F.min_by("start", F.struct("logdet", "start")).alias("best"))
    final = estimates.join(best, "group").where("start = best")
    final = staged(final.drop("start", "best", "logdet"), "final")
    judged = rows.join(final, "group", "left").select("doc_id", *STATISTICS, "base_failed", _distance().alias("distance"))
    return judged.select("doc_id", *STATISTICS, "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "distance")
