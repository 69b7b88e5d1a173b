"""CVSS 3.1 base scores as column arithmetic, exact to the published rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.catalog.weaknesses import METRICS, WEIGHTS


def _weight(table: str, code: Column) -> Column:
    found = F.lit(None).cast("double")
    for k, v in WEIGHTS[table].items():
        found = F.when(code == k, F.lit(v)).otherwise(found)
    return found


def base_score(code: dict[str, Column]) -> Column:
    """Score of a vector given as a column for each metric."""
    changed = code["S"] == "C"
    lost = [F.lit(1.0) - _weight("CIA", code[m]) for m in "CIA"]
    iss = F.lit(1.0) - lost[0] * lost[1] * lost[2]
    impact = F.when(changed, F.lit(7.52) * (iss - F.lit(0.029)) - F.lit(3.25) * F.pow(iss - F.lit(0.02), F.lit(15.0))).otherwise(F.lit(6.42) * iss)
    needs = F.when(changed, _weight("PR_C", code["PR"])).otherwise(_weight("PR_U", code["PR"]))
    ease = F.lit(8.22) * _weight("AV", code["AV"]) * _weight("AC", code["AC"]) * needs * _weight("UI", code["UI"])
    total = F.least(F.when(changed, F.lit(1.08) * (impact + ease)).otherwise(impact + ease), F.lit(10.0))
    return F.when(impact <= 0, F.lit(0.0)).otherwise(round_up(total))


def round_up(x: Column) -> Column:
    """Up to one decimal, on whole hundred-thousandths."""
    n = F.rint(x * 100000).cast("bigint")
    return F.when(n % 10000 == 0, n / F.lit(100000.0)).otherwise((F.floor(n / F.lit(10000.0)) + 1) / F.lit(10.0))


def rating(score: Column) -> Column:
    return (
        F.when(score <= 0, "INFO").when(score < 4, "LOW").when(score < 7, "MEDIUM").when(score < 9, "HIGH").otherwise("CRITICAL")
    )


def vector_string(code: dict[str, Column]) -> Column:
    return F.concat(F.lit("CVSS:3.1"), *[F.concat(F.lit(f"/{m}:"), code[m]) for m in METRICS])


def severity_rank(severity: Column) -> Column:
    """CRITICAL 4 to INFO 0; unknown 0."""
    s = F.upper(severity)
    return F.when(s == "CRITICAL", 4).when(s == "HIGH", 3).when(s == "MEDIUM", 2).when(s == "LOW", 1).otherwise(0)
