"""Reachability over call graphs: a fixpoint of joins that doubles its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.sources.shared import written

ROUNDS = 64


def reach(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(qual, cls): the classes that each caller reaches through edges (caller, callee) from seeds (qual, cls).

    Round k follows the pairs that are exactly 2 ** k calls apart, so a chain of n
    calls takes log n rounds and no closure of pairs is held. It ends when a round
    finds nothing new: then no class is further away. Raises if `rounds` aren't enough.
    """
    known = written(seeds.distinct(), "reach")
    apart = written(edges.distinct(), "apart")
    size = known.count()
    for _ in range(rounds):
        found = known.join(apart, known["qual"] == apart["callee"]).select(F.col("caller").alias("qual"), "cls")
        known = written(known.union(found).distinct(), "reach")
        before, size = size, known.count()
        if size == before:
            return known
        left, right = apart.select("caller", F.col("callee").alias("mid")), apart.select(F.col("caller").alias("mid"), "callee")
        apart = written(left.join(right, "mid").select("caller", "callee").distinct(), "apart")
    raise RuntimeError(f"the call graph needs more than {rounds} rounds")
