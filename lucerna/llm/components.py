"""Connected components of an edge table, by minimum-label propagation with shortcuts.

Every round is a few joins and aggregates on tables in the shared folder; the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import stage, unstage


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that an edge (a, b) has. Loops and repeated edges are fine."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs, f"{tag}-edges")
    for r in range(max_rounds):
        # large star: link each larger neighbour of u to the smallest of u's neighbourhood; small star: the same downwards
        both = pairs.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(pairs.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        fresh = stage(small, f"{tag}-{r}")
        changed = fresh.join(pairs, ["u", "v"], "left_anti").limit(1).count() + pairs.join(fresh, ["u", "v"], "left_anti").limit(1).count()
        unstage(pairs)
        pairs = fresh
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    low = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return low.unionByName(low.select(F.col("component").alias("id"), "component").distinct())
