"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed: each step is a grouped minimum (combined before its shuffle) and a join
that adaptive execution can split, so a hub with very many links loads no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, staged


def _minimum(links: DataFrame) -> DataFrame:
    return staged(links.groupBy("u").agg(F.min("v").alias("m")), "least")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node it reaches.

    links: pairs of bigint ids in either order; repeats, self-links and nulls are allowed (a null
    links nothing). An empty table gives an empty one. The rounds grow with the logarithm of the
    longest chain; beyond most_rounds a RuntimeError is raised rather than a wrong result returned.
    """
    edges = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "links",
    )
    mark = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _minimum(both.select("u", F.least("u", "v").alias("v")))
        large = staged(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        dropped(least, edges)
        least = _minimum(large)
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(least, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
