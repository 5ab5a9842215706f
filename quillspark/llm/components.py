"""Connected components by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import forget, saved

#: Far more than twice the binary logarithm of any number of nodes.
ROUNDS = 200


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with v < u after one star step: neighbours are tied to the smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that a hub can be split when it is joined
    least = saved(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "least")
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = tied.where("v < u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.where("low < u").select("u", F.col("low").alias("v")))
    done = saved(out.where("u <> v").distinct(), "components")
    forget(least)
    return done


def connected_components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, component (the smallest node of it) of all nodes that have an edge (u, v).

    Edges of a node with itself count for nothing. Raises if the edges still change after so many rounds.
    """
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    digest = None
    for _ in range(rounds):
        stars = _star(now, True)
        forget(now)
        now = _star(stars, False)
        forget(stars)
        after = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == digest:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        digest = after
    raise RuntimeError(f"components still change after {rounds} rounds")
