"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import workspace

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(workspace.shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these. Edges lead from larger to smaller nodes."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(workspace.shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars already: every u has one smaller v, and no v is a u."""
    counts = edges.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d"), F.coalesce(F.every(F.col("v") < F.col("u")), F.lit(True)).alias("down")).first()
    if counts["n"] != counts["d"] or not counts["down"]:
        return False
    return edges.select(F.col("v").alias("u")).join(workspace.shuffled(edges.select("u")), "u", "left_semi").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v) that is not the least of its component; root is the least.

    Minima are combined before each shuffle, and a node with very many neighbours is a side of plain
    joins that Spark can split. Each round is written to the shared folder; rounds end when the edges
    are stars (logarithmic in the longest chain). Self-loops and null ends are dropped, no edges give
    no rows.
    """
    least, most = F.least("u", "v"), F.greatest("u", "v")
    now = workspace.materialize(edges.where(F.col("u") != F.col("v")).select(most.alias("u"), least.alias("v")).distinct(), "components")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = workspace.materialize(_small_star(_large_star(now)), "components")
    raise RuntimeError("components did not settle")
