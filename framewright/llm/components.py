"""Connected components of a link table by alternating large-star and small-star joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import discard, small, stored


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Every neighbour of a node above (large) or below it (small) is linked to the node's smallest neighbour; and the table of
    smallest neighbours, which is stored so that a node with very many neighbours can be split in the join."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = both.join(small(lowest), "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), lowest
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), lowest


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` (stored) of every node in ``links(u, v)``; the root is the smallest node that links reach.

    Work by round is in proportion to the links; rounds grow with the logarithm of the longest path. Self-links and repeats do
    nothing. Raises if ``max_rounds`` isn't enough.
    """
    edges = stored(links.where("u <> v").select("u", "v").distinct())
    signature = None
    for _ in range(max_rounds):
        for large in (True, False):
            star, lowest = _star(edges, large)
            before, edges = edges, stored(star)
            discard(before, lowest)
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now := (found["n"], found["h"])) == signature:
            break
        signature = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
    discard(edges)
    return out
