"""Connected components of links, for the Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that links lead to, for every node of a link (a, b).

    Each round points every node at the smallest of its neighbours' labels and halves the way to
    the root; links shrink to stars, so rounds grow with the logarithm of the longest path. Only
    counts reach the driver; each round is cut off by a checkpoint in the shared folder.
    """
    shared_dir(links.sparkSession)
    both = links.select("a", "b").filter(F.col("a") != F.col("b"))
    arcs = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    for _ in range(most_rounds):
        # Large star: a node's larger neighbours go to the smallest of its neighbourhood.
        sides = arcs.union(arcs.select("b", "a")).toDF("a", "b")
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of those.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        after = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = after.filter(F.col("a") != F.col("b")).distinct().checkpoint()
        changed = after.exceptAll(arcs).limit(1).count() + arcs.exceptAll(after).limit(1).count()
        arcs = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components are not found in {most_rounds} rounds")
    return arcs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(arcs.select("b", "b").distinct())
