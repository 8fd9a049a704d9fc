"""Connected components of a graph given as a table of links, without the driver seeing any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by doubling, and
    contracts the links to the ends. Every component with a link left at least halves, so rounds are logarithmic.
    Only minima are aggregated, so a node with very many links is pre-aggregated before each shuffle.
    """
    left = scratch.table(f"{tag}-links", links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while True:
        k = len(rounds)
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        parent = scratch.table(f"{tag}-{k}-0", parent)
        hop = 0
        while True:
            above = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = parent.join(above, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
            moved = scratch.table(f"{tag}-{k}-{hop + 1}", moved)
            scratch.drop(f"{tag}-{k}-{hop}")
            hop += 1
            parent = moved.select("node", "root")
            if moved.filter("moved").isEmpty():
                break
        rounds.append(parent)
        a, b = parent.select(F.col("node").alias("a"), F.col("root").alias("ra")), parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = left.join(a, "a").join(b, "b").filter("ra <> rb")
        left = scratch.table(f"{tag}-links-{k + 1}", joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if left.isEmpty():
            break
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
