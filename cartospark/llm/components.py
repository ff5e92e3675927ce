"""Connected components of a link table, without collecting it.

Alternating large-star and small-star steps: every step is one grouped minimum and one join on the
node, so a hub with very many links is an aggregation with map-side combine, not a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .store import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node of the component.

    Loops and repeated edges are harmless; nodes without an edge to another node don't appear.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links, sums = _kept(links, scratch, f"{name}0")
    step, before = 0, None
    while sums != before and sums[0]:
        step, before = step + 1, sums
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        down = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        links, sums = _kept(small.union(least.select("a", F.col("m").alias("b"))).distinct(), scratch, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _kept(links: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, tuple]:
    """The written links, with their number and hash, which a step that changes nothing leaves as they are."""
    seen = Observation()
    kept = scratch.keep(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), name)
    return kept, (seen.get["n"], seen.get["h"])
