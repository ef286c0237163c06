"""Connected components of a link table by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.scratch import Scratch


def _pull(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, other, least): each link beside the smallest neighbour of its first end.

    The minima are written first, so that the join is of two plain shuffles and
    a hub's links can be split over tasks.
    """
    least = scratch.save(links.groupBy("u").agg(F.min("v").alias("least")), name)
    return links.join(least.withColumnRenamed("u", "hub"), F.col("u") == F.col("hub")).select("u", "v", "least")


def _stars(links: DataFrame) -> bool:
    """Whether every node points at one centre only, and no centre points anywhere."""
    more = links.groupBy("u").count().where("count > 1").limit(1)
    chain = links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)
    return more.select("u").unionByName(chain).isEmpty()


def connected_components(links: DataFrame, scratch: Scratch, tag: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is its smallest reachable node.

    `links` has columns u and v. Self-links, nulls, repeats and both directions
    are allowed; an empty table gives an empty one. Links stay in written
    tables: the driver sees one answer a round.
    """
    links = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = scratch.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-0")
    for turn in range(1, most_rounds + 1):
        if _stars(links):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pulled = _pull(both, scratch, f"{tag}-{turn}-large-least")
        large = scratch.save(pulled.where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")), f"{tag}-{turn}-large")
        pulled = _pull(large, scratch, f"{tag}-{turn}-small-least")
        small = pulled.select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()
        links = scratch.save(small, f"{tag}-{turn}")
        scratch.drop(f"{tag}-{turn - 1}", f"{tag}-{turn}-large-least", f"{tag}-{turn}-large", f"{tag}-{turn}-small-least")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
