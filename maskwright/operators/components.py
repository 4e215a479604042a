"""Connected components of a link table, by alternating star contractions.

Each round is two aggregations to a minimum (combined map-side) and two joins; the
round count grows with the logarithm of the node count. The link table is written to
the checkpoint folder every round, so lineage stays short and a lost executor repeats
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.lineage import cut


def _is_forest_of_stars(links: DataFrame, keys: list[str]) -> bool:
    """Every node points at one root and no root points anywhere."""
    doubles = links.groupBy(*keys, "u").agg(F.count("*").alias("c")).where("c > 1")
    roots = links.select(*keys, F.col("v").alias("u"))
    chained = links.join(roots, [*keys, "u"], "left_semi")
    return doubles.isEmpty() and chained.isEmpty()


def connected_components(
    links: DataFrame, keys: list[str], node: str = "node", other: str = "root"
) -> DataFrame:
    """``(keys, node, component)`` of every node that has a link; component = lowest node."""
    current = cut(
        links.select(
            *keys, F.greatest(node, other).alias("u"), F.least(node, other).alias("v")
        )
        .where("u <> v")
        .distinct()
    )
    while not _is_forest_of_stars(current, keys):
        both = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = (
            both.where("v > u")
            .join(lowest, [*keys, "u"])
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        down = wide.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        joined = wide.join(down, [*keys, "u"])
        current = cut(
            joined.where("v <> m")
            .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select(*keys, "u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
    members = current.select(*keys, F.col("u").alias(node), F.col("v").alias("component"))
    roots = current.select(*keys, F.col("v").alias(node), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
