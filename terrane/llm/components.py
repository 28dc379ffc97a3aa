"""Connected components of an edge table by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import staged


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every node of links(a, b). Loops and repeated links are ignored; no links, no rows.

    A round's large star moves each edge (u, v), u > v, to v's least neighbour below it, its small star moves all of u's edges
    to the least of them. The table of least neighbours is written before the join: both sides are plain exchanges then, so a
    node that many edges lead to can be split. Each round is written to the shared folder, so lineage stays short and lost
    executors cost one round at most.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    stamp = _stamp(edges)
    while stamp[0]:
        below = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "below")
        large = edges.join(below.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = staged(large.distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, stamp = stamp, _stamp(edges)
        if before == stamp:
            break
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return leaves.union(edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
