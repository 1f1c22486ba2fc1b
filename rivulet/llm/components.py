"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import Scratch, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the links, label being the smallest node that it can reach.

    Both star steps take minima per node (pre-aggregated before the shuffle) and join them back; links never leave the
    executors. Every step is written as a table, which cuts the lineage. Ends when the links stand still.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.table(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
        mark = _mark(edges)
        while mark[0]:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v")
            edges = scratch.table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
            before, mark = mark, _mark(edges)
            if before == mark:
                break
        return materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them that changes when they do."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
    return row[0], row[1]
