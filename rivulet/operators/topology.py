"""Lines to a directed network: splitting at stations, dissolving pseudo-nodes, choosing outlets, orienting.

Edges are (edge, from_node, to_node, length); what else they carry stays outside and joins by ``edge``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import network
from rivulet.operators.lineage import cut


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("edge", F.explode(F.array("from_node", "to_node")).alias("node"))


def split_at(edges: DataFrame, stations: DataFrame, margin: float = 0.02) -> DataFrame:
    """(edge, piece, from_node, to_node, length) with each edge cut at its stations (node, edge, ratio), pieces numbered from 1.

    ``node`` names the new node. Stations within ``margin`` of an end cut nothing; ties go by node.
    """
    inner = stations.where((F.col("ratio") > margin) & (F.col("ratio") < 1 - margin)).select("edge", "ratio", F.lit(1).alias("_side"), "node")
    stops = edges.select("edge", F.lit(0.0).alias("ratio"), F.lit(0).alias("_side"), F.col("from_node").alias("node"))
    stops = stops.unionByName(inner.join(edges.select("edge"), "edge", "left_semi")).unionByName(edges.select("edge", F.lit(1.0).alias("ratio"), F.lit(2).alias("_side"), F.col("to_node").alias("node")))
    along = Window.partitionBy("edge").orderBy("_side", "ratio", "node")
    pieces = stops.select("edge", F.row_number().over(along).alias("piece"), F.col("node").alias("from_node"), F.lead("node").over(along).alias("to_node"), (F.lead("ratio").over(along) - F.col("ratio")).alias("_share"))
    return pieces.where("_share is not null").join(edges.select("edge", "length"), "edge").select("edge", "piece", "from_node", "to_node", (F.col("_share") * F.col("length")).alias("length"))


def dissolve(edges: DataFrame, protected: DataFrame) -> DataFrame:
    """Edges with the chains through nodes of two edges made one, but for ``protected`` nodes (node); closed chains go.

    A merged edge has the smallest id of its chain, its ends in ascending order and the summed length. Chains are
    components of edges, so a long one takes logarithmic rounds. Where closed chains went, their nodes are looked at again.
    """
    edges = edges.select("edge", "from_node", "to_node", "length")
    while True:
        degree = _ends(edges).groupBy("node").agg(F.count("*").alias("_n"), F.min("edge").alias("a"), F.max("edge").alias("b"))
        pseudo = cut(degree.where("_n = 2 and a != b").join(protected.select("node"), "node", "left_anti"))
        if pseudo.isEmpty():
            return edges
        chains = network.components(pseudo).select(F.col("id").alias("edge"), F.col("component").alias("_chain"))
        known = cut(edges.join(chains, "edge", "left"))
        merged = known.where("_chain is not null").groupBy("_chain").agg(F.sum("length").alias("length"))
        outer = _ends(known.where("_chain is not null")).join(pseudo.select("node"), "node", "left_anti").join(chains, "edge")
        outer = outer.groupBy("_chain").agg(F.min("node").alias("from_node"), F.max("node").alias("to_node")).where("from_node != to_node")
        made = outer.join(merged, "_chain").select(F.col("_chain").alias("edge"), "from_node", "to_node", "length")
        edges = cut(known.where("_chain is null").drop("_chain").unionByName(made))
        if made.count() == merged.count():
            return edges


def outlets(edges: DataFrame, heights: DataFrame) -> DataFrame:
    """(component, root): the lowest node with one edge, of those with a height (node, z); where no such node has one, an end without a way out by the given directions, then any.

    Components without a node of one edge choose among all their nodes; ties go to the smaller node.
    """
    parts = network.components(edges, "from_node", "to_node").select(F.col("id").alias("node"), "component")
    degree = _ends(edges).groupBy("node").agg((F.count("*") != 1).alias("inner"))
    leaving = edges.select(F.col("from_node").alias("node"), F.lit(True).alias("_out")).distinct()
    rated = parts.join(degree, "node").join(heights.select("node", "z"), "node", "left").join(leaving, "node", "left")
    best = F.struct("inner", F.col("z").isNull().alias("unknown"), "z", F.when(F.col("z").isNull(), F.coalesce("_out", F.lit(False))).alias("out"), "node")
    return rated.groupBy("component").agg(F.min(best).alias("m")).select("component", F.col("m.node").alias("root"))


def orient(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges led towards their component's root (component, root), with ``flipped``; nodes are ranked by breadth.

    An edge between nodes of one breadth, as braids have, keeps its direction. Each round takes one step from the roots,
    so it suits networks whose chains are dissolved.
    """
    near = _ends(edges).withColumnRenamed("node", "a").join(edges.select("edge", "from_node", "to_node"), "edge")
    near = cut(near.select("a", F.when(F.col("a") == F.col("from_node"), F.col("to_node")).otherwise(F.col("from_node")).alias("b")).where("a != b").distinct())
    front = cut(roots.select(F.col("root").alias("node"), F.lit(0).alias("breadth")))
    seen = front
    while not front.isEmpty():
        ahead = front.join(near, front.node == near.a).select(F.col("b").alias("node"), (F.col("breadth") + 1).alias("breadth")).distinct()
        front = cut(ahead.join(seen.select("node"), "node", "left_anti"))
        seen = cut(seen.unionByName(front))
    at = lambda side, name: seen.select(F.col("node").alias(side), F.col("breadth").alias(name))
    rated = edges.join(at("from_node", "_f"), "from_node", "left").join(at("to_node", "_t"), "to_node", "left").withColumn("flipped", F.coalesce(F.col("_f") < F.col("_t"), F.lit(False)))
    start, end = F.when(F.col("flipped"), F.col("to_node")).otherwise(F.col("from_node")), F.when(F.col("flipped"), F.col("from_node")).otherwise(F.col("to_node"))
    return rated.select("edge", start.alias("from_node"), end.alias("to_node"), "length", "flipped")
