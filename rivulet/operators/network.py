"""River networks and other forests: closures, orders, components and main stems.

A forest is (id, parent), parent null at outlets. Closures double the reach of pointers, so their number of joins is the
logarithm of the depth.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.lineage import cut, shuffled


def _jumped(pointers: DataFrame) -> DataFrame:
    """(id, up) reaching twice as far; pointers beyond an outlet are null."""
    up = pointers.select(F.col("id").alias("up"), F.col("up").alias("_far"))
    return pointers.join(shuffled(up), "up", "left").select("id", F.col("_far").alias("up"))


def _any_left(pointers: DataFrame) -> bool:
    return not pointers.where("up is not null").isEmpty()


def levels(forest: DataFrame) -> DataFrame:
    """(id, level): steps to the outlet, 0 at outlets. Nodes on a cycle would never end, so more than 2**40 steps are an error."""
    at = cut(forest.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")))
    for _ in range(40):
        if not _any_left(at):
            return at.select("id", "level")
        beyond = at.select(F.col("id").alias("up"), F.col("up").alias("_far"), F.col("level").alias("_more"))
        at = cut(at.join(beyond, "up", "left").select("id", F.col("_far").alias("up"), (F.col("level") + F.coalesce("_more", F.lit(0))).alias("level")))
    raise ValueError("the forest has a cycle")


def _summed_as(rows: DataFrame, values: list[str]) -> dict[str, str]:
    """The decimals in which those of ``values`` that are doubles are summed, so that equal totals come out equal in whatever order they are added.

    37 digits from the largest total down keep all 17 digits of a number down to a 10**19th of it. Doubles stay doubles
    where some are not finite or the total is out of bounds.
    """
    doubles = [v for v in values if rows.schema[v].dataType.simpleString() == "double"]
    if not doubles:
        return {}
    whole = rows.agg(*[F.sum(F.abs(v)).alias(v) for v in doubles]).head()
    return {v: f"decimal(37,{min(37, 36 - math.ceil(math.log10(whole[v])))})" for v in doubles if 1e-12 < (whole[v] or 0) < 1e30}


def upstream_sums(forest: DataFrame, values: list[str]) -> DataFrame:
    """(id, values...): sums over each node and all that drain to it; those of doubles are exact but for a last rounding (``_summed_as``).

    After k rounds a node has the sum of what is less than 2**k steps above it; the nodes exactly 2**k above bring the next part.
    """
    at = cut(forest.select("id", F.col("parent").alias("up"), *values))
    types = _summed_as(at, values)
    typed = lambda v, c: c.cast(types[v]) if v in types else c
    at = at.select("id", "up", *[typed(v, F.col(v)).alias(v) for v in values])
    for _ in range(40):
        if not _any_left(at):
            return at.select("id", *[(F.col(v).cast("double") if v in types else F.col(v)).alias(v) for v in values])
        brought = at.where("up is not null").groupBy(F.col("up").alias("id")).agg(*[typed(v, F.sum(v)).alias(f"_{v}") for v in values])
        far = _jumped(at.select("id", "up"))
        sums = at.drop("up").join(shuffled(brought), "id", "left").select("id", *[typed(v, F.col(v) + F.coalesce(f"_{v}", typed(v, F.lit(0)))).alias(v) for v in values])
        at = cut(sums.join(shuffled(far), "id"))
    raise ValueError("the forest has a cycle")


def first_marked(forest: DataFrame, marked: str) -> DataFrame:
    """(id, mark): the first node at or below each that is marked; null where none is. Marked nodes end the walk."""
    at = cut(forest.select("id", F.when(F.col(marked), F.col("id")).alias("mark"), F.when(~F.col(marked), F.col("parent")).alias("up")))
    for _ in range(40):
        if not _any_left(at):
            return at.select("id", "mark")
        beyond = at.select(F.col("id").alias("up"), F.col("mark").alias("_mark"), F.col("up").alias("_far"))
        at = cut(at.join(beyond, "up", "left").select("id", F.coalesce("mark", "_mark").alias("mark"), F.col("_far").alias("up")))
    raise ValueError("the forest has a cycle")


def orders(forest: DataFrame, strict: bool = True) -> DataFrame:
    """(id, stream_order): 1 at sources; elsewhere the largest order above, plus one if at least two share it.

    ``strict=False`` adds one if all orders above are equal, also when there is only one.
    """
    return _orders_by_order(forest) if strict else _orders_by_level(forest)


def _orders_by_order(forest: DataFrame) -> DataFrame:
    """A node's order exceeds k if and only if two nodes just above it, or just above a node upstream of it, have orders of k at least.

    So each round marks where two such nodes meet and all that lies below; the next one looks at these nodes only. Rounds are
    as many as orders, at most the logarithm of the number of nodes, and each takes as many joins as the depth has digits in base two.
    """
    left = cut(forest.select("id", "parent"))
    found = cut(left.select("id", F.lit(1).alias("stream_order")))
    while True:
        meeting = left.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_n")).where("_n >= 2")
        marked = cut(left.join(meeting, "id", "left").select("id", "parent", F.when(F.col("_n").isNotNull(), 1).otherwise(0).cast("long").alias("_m")))
        if marked.where("_m = 1").isEmpty():
            return found
        below = cut(upstream_sums(marked, ["_m"]).where("_m > 0").select("id"))
        left = cut(left.join(below, "id", "left_semi"))
        found = cut(found.join(below.withColumn("_more", F.lit(1)), "id", "left").select("id", (F.col("stream_order") + F.coalesce("_more", F.lit(0))).alias("stream_order")))


def _orders_by_level(forest: DataFrame) -> DataFrame:
    """The orders that also rise where one node flows into the next, from the deepest level down: such orders can be as many as levels."""
    leveled = cut(forest.select("id", "parent").join(levels(forest), "id"))
    deepest = leveled.agg(F.max("level")).head()[0]
    done = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = leveled.where(F.col("level") == level)
        if done is None:
            found = here.select("id", "parent", F.lit(1).alias("stream_order"))
            done, last = found, cut(found)
            continue
        above = last.groupBy(F.col("parent").alias("id")).agg(F.max("stream_order").alias("_top"), F.min("stream_order").alias("_low"))
        joined = here.join(above, "id", "left").select("id", "parent", F.when(F.col("_top").isNull(), 1).otherwise(F.col("_top") + F.when(F.col("_low") == F.col("_top"), 1).otherwise(0)).alias("stream_order"))
        last = cut(joined)
        done = done.unionByName(last)
    return done.select("id", "stream_order") if done is not None else forest.select("id", F.lit(1).alias("stream_order"))


def main_stem(forest: DataFrame, length: str) -> DataFrame:
    """(id, upstream_length, is_main): from each outlet, the way that always takes the branch with the greatest length above; ties to the smaller id."""
    total = upstream_sums(forest, [length]).withColumnRenamed(length, "upstream_length")
    joined = forest.select("id", "parent").join(total, "id")
    best = Window.partitionBy("parent").orderBy(F.desc("upstream_length"), "id")
    chosen = joined.withColumn("_pick", F.col("parent").isNull() | (F.row_number().over(best) == 1))
    # a node is on the stem if no step of its way down leaves the picked branches
    off = first_marked(chosen.select("id", "parent", (~F.col("_pick")).alias("off")), "off")
    return joined.select("id", "upstream_length").join(off, "id").select("id", "upstream_length", F.col("mark").isNull().alias("is_main"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each node is linked to.

    Every node points to its smallest neighbour, and of two that point to each other the smaller is a root. So each tree has
    two nodes at least and its smallest one as root; doubled pointers find it, trees become nodes, and the links between
    them are looked at again. The nodes halve at least each round.
    """
    ends = edges.select(F.col(a).alias("id"), F.col(b).alias("to"))
    links = cut(ends.unionByName(ends.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct())
    rounds = []
    while True:
        least = cut(links.groupBy("id").agg(F.min("to").alias("parent")))
        other = least.select(F.col("id").alias("parent"), F.col("parent").alias("_back"))
        pointed = cut(least.join(shuffled(other), "parent").select("id", "parent", ((F.col("_back") == F.col("id")) & (F.col("id") <= F.col("parent"))).alias("_root")))
        roots = first_marked(pointed, "_root")
        rounds.append(roots)
        named = lambda c: roots.select(F.col("id").alias(c), F.col("mark").alias(f"_{c}"))  # noqa: E731, B023
        between = links.join(shuffled(named("id")), "id").join(shuffled(named("to")), "to").where("_id != _to")
        links = cut(between.select(F.col("_id").alias("id"), F.col("_to").alias("to")).distinct())
        if links.isEmpty():
            break
    found = rounds.pop()
    while rounds:  # a tree's root is a node of the next round, or it has no links left
        later = found.select(F.col("id").alias("mark"), F.col("mark").alias("_last"))
        found = rounds.pop().join(shuffled(later), "mark", "left").select("id", F.coalesce("_last", "mark").alias("mark"))
    return found.withColumnRenamed("mark", "component")


def node_kinds(edges: DataFrame, start: str = "from_node", end: str = "to_node") -> DataFrame:
    """(id, n_in, n_out, kind) of directed edges: source, outlet, junction (two or more come in) or node."""
    ends = edges.select(F.col(start).alias("id"), F.lit(0).alias("_in"), F.lit(1).alias("_out")).unionByName(edges.select(F.col(end).alias("id"), F.lit(1).alias("_in"), F.lit(0).alias("_out")))
    out = ends.groupBy("id").agg(F.sum("_in").alias("n_in"), F.sum("_out").alias("n_out"))
    kind = F.when(F.col("n_in") == 0, "source").when(F.col("n_out") == 0, "outlet").when(F.col("n_in") >= 2, "junction").otherwise("node")
    return out.withColumn("kind", kind)


def unique_edges(edges: DataFrame, edge_id: str, start: str, end: str, length: str) -> DataFrame:
    """Without self-loops and repeated edges (the same ends in any direction, the same length to 0.1); the smallest id stays."""
    same = Window.partitionBy(F.least(start, end), F.greatest(start, end), F.round(length, 1)).orderBy(edge_id)
    return edges.where(F.col(start) != F.col(end)).withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def cluster_ends(points: DataFrame, tolerance: float) -> DataFrame:
    """(id, node, x, y) of planar points: those within ``tolerance`` of each other, also by others between, share a node at their mean place.

    Points meet only in neighbouring cells of a grid as wide as the tolerance.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    own = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    offsets = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = own.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(offsets).alias("o"))
    sent = sent.select("id2", "x2", "y2", (F.col("cx") + F.col("o.di")).alias("cx"), (F.col("cy") + F.col("o.dj")).alias("cy"))
    near = own.join(sent, ["cx", "cy"]).where(F.col("id") < F.col("id2")).where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= tolerance)
    labels = components(near, "id", "id2")
    named = points.join(labels, "id", "left").withColumn("node", F.coalesce("component", "id"))
    same = Window.partitionBy("node")
    return named.select("id", "node", F.avg("x").over(same).alias("x"), F.avg("y").over(same).alias("y"))
