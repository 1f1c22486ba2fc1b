"""Directed networks whose nodes may have several ways down: totals, orders, reach and outlets.

Edges are (edge, from_node, to_node, ...). Totals go down level by level (a node's turn comes when all its edges from
above are done), so rounds follow the longest way; what is upstream of a node is found by doubling ways from the forks instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import network
from rivulet.operators.lineage import cut, shuffled


def _passed_down(edges: DataFrame, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes with sums of ``values`` and order of what leads to them; each round takes the nodes that nothing is missing for."""
    rows = cut(edges.select("edge", "from_node", "to_node", *values))
    ends = rows.select(F.col("from_node").alias("node"), F.lit(0).alias("n")).unionByName(rows.select(F.col("to_node").alias("node"), F.lit(1).alias("n")))
    zero = [F.lit(0.0).alias(v) for v in values]
    waiting = cut(ends.groupBy("node").agg(F.sum("n").alias("missing")).select("node", "missing", *zero, F.lit(0).alias("top"), F.lit(2**31 - 1).alias("low"), F.lit(0).cast("long").alias("edges")))
    nodes = done = None
    while True:
        ready = waiting.where("missing = 0").drop("missing")
        order = F.when(F.col("top") == 0, 1).when(F.col("top") == F.col("low"), F.col("top") + 1).otherwise(F.col("top"))
        ready = cut(ready.select("node", *values, "edges", order.alias("stream_order")))
        if ready.isEmpty():
            return done, nodes
        nodes = ready if nodes is None else nodes.unionByName(ready)
        above = ready.select(F.col("node").alias("from_node"), *[F.col(v).alias(f"up_{v}") for v in values], F.col("edges").alias("up_edges"), "stream_order")
        left = cut(rows.join(above, "from_node"))
        done = left if done is None else done.unionByName(left)
        brought = left.groupBy(F.col("to_node").alias("node")).agg(
            F.count("*").alias("_n"), *[F.sum(F.col(v) + F.col(f"up_{v}")).alias(f"_{v}") for v in values], F.max("stream_order").alias("_top"), F.min("stream_order").alias("_low"), F.sum(F.col("up_edges") + 1).alias("_edges")
        )
        more = lambda name: (F.col(name) + F.coalesce(f"_{name}", F.lit(0))).alias(name)
        rest = waiting.where("missing > 0").join(brought, "node", "left")
        waiting = cut(rest.select("node", (F.col("missing") - F.coalesce("_n", F.lit(0))).alias("missing"), *[more(v) for v in values], F.greatest("top", "_top").alias("top"), F.least("low", "_low").alias("low"), more("edges")))


def upstream_totals(edges: DataFrame, values: Sequence[str] = ("length",)) -> DataFrame:
    """(edge, from_node, to_node, values..., up_<value>..., up_edges, stream_order) of every edge.

    ``up_<value>`` adds up each edge above with its own total, so what reaches a node by two ways counts twice; up_edges
    counts in the same way. The order is 1 at sources, one more than those above if these are equal, else their largest.
    Edges on a cycle or below one have nulls.
    """
    done, _ = _passed_down(edges, values)
    kept = edges.select("edge", "from_node", "to_node", *values)
    names = [*[f"up_{v}" for v in values], "up_edges", "stream_order"]
    if done is None:
        return kept.select("*", *[F.lit(None).cast("double" if n.startswith("up_") and n != "up_edges" else "long" if n == "up_edges" else "int").alias(n) for n in names])
    return kept.join(done.select("edge", *names), "edge", "left")


def _reached(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(start, node): every node that each start (start, node) leads to by any number of ``steps`` (a, b), its own node included.

    After k rounds the ways of less than 2**k steps are known; those are gone on with by ways of exactly 2**k steps, of which
    there are few for each node, so a pair is met again only as often as such ways end at one node.
    """
    known, ways = cut(starts.distinct()), cut(steps.distinct())
    n = known.count()
    while n and not ways.isEmpty():
        longer = known.join(shuffled(ways.select(F.col("a").alias("node"), "b")), "node").select("start", F.col("b").alias("node"))
        known = cut(known.unionByName(longer).distinct())
        before, n = n, known.count()
        if before == n:
            break
        ways = cut(ways.join(shuffled(ways.select(F.col("a").alias("b"), F.col("b").alias("c"))), "b").select("a", F.col("c").alias("b")).distinct())
    return known


def upstream_edges(edges: DataFrame) -> DataFrame:
    """(node, edge): every edge from which water comes to the node, once each; rounds are the logarithm of the longest way."""
    steps = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    return _reached(edges.select(F.col("edge").alias("start"), F.col("to_node").alias("node")), steps).select("node", F.col("start").alias("edge"))


def _first_forks(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, parent, fork): the fork (several ways down) that each node's single ways lead to, itself if it is one, and the next node on the way to it; null where they end at an outlet.

    A node whose single ways go round for ever is a fork too.
    """
    down = steps.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"), F.min("b").alias("parent"))
    single = cut(nodes.select(F.col("node").alias("id")).join(shuffled(down), "id", "left").select("id", F.when(F.col("n") == 1, F.col("parent")).alias("parent"), F.when(F.col("n") > 1, F.col("id")).alias("fork")))
    at, left = single.withColumnRenamed("parent", "up"), None
    while left != (left := at.where("up is not null").count()):  # of ways that end some are shorter than others, so fewer are left each time
        beyond = at.select(F.col("id").alias("up"), F.col("fork").alias("_fork"), F.col("up").alias("_far"))
        at = cut(at.join(shuffled(beyond), "up", "left").select("id", F.coalesce("fork", "_fork").alias("fork"), F.col("_far").alias("up")))
    endless = F.col("up").isNotNull()
    found = at.select("id", F.when(endless, F.col("id")).otherwise(F.col("fork")).alias("fork"))
    return single.select("id", "parent").join(shuffled(found), "id").select("id", F.when(~F.col("fork").eqNullSafe(F.col("id")), F.col("parent")).alias("parent"), "fork")


def distinct_totals(edges: DataFrame, values: Sequence[str] = ("length",)) -> DataFrame:
    """(node, edges, values...): how many edges lie upstream of each node, and their sums, each edge once however many ways lead down from it; 0 at sources.

    What has a single way down to the next fork comes to all below that fork with it. So only forks are followed down, with
    the sums of all that leads to them by single ways.
    """
    nodes = cut(edges.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct())
    steps = cut(edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).distinct())
    led = _first_forks(nodes, steps)
    names = ["edges", *values]
    own = edges.groupBy(F.col("to_node").alias("id")).agg(F.count("*").alias("edges"), *[F.sum(v).alias(v) for v in values])
    valued = cut(led.join(shuffled(own), "id", "left").select("id", "parent", "fork", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values]))
    sums = cut(network.upstream_sums(valued.select("id", "parent", *names), names).join(shuffled(valued.select("id", "fork")), "id"))
    forks = sums.where("fork = id and edges > 0").select(F.col("id").alias("start"), *names)
    pairs = _reached(forks.select("start", F.col("start").alias("node")), steps)
    brought = pairs.join(shuffled(forks), "start").groupBy("node").agg(*[F.sum(v).alias(f"_{v}") for v in names])
    # a node's own fork brings what leads to the node too: a fork itself, or a node on a cycle
    met = pairs.select(F.col("node").alias("id"), F.col("start").alias("fork"), F.lit(True).alias("_met"))
    told = sums.join(shuffled(met), ["id", "fork"], "left").join(shuffled(brought.withColumnRenamed("node", "id")), "id", "left")
    total = lambda v: (F.when(F.col("_met"), F.lit(0)).otherwise(F.col(v)) + F.coalesce(f"_{v}", F.lit(0))).alias(v)
    return told.select(F.col("id").alias("node"), *[total(v) for v in names])


def outlets(edges: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """(component, root) of each connected part.

    The lowest end of one edge with a height (node, z); without heights the end that nothing leaves with the greatest
    length upstream by the given directions (total lengths as in ``upstream_totals``, 0 on and below cycles). Where no
    such end is, all ends of one edge, then all nodes, stand for them; ties go to the smaller node.
    """
    parts = network.components(edges, "from_node", "to_node").select(F.col("id").alias("node"), "component")
    both = edges.select(F.col("from_node").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("to_node").alias("node"), F.lit(0).alias("out")))
    degree = both.groupBy("node").agg((F.count("*") != 1).alias("inner"), (F.sum("out") > 0).alias("leaves"))
    _, nodes = _passed_down(edges, ["length"])
    lengths = nodes.select("node", "length") if nodes is not None else parts.select("node", F.lit(0.0).alias("length")).limit(0)
    known = heights.select("node", F.col("z").cast("double").alias("z")).where("z is not null") if heights is not None else parts.select("node", F.lit(None).cast("double").alias("z")).limit(0)
    rated = parts.join(degree, "node").join(known, "node", "left").join(lengths, "node", "left")
    no_height = F.col("z").isNull()
    rank = F.struct("inner", no_height.alias("unknown"), "z", F.when(no_height, F.col("leaves")).alias("leaves"), F.when(no_height, -F.coalesce("length", F.lit(0.0))).alias("shorter"), "node")
    return rated.groupBy("component").agg(F.min(rank).alias("m")).select("component", F.col("m.node").alias("root"))


def ranks(rows: DataFrame, key: str, order: Column, buckets: int = 64) -> DataFrame:
    """``rows`` with ``rank`` from 1 by descending ``order`` (a double), ties to the smaller ``key``: counted by ranges of values, so no task sorts all rows."""
    rows = cut(rows.withColumn("_order", order.cast("double")))
    edges = rows.agg(F.percentile_approx("_order", [k / buckets for k in range(1, buckets)], 10_000)).head()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>"), lambda e: e > F.col("_order")))
    dealt = rows.withColumn("_bucket", bucket)
    counts = sorted((r["_bucket"], r["count"]) for r in dealt.groupBy("_bucket").count().collect())  # at most ``buckets`` rows
    before, total = {}, 0
    for b, n in counts:
        before[b], total = total, total + n
    base = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_bucket")) if before else F.lit(0)
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.desc("_order"), key))
    return dealt.withColumn("rank", (base + within).cast("long")).drop("_order", "_bucket")


def stems(forest: DataFrame, length: str) -> DataFrame:
    """(id, upstream_length, stem): heavy paths of a forest (id, parent); at every node the branch with the greatest length above goes on, ties to the smaller id. A stem is named by its lowest node."""
    total = network.upstream_sums(forest.select("id", "parent", length), [length]).withColumnRenamed(length, "upstream_length")
    known = cut(forest.select("id", "parent").join(total, "id"))
    best = known.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(F.min(F.struct((-F.col("upstream_length")).alias("less"), "id")).alias("m")).select("at", F.col("m.id").alias("id"))
    picked = known.join(best, "id", "left")
    found = network.first_marked(picked.select("id", "parent", F.col("at").isNull().alias("ends")), "ends")
    return known.join(found, "id").select("id", "upstream_length", F.col("mark").alias("stem"))


def name_rivers(forest: DataFrame, length: str, main_name: str, pool: Sequence[str] = (), template: str = "{main} tributary {n}", by_stem: bool = True) -> DataFrame:
    """(id, stem, name): the stem of the greatest length at an outlet has the main name; others take the pool's names by descending length, then the template's.

    ``by_stem`` names every stem once, by the length above its lowest node; else every node off the main stem has a name of
    its own. Ties go to the smaller id.
    """
    found = cut(stems(forest, length).join(forest.select("id", "parent"), "id"))
    top = found.where("parent is null").agg(F.min(F.struct((-F.col("upstream_length")).alias("less"), "id"))).head()[0]
    main = F.col("stem") == F.lit(top.id if top else None)
    other = found.where(~main & (F.col("id") == F.col("stem"))) if by_stem else found.where(~main)
    ranked = ranks(other.select("id", "upstream_length"), "id", F.col("upstream_length"))
    before, _, after = template.partition("{n}")
    made = F.concat(F.lit(before.replace("{main}", main_name)), F.col("rank").cast("string"), F.lit(after.replace("{main}", main_name)))
    names = F.array(*[F.lit(n) for n in pool]) if pool else F.array().cast("array<string>")
    named = ranked.select(F.col("id").alias("stem" if by_stem else "id"), F.coalesce(F.get(names, F.col("rank").cast("int") - 1), made).alias("given"))
    joined = found.join(named, "stem" if by_stem else "id", "left")
    return joined.select("id", "stem", F.when(main, F.lit(main_name)).otherwise(F.col("given")).alias("name"))
