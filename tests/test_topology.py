"""Topology and units on small hand-made networks."""

from rivulet.operators import channels, topology, units

EDGE = "edge long, from_node long, to_node long, length double"


def test_braids_are_oriented_and_ties_keep_their_direction(spark):
    # 0 is the outlet; 1 and 2 lie side by side above it, 3 above both
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 2, 0, 1.0), (3, 1, 2, 1.0), (4, 1, 3, 1.0), (5, 3, 2, 1.0)], EDGE)
    found = topology.orient(edges, spark.createDataFrame([(0, 0)], "component long, root long"))
    assert sorted((r.edge, r.from_node, r.to_node, r.flipped) for r in found.collect()) == [(1, 1, 0, True), (2, 2, 0, False), (3, 1, 2, False), (4, 3, 1, True), (5, 3, 2, False)]


def test_outlets_without_heights_are_ends_that_nothing_leaves(spark):
    edges = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 9, 1.0), (3, 20, 21, 1.0)], EDGE)
    heights = spark.createDataFrame([(20, 5.0), (2, 0.0)], "node long, z double")
    found = {r.component: r.root for r in topology.outlets(edges, heights).collect()}
    assert found == {1: 9, 20: 20}


def test_a_node_whose_ring_goes_is_dissolved_too(spark):
    # the ring 5-6-7 hangs on node 5, which then joins two edges
    edges = spark.createDataFrame([(1, 1, 5, 2.0), (2, 5, 9, 3.0), (3, 5, 6, 1.0), (4, 6, 7, 1.0), (5, 7, 5, 1.0)], EDGE)
    found = topology.dissolve(edges, spark.createDataFrame([], "node long")).collect()
    assert [tuple(r) for r in found] == [(1, 1, 9, 5.0)]


def test_split_leaves_ends_alone(spark):
    edges = spark.createDataFrame([(1, 10, 11, 100.0), (2, 11, 12, 10.0)], EDGE)
    stations = spark.createDataFrame([(-1, 1, 0.5), (-2, 1, 0.01), (-3, 1, 0.25), (-4, 7, 0.5)], "node long, edge long, ratio double")
    found = sorted(tuple(r) for r in topology.split_at(edges, stations).collect())
    assert found == [(1, 1, 10, -3, 25.0), (1, 2, -3, -1, 25.0), (1, 3, -1, 11, 50.0), (2, 1, 11, 12, 10.0)]


def test_keep_largest_breaks_ties_and_puts_nulls_last(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 7), ("b", 4, None)], "k string, id int, m int")
    assert sorted(tuple(r) for r in units.keep_largest(rows, ["k"], "m", "id").collect()) == [("a", 2, 7), ("b", 4, None)]


def test_reaches_end_at_confluences_and_on_the_border(spark):
    # two branches meet at (3, 2) and leave the raster at (5, 2); (0, 0) and (5, 4) only widen the raster
    down = {(1, 1): (2, 1), (2, 1): (3, 2), (1, 3): (2, 3), (2, 3): (3, 2), (3, 2): (4, 2), (4, 2): (5, 2), (5, 2): None, (0, 0): None, (5, 4): None}
    acc = {(1, 1): 5, (2, 1): 6, (1, 3): 7, (2, 3): 8, (3, 2): 15, (4, 2): 16, (5, 2): 17, (0, 0): 1, (5, 4): 1}
    flows = spark.createDataFrame([(i, j, 10.0 - i, *(d or (None, None))) for (i, j), d in down.items()], "i int, j int, z double, down_i int, down_j int")
    cells = channels.reach_cells(flows, spark.createDataFrame([(*at, n) for at, n in acc.items()], "i int, j int, acc long"), 5)
    names = {(r.i, r.j): r.reach for r in cells.where("k = 0").collect()}
    lines = {at: [(r.i, r.j) for r in cells.where(f"reach = {name}").orderBy("k").collect()] for at, name in names.items()}
    assert lines == {(1, 1): [(1, 1), (2, 1), (3, 2)], (1, 3): [(1, 3), (2, 3), (3, 2)], (3, 2): [(3, 2), (4, 2), (5, 2)]}
    found = channels.reaches(cells)
    got = {r.reach: (r.n_cells, r.acc, r.below) for r in found.collect()}
    assert got == {names[1, 1]: (3, 15, names[3, 2]), names[1, 3]: (3, 15, names[3, 2]), names[3, 2]: (3, 17, None)}
    assert {r.reach: r.stream_order for r in channels.reach_orders(found).collect()} == {names[1, 1]: 1, names[1, 3]: 1, names[3, 2]: 2}
