"""Hand-made rasters and networks."""

import math

import numpy as np
from pyspark.sql import functions as F

from rivulet.functions import geo
from rivulet.operators import attach, grid, network


def _cells(spark, z):
    z = np.asarray(z, float)
    return spark.createDataFrame([(i, j, float(z[i, j])) for i, j in np.ndindex(*z.shape) if np.isfinite(z[i, j])], "i int, j int, z double")


def test_a_falling_row_accumulates_to_its_end(spark):
    flows = grid.d8(_cells(spark, [[0.03, 0.02, 0.01, 0.0]]))
    assert {r.j: r.acc for r in grid.accumulate(flows).collect()} == {0: 1, 1: 2, 2: 3, 3: 4}


def test_ties_go_to_the_first_direction(spark):
    z = np.ones((3, 3))
    z[1, 1] = 2
    code = {(r.i, r.j): r.code for r in grid.d8(_cells(spark, z)).collect()}
    assert code[1, 1] == 1 and code[0, 0] == 0


def test_filling_leaves_no_pit_inside(spark):
    rng = np.random.default_rng(3)
    z = rng.uniform(0, 5, (7, 7))
    z[3, 3] = -4
    filled = grid.fill(_cells(spark, z), 1e-3)
    code = {(r.i, r.j): r.code for r in grid.d8(filled).collect()}
    assert all(code[i, j] > 0 for i in range(1, 6) for j in range(1, 6))
    acc = grid.accumulate(grid.d8(filled))
    outlets = [k for k, c in code.items() if c == 0]
    assert sum(r.acc for r in acc.collect() if (r.i, r.j) in outlets) == 49


def test_no_data_is_no_neighbour(spark):
    z = np.full((3, 3), 5.0)
    z[0, 1], z[1, 1] = np.nan, 6
    assert {(r.i, r.j): r.code for r in grid.d8(_cells(spark, z)).collect()}[1, 1] == 1


def test_orders_count_pairs_or_equals(spark):
    # 1 and 2 join in 3, 4 and 5 in 6, these and the source 8 in 7, which passes to 0
    forest = spark.createDataFrame([(1, 3), (2, 3), (4, 6), (5, 6), (3, 7), (6, 7), (8, 7), (7, 0), (0, None)], "id long, parent long")
    strict = {r.id: r.stream_order for r in network.orders(forest).collect()}
    loose = {r.id: r.stream_order for r in network.orders(forest, strict=False).collect()}
    assert (strict[3], strict[7], strict[0]) == (2, 3, 3) and (loose[7], loose[0]) == (2, 3)


def test_long_chain_sums_in_logarithmic_rounds(spark):
    n = 300
    forest = spark.createDataFrame([(i, i - 1 if i else None, 1.0) for i in range(n)], "id long, parent long, v double")
    assert {r.id: r.v for r in network.upstream_sums(forest, ["v"]).collect()} == {i: float(n - i) for i in range(n)}


def test_clusters_chain_and_edges_are_unique(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 1.8, 0.0), (4, 9.0, 9.0)], "id long, x double, y double")
    assert {r.id: r.node for r in network.cluster_ends(points, 1.0).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    edges = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 1, 5.01), (3, 1, 1, 5.0), (4, 1, 2, 7.0)], "e long, a long, b long, len double")
    assert sorted(r.e for r in network.unique_edges(edges, "e", "a", "b", "len").collect()) == [1, 4]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(200, 2)) * [1, 50], rng.normal(size=(30, 2))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, x double, y double")
    targets = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "target long, x double, y double")
    got = {r.id: r.target for r in grid.nearest(points, targets).collect()}
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    assert got == dict(enumerate(d.argmin(1).tolist()))


def test_nearest_edge_with_ties_bounds_and_single_points(spark):
    lines = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (2, 0, 0.0, 4.0), (2, 1, 10.0, 4.0), (3, 0, 50.0, 50.0)], "edge long, k long, x double, y double")
    points = spark.createDataFrame([(1, 2.5, 1.0), (2, 5.0, 2.0), (3, 12.0, 4.0), (4, 90.0, 90.0)], "id long, x double, y double")
    got = {r.id: (r.edge, round(r.distance, 6), round(r.ratio, 6)) for r in attach.nearest_edge(points, lines).collect()}
    assert got[1] == (1, 1.0, 0.25) and got[2] == (1, 2.0, 0.5) and got[3] == (2, 2.0, 1.0) and got[4][0] == 2
    assert {r.id for r in attach.nearest_edge(points, lines, most=2.0).collect()} == {1, 2, 3}
    assert attach.nearest_edge(points, lines.limit(0)).count() == 0


def test_cells_of_points_and_their_areas(spark):
    row = spark.range(1).select(*geo.row_col(F.lit(110.26), F.lit(30.49), 110.0, 30.0, 0.1, 10), *geo.cell_centre(F.lit(5), F.lit(2), 110.0, 30.0, 0.1, 10), geo.cell_area_km2(F.lit(5), 30.0, 0.1, 10)).head()
    assert tuple(row)[:2] == (5, 2) and abs(row[2] - 110.25) < 1e-9 and abs(row[3] - 30.45) < 1e-9
    assert abs(row[4] - math.cos(math.radians(30.45)) * 11132.0 * 11054.0 / 1e6) < 1e-6
