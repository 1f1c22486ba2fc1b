"""Noding, outlines, simplification and braided networks against versions by hand."""

import itertools
import json
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions import geojson
from rivulet.operators import attach, context, dag, noding, polygons, simplify
from rivulet.sources import sinks

LINE = "edge long, k long, x double, y double"


def _lines(spark, lines):
    return spark.createDataFrame([(e, k, float(x), float(y)) for e, points in lines.items() for k, (x, y) in enumerate(points)], LINE)


def _pieces(df):
    found = defaultdict(list)
    for r in df.orderBy("edge", "piece", "k").collect():
        found[r.edge, r.piece].append((round(r.x, 9), round(r.y, 9)))
    return dict(found)


# noding
def _meetings(a, b, c, d):
    """Places where two segments of whole numbers meet, in exact arithmetic."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (tuple(map(Fraction, p)) for p in (a, b, c, d))
    cross = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    inside = lambda p, a, b: min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    if cross:
        t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / cross
        u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / cross
        return [(ax + t * (bx - ax), ay + t * (by - ay))] if 0 <= t <= 1 and 0 <= u <= 1 else []
    if (cx - ax) * (by - ay) != (cy - ay) * (bx - ax):
        return []
    ends = [(ax, ay), (bx, by), (cx, cy), (dx, dy)]
    return [p for p in dict.fromkeys(ends) if inside(p, (ax, ay), (bx, by)) and inside(p, (cx, cy), (dx, dy))]


def _noded(lines):
    """Pieces of lines by comparing all segments."""
    segments = [(e, k, a, b) for e, points in lines.items() for k, (a, b) in enumerate(itertools.pairwise(points)) if a != b]
    cuts = defaultdict(set)
    for (e, k, a, b), (f, m, c, d) in itertools.combinations(segments, 2):
        for p in _meetings(a, b, c, d):
            if e == f and m == k + 1 and p == tuple(map(Fraction, b)) == tuple(map(Fraction, c)):
                continue
            for edge, n, start, end in ((e, k, a, b), (f, m, c, d)):
                axis = 0 if start[0] != end[0] else 1
                t = (p[axis] - start[axis]) / Fraction(end[axis] - start[axis])
                cuts[edge].add((n + 1, Fraction(0), p) if t == 1 else (n, t, p))
    pieces, seen = {}, set()
    for e, points in sorted(lines.items()):
        stops = {(k, Fraction(0)): (tuple(map(Fraction, p)), False) for k, p in enumerate(points)}
        stops |= {(k, t): (p, True) for k, t, p in cuts[e]}
        run, at = [], []
        for n, (_, (p, cut)) in enumerate(sorted(stops.items())):
            at.append(p)
            if cut and 0 < n < len(stops) - 1:
                run.append(at)
                at = [p]
        run.append(at)
        for n, piece in enumerate(run):
            sides = frozenset(frozenset(s) for s in itertools.pairwise(piece))
            if len(piece) > 1 and sides not in seen:
                seen.add(sides)
                pieces[e, n + 1] = [(round(float(x), 9), round(float(y), 9)) for x, y in piece]
    return pieces


def test_touching_overlapping_and_multiple_crossings_are_noded(spark):
    lines = {
        1: [(0, 0), (10, 0)], 2: [(2, -1), (2, 1)], 3: [(4, 0), (4, 5)], 4: [(6, 0), (8, 0), (8, 3)], 5: [(0, 0), (0, 5), (5, 5), (5, -5)], 6: [(1, 1), (9, 1), (5, 4), (5, 0)],
        7: [(10, 0), (0, 0)], 8: [(20, 20), (22, 20), (21, 22), (20, 20)], 9: [(20, 20), (24, 24)], 10: [(-3, -3), (-3, -3)],
    }
    assert _pieces(noding.node_lines(_lines(spark, {e: p for e, p in lines.items() if e != 10}))) == _noded({e: p for e, p in lines.items() if e != 10})
    assert noding.node_lines(_lines(spark, {10: lines[10]})).count() == 0 and noding.node_lines(_lines(spark, {})).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_lines_on_a_lattice_are_noded(spark, seed):
    """Vertices on few whole numbers, so most meetings touch or overlap; one line is long."""
    rng = np.random.default_rng(seed)
    lines = {}
    for e in range(12):
        points = [tuple(map(int, p)) for p in rng.integers(0, 7, (5, 2))]
        lines[e] = [p for n, p in enumerate(points) if not n or p != points[n - 1]]
    lines = {e: p for e, p in lines.items() if len(p) > 1} | {99: [(-5_000, 3), (5_000, 4)]}
    straight = {e: p for e, p in lines.items() if not _turns_back(p)}
    assert _pieces(noding.node_lines(_lines(spark, straight))) == _noded(straight)


def _turns_back(points):
    """Whether a line runs back on itself, where only neighbours meet."""
    return any((b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(points, points[1:], points[2:], strict=False))


def test_a_long_line_and_an_outlier_do_not_widen_cells(spark):
    rng = np.random.default_rng(4)
    near = [(e, k, float(x + k * 0.5), float(y)) for e, (x, y) in enumerate(rng.random((2_000, 2)) * 200) for k in (0, 1)]
    far = [(-1, 0, 1e6, 1e6), (-1, 1, 1e6 + 0.5, 1e6), (-2, 0, -1e5, 50.1), (-2, 1, 1e5, 50.2)]

    def met(rows):
        parts = spark.createDataFrame(rows, LINE).groupBy("edge").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(n) for k, n1 in ((0, "a"), (1, "b")) for c, n in (("x", f"{n1}x"), ("y", f"{n1}y"))])
        parts = parts.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
        width = noding.base_width(parts)
        own = noding.in_cells(parts, width)
        visiting = noding.with_coarser(parts, own, width).withColumnRenamed("edge", "other").select("level", "cx", "cy", "other")
        return own.join(visiting, ["level", "cx", "cy"]).count(), own.count()

    (pairs, cells), (more_pairs, more_cells) = met(near), met(near + far)
    assert more_pairs < 2 * pairs + 2_100 and more_cells < 1.2 * cells + 100


def test_pieces_find_their_lines(spark):
    lines = _lines(spark, {1: [(0, 0), (10, 0)], 2: [(5, -5), (5, 5)], 3: [(5, -5), (5, 5)]})
    pieces = noding.node_lines(lines)
    found = {(r.edge, r.piece): (r.line, r.distance, r.forward) for r in noding.source_lines(pieces, lines, 0.1).collect()}
    assert found == {(1, 1): (1, 0.0, True), (1, 2): (1, 0.0, True), (2, 1): (2, 0.0, True), (2, 2): (2, 0.0, True)}
    odd = spark.createDataFrame([(7, 1, 0, 9.0, 1.0), (7, 1, 1, 1.0, 1.0), (8, 1, 0, 99.0, 99.0), (8, 1, 1, 98.0, 99.0)], "edge long, piece int, k int, x double, y double")
    found = {r.edge: (r.line, r.distance, r.forward) for r in noding.source_lines(odd, lines, 2.0).collect()}
    assert found == {7: (2, 0.0, False), 8: (None, None, None)} or found == {7: (1, 1.0, False), 8: (None, None, None)}


# outlines
def _flood(cells):
    left, parts = set(cells), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            i, j = stack.pop()
            part.add((i, j))
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in left:
                    left.remove(n)
                    stack.append(n)
        parts.append(part)
    return parts


@pytest.mark.parametrize("seed", range(3))
def test_rings_enclose_the_parts_of_zones(spark, seed):
    rng = np.random.default_rng(seed)
    grid = rng.random((14, 17)) < (0.5, 0.65, 0.8)[seed]
    zones = {label: [(i, j) for i in range(14) for j in range(17) if grid[i, j] == bool(label)] for label in (0, 1)}
    cells = spark.createDataFrame([(label, i, j) for label, at in zones.items() for i, j in at], "label int, i int, j int")
    found = polygons.polygons(cells, polygons.rings(cells)).collect()
    for label, at in zones.items():
        mine = [r for r in found if r.label == label]
        sizes = defaultdict(float)
        for r in mine:
            sizes[r.polygon] += r.area
        assert sorted(sizes.values()) == sorted(float(len(p)) for p in _flood(at))
        assert {r.polygon for r in mine} == {r.ring for r in mine if not r.hole}


def test_rings_at_corners_and_in_holes(spark):
    at = [(i, j) for i in range(7) for j in range(7) if not (1 <= i <= 5 and 1 <= j <= 5)] + [(3, 3)] + [(7, 7)]  # a frame, an island, a cell that shares a corner
    corners = polygons.rings(spark.createDataFrame([("a", i, j) for i, j in at] + [("b", 1, 1), (None, 0, 0)], "label string, i int, j int"))
    areas = sorted((r.label, r.area, r.n, r.hole) for r in polygons.ring_areas(corners).collect())
    assert areas == [("a", -25.0, 4, True), ("a", 1.0, 4, False), ("a", 1.0, 4, False), ("a", 49.0, 4, False), ("b", 1.0, 4, False)]
    first = corners.where("label = 'b'").orderBy("k").collect()
    assert [(r.i, r.j) for r in first] == [(1, 1), (1, 2), (2, 2), (2, 1)]


def test_outlines_are_closed_and_in_coordinates(spark):
    cells = spark.createDataFrame([(5, 0, 0), (5, 0, 1), (5, 1, 0), (5, 9, 9)], "label int, i int, j int")
    rows = polygons.outlines(cells, 100.0, 200.0, 10.0, 10).orderBy("k").collect()
    assert [(r.x, r.y) for r in rows] == [(100, 300), (120, 300), (120, 290), (110, 290), (110, 280), (100, 280), (100, 300)]
    assert polygons.outlines(cells.limit(0), 0.0, 0.0, 1.0, 1).count() == 0


# simplification
def _kept(points, tolerance):
    def distance(p, a, b):
        length = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
        u = 0 if not length else min(1, max(0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / length))
        return math.hypot(p[0] - a[0] - u * (b[0] - a[0]), p[1] - a[1] - u * (b[1] - a[1]))

    def within(low, high):
        inner = [(distance(points[k], points[low], points[high]), -k) for k in range(low + 1, high)]
        if not inner or max(inner)[0] <= tolerance:
            return []
        k = -max(inner)[1]
        return within(low, k) + [k] + within(k, high)

    return sorted({0, *within(0, len(points) - 1), len(points) - 1})


def test_simplified_lines_keep_what_recursion_keeps(spark):
    rng = np.random.default_rng(2)
    lines = {e: np.cumsum(rng.normal(size=(n, 2)), 0).tolist() for e, n in enumerate((1, 2, 3, 40, 200))}
    lines[9] = [*lines[3], lines[3][0]]
    found = defaultdict(list)
    for r in simplify.simplify(_lines(spark, lines), 1.5).orderBy("edge", "k").collect():
        found[r.edge].append(r.k)
    assert found == {e: _kept(p, 1.5) for e, p in lines.items()}
    assert simplify.simplify(_lines(spark, {}), 1.0).count() == 0


def test_outlines_are_thinned_to_a_number_of_points(spark):
    circle = lambda n: [(math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)] + [(1.0, 0.0)]
    rows = simplify.thin_outlines(_lines(spark, {n: circle(n) for n in (5, 38, 39, 40, 79, 300)}), 1e-9).orderBy("edge", "k").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.edge].append((r.x, r.y))
    assert all(p[0] == p[-1] and len(p) <= 40 for p in by.values())
    assert len(by[5]) == 6 and len(by[39]) == 40 and len(by[300]) >= 30


# networks with several ways down
def test_braided_orders_and_cycles(spark):
    edges = [(1, 1, 3, 1.0), (2, 2, 3, 2.0), (3, 3, 4, 4.0), (4, 3, 5, 8.0), (5, 4, 6, 16.0), (6, 5, 6, 32.0), (7, 6, 7, 64.0), (8, 20, 21, 1.0), (9, 21, 20, 1.0), (10, 21, 22, 5.0)]
    frame = spark.createDataFrame(edges, "edge long, from_node long, to_node long, length double")
    found = {r.edge: (r.up_length, r.up_edges, r.stream_order) for r in dag.upstream_totals(frame).collect()}
    assert found[1] == (0.0, 0, 1) and found[3] == (3.0, 2, 2) and found[7] == (16 + 32 + 2 * 3 + 4 + 8, 8, 4)
    assert found[8] == found[9] == found[10] == (None, None, None)
    reach = {r.node: (r.edges, r.length) for r in dag.distinct_totals(frame).collect()}
    assert reach[7] == (7, 127.0) and reach[6] == (6, 63.0) and reach[1] == (0, 0.0) and reach[22] == (3, 7.0)


def test_outlets_by_height_and_by_length(spark):
    edges = spark.createDataFrame([(1, 1, 2, 5.0), (2, 2, 3, 1.0), (3, 2, 4, 9.0), (4, 11, 12, 1.0)], "edge long, from_node long, to_node long, length double")
    roots = lambda h: {r.component: r.root for r in dag.outlets(edges, h).collect()}
    assert roots(None) == {1: 4, 11: 12}
    assert roots(spark.createDataFrame([(1, 3.0), (3, 7.0), (4, None), (2, 0.0)], "node long, z double")) == {1: 1, 11: 12}


def test_ranks_and_river_names(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 500)
    rows = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(values)], "id long, v double")
    got = {r.id: r.rank for r in dag.ranks(rows, "id", F.col("v"), buckets=8).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda i: (-values[i], i)) and sorted(got.values()) == list(range(1, 501))
    forest = spark.createDataFrame([(1, None, 1.0), (2, 1, 5.0), (3, 1, 2.0), (4, 2, 1.0), (5, 2, 1.0), (6, 3, 1.0)], "id long, parent long, length double")
    named = {r.id: (r.stem, r.name) for r in dag.name_rivers(forest, "length", "Trunk", ["Ash"], "{main}-{n}").collect()}
    assert named == {1: (1, "Trunk"), 2: (1, "Trunk"), 4: (1, "Trunk"), 3: (3, "Ash"), 6: (3, "Ash"), 5: (5, "Trunk-2")}
    each = {r.id: r.name for r in dag.name_rivers(forest, "length", "Trunk", ["Ash"], "{main}-{n}", by_stem=False).collect()}
    assert each == {1: "Trunk", 2: "Trunk", 4: "Trunk", 3: "Ash", 5: "Trunk-2", 6: "Trunk-3"}


# GeoJSON
def test_collections_and_odd_geometries(spark):
    feature = lambda g, p=None: {"type": "Feature", "properties": p, "geometry": g}
    shapes = [
        feature({"type": "LinearRing", "coordinates": [[0, 0, 1], [1, 1, 1], [0, 0, 1]]}, {"name": "a", "n": 1.5}), feature(None), feature({"type": "MultiPolygon", "coordinates": []}), feature({"type": "LineString", "coordinates": [[1], ["x", 2], [3, 4]]}),
        feature({"type": "Cube", "coordinates": [1, 2]}),
    ]
    texts = [json.dumps({"type": "FeatureCollection", "features": shapes}), json.dumps(feature({"type": "Point", "coordinates": [7, 8, 9]})), "no json", None, json.dumps({"type": "Point"})]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "file int, text string")
    found = rows.select("file", F.posexplode(geojson.features(F.col("text"))).alias("n", "feature")).withColumn("props", geojson.properties(F.col("feature")))
    assert sorted((r.file, r.n, r.props) for r in found.collect()) == sorted([(0, 0, {"name": "a", "n": "1.5"}), *[(0, n, {}) for n in range(1, 5)], (1, 0, {})], key=lambda r: r[:2])
    got = sorted(tuple(r) for r in geojson.vertices(found, "feature", ["file", "n"]).collect())
    assert (0, 0, "line", 0, 0, 1, 1.0, 1.0) in got and (1, 0, "point", 0, 0, 0, 7.0, 8.0) in got and not any(r[1] in (1, 2, 4) and r[0] == 0 for r in got)
    assert geojson.vertices(found, "feature", ["file"], kinds=["polygon"]).count() == 0


def test_layers_by_type(spark):
    layers = spark.createDataFrame([(2, "b", "river"), (1, "a", "river"), (3, "c", "lake")], "layer int, name string, type string")
    assert [r.layer for r in geojson.find_layer(layers, "river").collect()] == [1] and geojson.find_layer(layers, "dem").count() == 0
    rows = spark.createDataFrame([(1, {"_layer_id": "old", "x": "y"}), (3, None), (9, None)], "layer int, props map<string,string>")
    found = {r.layer: r.props for r in geojson.features_of_types(rows, layers, ["river", "lake"]).collect()}
    assert found == {1: {"x": "y", "_layer_id": "1", "_layer_name": "a", "_layer_type": "river"}, 3: {"_layer_id": "3", "_layer_name": "c", "_layer_type": "lake"}}


def test_units_as_features_come_back(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 0)], "label int, i int, j int")
    shapes = polygons.outlines(cells, 0.0, 0.0, 1.0, 2)
    units = spark.createDataFrame([(1, "S01", None), (2, "S02", 1)], "label int, code string, parent int")
    outlets = spark.createDataFrame([(1, 0.5, 1.5), (2, 0.5, 0.5)], "label int, x double, y double")
    made = sinks.unit_features(shapes, units, outlets)
    sinks.write_features(made, str(tmp_path / "units"))
    back = spark.read.text(str(tmp_path / "units"))
    found = geojson.vertices(back.withColumn("code", geojson.properties(F.col("value"))["code"]), "value", ["code"])
    rings = {code: [(r.x, r.y) for r in found.where((F.col("code") == code) & (F.col("kind") == "polygon")).orderBy("k").collect()] for code in ("S01", "S02")}
    assert rings == {"S01": [(0, 2), (2, 2), (2, 1), (0, 1), (0, 2)], "S02": [(0, 1), (1, 1), (1, 0), (0, 0), (0, 1)]}
    assert sorted((r.code, r.x, r.y) for r in found.where("kind = 'point'").collect()) == [("S01", 0.5, 1.5), ("S02", 0.5, 0.5)]


def test_centroids_of_odd_polygons(spark):
    rings = {1: [(0, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), (1, [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)])], 2: [(0, [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)])], 3: [(0, [(1, 1), (2, 2), (1, 1)])]}
    rows = [(key, 0, ring, k, float(x), float(y)) for key, parts in rings.items() for ring, points in parts for k, (x, y) in enumerate(points)]
    found = {r.id: (round(r.x, 9), round(r.y, 9)) for r in attach.centroids(spark.createDataFrame(rows, "id int, part int, ring int, k int, x double, y double"), "id").collect()}
    assert found == {1: (round(28 / 12, 9), round(28 / 12, 9)), 2: (1.0, 1.0)}


def test_what_directs_edges(spark):
    edges = spark.createDataFrame([(2, 1, 2, "7"), (1, 2, 3, "x"), (3, 3, 4, " 5.5 "), (4, 2, 5, None)], "edge int, from_node int, to_node int, height string")
    told = context.heights_of_edges(edges)
    assert {r.node: r.z for r in told.collect()} == {1: 7.0, 2: 7.0, 3: 5.5, 4: 5.5, 5: None}
    raster = context.Raster(0.0, 0.0, 1.0, 2, 2)
    cells = spark.createDataFrame([(0, 0, 3.0), (1, 1, 4.0)], "i int, j int, z double")
    nodes = spark.createDataFrame([(1, 0.5, 1.5), (2, 1.5, 0.5), (3, 0.5, 0.5), (4, 9.0, 9.0)], "node int, x double, y double")
    heights = context.heights_at(nodes, cells, raster)
    assert {r.node: r.z for r in heights.collect()} == {1: 3.0, 2: 4.0, 3: None, 4: None}
    assert context.evidence(heights, told)[0] == "dem" and context.evidence(heights.where("z is null"), told)[0] == context.evidence(None, told)[0] == "elevation_attribute" and context.evidence(None, told.where("z is null"))[0] == "digitized"
    area = {r.node: r.area for r in context.area_at(nodes, cells.select("i", "j", F.lit(5).alias("acc")), raster, 0).collect()}
    assert area == {1: pytest.approx(5e-6), 2: pytest.approx(5e-6), 3: None, 4: None}


def test_a_raster_is_analysed_at_once(spark):
    z = [(i, j, 5.0 if 0 < i < 4 and 0 < j < 4 else 9.0) for i in range(5) for j in range(5)]
    z = [(i, j, 1.0 if (i, j) == (4, 2) else v) for i, j, v in z]
    found = context.analyse(spark.createDataFrame(z, "i int, j int, z double"), tile=3)
    assert {(r.i, r.j): r.acc for r in found.acc.collect()}[4, 2] >= 9 and found.filled.count() == found.flows.count() == 25
