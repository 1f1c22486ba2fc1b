"""Nearest targets and lines by brute force, with outliers, long segments, clusters and ties."""

import math

import numpy as np
import pytest

from rivulet.operators import attach, grid, units

POINT, TARGET, LINE = "id long, x double, y double", "target long, x double, y double", "edge long, k long, x double, y double"


def _places(seed):
    """Two clusters of very different density, far places, repeated ones and a lattice with ties."""
    rng = np.random.default_rng(seed)
    at = np.r_[rng.random((60, 2)), rng.random((60, 2)) * 1e-5 + 0.3, [[1e6, -1e6], [0.5, 0.5], [0.5, 0.5]], np.indices((5, 5)).reshape(2, -1).T * 0.25]
    return [(n, float(x), float(y)) for n, (x, y) in enumerate(at)]


@pytest.mark.parametrize("most", [None, 0.05, 3.0])
def test_nearest_targets(spark, most):
    points, targets = _places(1), _places(2)[:-3] + [(900, 0.125, 0.0), (901, -4e5, 7.0)]
    got = {r.id: (r.target, r.distance) for r in grid.nearest(spark.createDataFrame(points, POINT), spark.createDataFrame(targets, TARGET), most).collect()}
    want = {}
    for i, x, y in points:
        d, t = min((math.hypot(x - a, y - b), t) for t, a, b in targets)
        if most is None or d <= most:
            want[i] = (t, d)
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()} and all(got[i][1] == pytest.approx(d, rel=1e-12) for i, (_, d) in want.items())


def test_nearest_of_nothing_and_of_one_place(spark):
    points, none = spark.createDataFrame([(1, 2.0, 3.0)], POINT), spark.createDataFrame([], TARGET)
    assert grid.nearest(points, none).count() == 0 and grid.nearest(points.limit(0), spark.createDataFrame([(1, 0.0, 0.0)], TARGET)).count() == 0
    assert [tuple(r) for r in grid.nearest(points, spark.createDataFrame([(7, 2.0, 3.0), (4, 2.0, 3.0)], TARGET)).collect()] == [(1, 4, 0.0)]


@pytest.mark.parametrize("most", [None, 0.1])
def test_nearest_lines(spark, most):
    rng = np.random.default_rng(5)
    lines = {e: (rng.random(2) + np.cumsum(rng.normal(0, 0.02, (4, 2)), 0)).tolist() for e in range(40)} | {50: [[-3e5, 0.4], [4e5, 0.6]], 51: [[0.2, 0.2], [0.2, 0.2]], 52: [[0.7, 0.7]], 53: [[1e6, 1e6], [1e6, 1e6 + 1]]}
    points = _places(3)
    got = {r.id: (r.edge, r.distance, r.ratio) for r in attach.nearest_edge(spark.createDataFrame(points, POINT), spark.createDataFrame([(e, k, *p) for e, at in lines.items() for k, p in enumerate(at)], LINE), most).collect()}
    want = {}
    for i, x, y in points:
        best = None
        for e, at in lines.items():
            total, before = sum(math.dist(a, b) for a, b in zip(at, at[1:], strict=False)), 0.0
            for k, ((ax, ay), (bx, by)) in enumerate(zip(at, at[1:], strict=False)):
                length = math.dist((ax, ay), (bx, by))
                u = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length**2)) if length else 0
                found = (math.hypot(x - ax - u * (bx - ax), y - ay - u * (by - ay)), e, k, (before + u * length) / total if total else 0)
                best = min(best or found, found)
                before += length
        if most is None or best[0] <= most:
            want[i] = best
    assert got.keys() == want.keys()
    for i, (d, e, _, ratio) in want.items():
        assert got[i][1] == pytest.approx(d, rel=1e-9, abs=1e-9) and (got[i][0] == e or got[i][1] == pytest.approx(d, abs=1e-12)) and (got[i][0] != e or got[i][2] == pytest.approx(ratio, abs=1e-9)), i


def test_lines_to_zones_fall_back_to_their_middle(spark):
    labels = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 4, "b")], "i int, j int, label string")
    lines = spark.createDataFrame([(e, k, float(x), float(y)) for e, at in {1: [(9, 9), (1, 0)], 2: [(0, 0), (2, 0), (9, 0)], 3: [(3, 1), (4, 1), (5, 1)], 4: [(9, 9), (8, 8)]}.items() for k, (x, y) in enumerate(at)], LINE)
    assert {r.edge: r.label for r in units.zones_of_lines(lines, labels).collect()} == {1: "a", 2: None, 3: "b", 4: None}
