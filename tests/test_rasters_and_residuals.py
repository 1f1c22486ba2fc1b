"""Filling and flats in tiles, residual regression and name matching against versions by hand."""

import heapq

import numpy as np
import pytest

from rivulet.operators import grid, network, residual, series

CELL = "i int, j int, z double"


def _frame(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1]) if np.isfinite(z[i, j])], CELL)


def _flooded(z, eps):
    """Priority flood from the border."""
    h, w = z.shape
    f = np.full(z.shape, np.inf)
    heap = [(z[i, j], i, j) for i in range(h) for j in range(w) if np.isfinite(z[i, j]) and (i in (0, h - 1) or j in (0, w - 1))]
    for v, i, j in heap:
        f[i, j] = v
    heapq.heapify(heap)
    while heap:
        v, i, j = heapq.heappop(heap)
        if v > f[i, j]:
            continue
        for di, dj, _, _ in grid.D8:
            a, b = i + di, j + dj
            if 0 <= a < h and 0 <= b < w and np.isfinite(z[a, b]) and max(z[a, b], v + eps) < f[a, b]:
                f[a, b] = max(z[a, b], v + eps)
                heapq.heappush(heap, (f[a, b], a, b))
    return np.where(np.isfinite(f), f, z)


@pytest.mark.parametrize("tile", [3, 64])
def test_fill_is_a_priority_flood(spark, tile):
    rng = np.random.default_rng(tile)
    z = rng.integers(0, 6, (13, 17)).astype(float)
    z[4:9, 5:8] = np.nan
    z[5:8, 6] = 1.0  # an island that no way leads from
    z[2, 2:14] = 0.0
    got = {(r.i, r.j): r.z for r in grid.fill(_frame(spark, z), 0.25, tile).collect()}
    want = _flooded(z, 0.25)
    assert got == {(i, j): want[i, j] for i in range(13) for j in range(17) if np.isfinite(z[i, j])}
    assert grid.fill(spark.createDataFrame([], CELL)).count() == 0


def test_rounds_follow_tiles_and_not_cells(spark):
    """A channel that winds over the whole raster is filled in as many rounds as it crosses tiles."""
    z = np.full((9, 30), 100.0)
    for k, i in enumerate(range(1, 8, 2)):
        z[i, 1:29] = 1.0
        z[i + 1, 28 if k % 2 == 0 else 1] = 1.0
    z[8, 1] = 0.0
    rounds, real = [], grid.cut
    grid.cut = lambda df: (rounds.append(1), real(df))[1]
    try:
        got = grid.fill(_frame(spark, z), 1e-3, 64)
    finally:
        grid.cut = real
    assert len(rounds) <= 3 and got.count() == z.size


def test_tiles_of_a_task_settle_at_once(spark):
    """1,250 tiles take far fewer calls than tiles, also where a tile goes on in the next batch of rows."""
    cells = spark.range(20_000).selectExpr("CAST(id div 50 AS int) - 7 AS i", "CAST(id % 50 AS int) AS j", "(id * 37) % 1009 * 0.1 AS z")
    start = cells.selectExpr("*", "IF(i IN (-7, 392) OR j IN (0, 49), z, double('inf')) AS f")
    calls, shifts = spark.sparkContext.accumulator(0), grid._shifts

    def sink(z, f):
        calls.add(1)
        return np.maximum(z, np.minimum.reduce(list(shifts(f))) + 0.01)

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "997")
    try:
        got = {(r.i, r.j): r.f for r in grid._in_tiles(start, "f", sink, 4).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    z = np.array([r.z for r in cells.orderBy("i", "j").collect()], float).reshape(400, 50)
    want = _flooded(z, 0.01)
    assert calls.value < 5_000 and got == {(i - 7, j): want[i, j] for i in range(400) for j in range(50)}


@pytest.mark.parametrize("tile", [4, 64])
def test_flats_drain_on_shortest_ways(spark, tile):
    z = np.full((9, 12), 5.0)
    z[4, 11] = 4.0
    z[0:3, 0:3] = np.nan
    z[1, 1] = 5.0  # alone
    flows = grid.resolve_flats(grid.d8(_frame(spark, z)), tile=tile)
    down = {(r.i, r.j): (r.down_i, r.down_j) for r in flows.collect()}
    assert down[1, 1] == down[4, 11] == (None, None)
    for at in down:
        if at in ((1, 1), (4, 11)):
            continue
        n, here = 0, at
        while here != (4, 11):
            here, n = down[here], n + 1
        assert n == max(abs(at[0] - 4), 11 - at[1])


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for unit in ("u", "v"):
        n = 120
        x = np.c_[rng.normal(3, 2, n), rng.normal(0, 1e-3, n), np.full(n, 7.0)]
        sim, y = rng.normal(10, 1, n), x[:, 0] * 0.8 + rng.normal(0, 0.3, n)
        rows += [(unit, k, float(sim[k] + y[k]), float(sim[k]), *map(float, x[k])) for k in range(n)]
        a, b = slice(0, 54), slice(54, 84)
        sd = x[a].std(0)
        z = np.c_[np.ones(n), (x - x[a].mean(0)) / np.where(sd < 1e-9, 1, sd)]
        best = None
        for penalty in residual.PENALTIES:
            w = np.linalg.solve(z[a].T @ z[a] + penalty * np.diag([0, 1, 1, 1]), z[a].T @ y[a])
            sse = ((z[b] @ w - y[b]) ** 2).sum()
            if best is None or sse < best[0]:
                best = (sse, penalty, w)
        obs, c = sim + y, slice(84, n)
        nse = lambda p: 1 - ((obs[c] - p[c]) ** 2).sum() / ((obs[c] - obs[c].mean()) ** 2).sum()  # noqa: B023, E731
        want[unit] = (*best, nse(sim), nse(sim + z @ best[2]))
    frame = spark.createDataFrame([*rows, ("v", 500, None, 1.0, 1.0, 1.0, 1.0), ("w", 1, 1.0, 1.0, 1.0, 1.0, 1.0)], "unit string, k int, obs double, sim double, a double, b double, c double")
    told = residual.phases(frame.dropna(), "unit", "k").selectExpr("*", "obs - sim as left")
    models = {r.unit: r for r in residual.fit(told, "unit", ["a", "b", "c"], "left").collect()}
    assert models.keys() == {"u", "v"}
    for unit, (sse, penalty, w, _, _) in want.items():
        assert models[unit].penalty == penalty and models[unit].sse == pytest.approx(sse, rel=1e-6) and np.allclose(models[unit].coefficients, w, rtol=1e-6, atol=1e-9)
    studied = {r.unit: r for r in residual.study(frame, "unit", "k", "obs", "sim", ["a", "b", "c"]).collect()}
    for unit, (_, _, _, base, corrected) in want.items():
        r = studied[unit]
        assert r.n_test == 36 and r.nse_base == pytest.approx(base) and r.nse_corrected == pytest.approx(corrected) and r.nse_corrected > 0.5 > r.nse_control
    assert studied["w"].nse_base is None
    assert residual.study(frame.limit(0), "unit", "k", "obs", "sim", ["a"]).count() == 0


def test_a_permuted_target_keeps_its_values(spark):
    rows = spark.createDataFrame([(u, k, "a" if k < 30 else "b", float(k)) for u in "xy" for k in range(60)], "unit string, k int, phase string, left double")
    got = residual.permuted(rows, "unit", "k", "left").collect()
    for u in "xy":
        for phase in "ab":
            mine = [(r.k, r.left) for r in got if r.unit == u and r.phase == phase]
            assert sorted(v for _, v in mine) == sorted(float(k) for k, _ in mine) and sum(k == v for k, v in mine) < 10


def test_names_match_by_tier_and_by_parts(spark):
    left = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "gam"), (4, "delta river"), (5, ""), (6, None), (7, "gam"), (8, "zz")], "id int, name string")
    right = spark.createDataFrame([(2, "other"), (10, "beta"), (11, "gamma"), (12, "x gam y"), (13, "delta"), (14, "river"), (15, ""), (16, None), (17, "alphabet"), (18, "alpha")], "id int, name string")
    got = {r.left_id: (r.right_id, r.tier) for r in series.match_names(left, right, "id", "name", "id", "name").collect()}
    assert got == {1: (18, 2), 2: (2, 1), 3: (11, 3), 4: (13, 3), 7: (11, 3)}


def test_orders_of_a_deep_forest(spark):
    """A long chain with branches: rounds follow the orders and not the depth."""
    rng = np.random.default_rng(8)
    parent = {0: None} | {k: (k - 1 if k < 60 else int(rng.integers(max(0, k - 90), k))) for k in range(1, 300)} | {900: None}
    above = {}
    for k, p in parent.items():
        above.setdefault(p, []).append(k)

    def order(k):
        found = sorted((order(x) for x in above.get(k, [])), reverse=True)
        return 1 if not found else found[0] + (len(found) > 1 and found[0] == found[1])

    forest = spark.createDataFrame(list(parent.items()), "id long, parent long")
    got = {r.id: r.stream_order for r in network.orders(forest).collect()}
    assert got == {k: order(k) for k in parent} and max(got.values()) > 2
    assert network.orders(forest.limit(0)).count() == 0
