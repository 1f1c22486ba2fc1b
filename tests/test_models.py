"""Closure, limits and recovery of the rainfall-runoff kernels and the search."""

import numpy as np
import pandas as pd
import pytest

from rivulet.operators import models, routing, search


def _params(model, n, seed):
    rng = np.random.default_rng(seed)
    return models.complete(model, pd.DataFrame({k: rng.uniform(v[1], v[2], n) for k, v in models.BOUNDS[model].items()}))


@pytest.mark.parametrize("model", sorted(models.MODELS))
@pytest.mark.parametrize("seed", range(3))
def test_water_balance_closes(model, seed):
    rng = np.random.default_rng(seed)
    p, e = rng.gamma(0.7, 9.0, 300), rng.uniform(0.2, 5.0, 300)
    q, p_sum, e_sum, change, exchange = models.MODELS[model](p, e, _params(model, 40, seed))
    assert np.abs(p_sum + exchange - e_sum - q.sum(0) - change).max() < 1e-8
    assert q.min() >= -1e-12


@pytest.mark.parametrize("t", [np.full(200, -5.0), np.full(200, 25.0), np.full(200, np.nan), np.zeros(7), None])
def test_snow_closes_at_any_temperature(t):
    rng = np.random.default_rng(5)
    q, p_sum, e_sum, change, _ = models.hbv(rng.gamma(0.8, 6.0, 200), rng.uniform(0.5, 6.0, 200), _params("hbv", 20, 3), t)
    assert np.abs(p_sum - e_sum - q.sum(0) - change).max() < 1e-8


@pytest.mark.parametrize("model", sorted(models.MODELS))
def test_more_rain_gives_more_flow(model):
    rng = np.random.default_rng(2)
    p, e = rng.gamma(0.7, 9.0, 200), rng.uniform(0.2, 5.0, 200)
    x = models.complete(model, pd.DataFrame(index=range(1)))
    assert models.MODELS[model](2 * p, e, x)[0].sum() > models.MODELS[model](p, e, x)[0].sum()


def test_parameters_are_completed_and_clamped():
    x = models.complete("gr4j", pd.DataFrame({"X1": [1e9, np.nan], "odd": [1, 2]}))
    assert x["X1"].tolist() == [1200, 350] and x["X4"].tolist() == [1.7, 1.7] and "odd" not in x


@pytest.mark.parametrize("k", [6.0, 48.0])
def test_routing_keeps_volume_of_a_pulse(spark, k):
    rows = [("a", i, 100.0 if i == 5 else 0.0) for i in range(120)]
    got = routing.route(spark.createDataFrame(rows, "station string, ts long, value double"), k, 0.2, 1.0).toPandas().sort_values("ts")
    assert got.routed.sum() == pytest.approx(100.0, rel=1e-3)
    assert got.routed.iloc[:5].abs().max() < 1e-12


def test_the_filter_equals_the_recursion(spark):
    rng = np.random.default_rng(1)
    series = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.gamma(1.5, 40, 50))], "station string, ts long, value double")
    n, c = routing.segments(36, 24), routing.coefficients(12, 0.2, 24)
    a = routing.route(series, 36, 0.2, 24).toPandas().sort_values("ts")
    b = routing._route_recursive(series, n, c, "station", "ts", "value").toPandas().sort_values("ts")
    assert np.allclose(a.routed, b.routed)


def test_complex_evolution_recovers_parameters(spark):
    rng = np.random.default_rng(4)
    p, e = rng.gamma(0.7, 9.0, 120), rng.uniform(0.2, 5.0, 120)
    truth = models.gr4j(p, e, models.complete("gr4j", pd.DataFrame(index=range(1))))[0][:, 0]

    def objective(points):
        q = models.gr4j(p, e, models.complete("gr4j", pd.DataFrame(points, columns=list(models.BOUNDS["gr4j"]))))[0]
        return ((q - truth[:, None]) ** 2).sum(0) / ((truth - truth.mean()) ** 2).sum()

    best, score, history = search.complex_evolution(spark, objective, {k: (v[1], v[2]) for k, v in models.BOUNDS["gr4j"].items()}, max_evals=900, complexes=3)
    assert score < 0.1 and history == sorted(history, reverse=True) and set(best) == set(models.BOUNDS["gr4j"])
