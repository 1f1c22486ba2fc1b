"""Simulation and uncertainty queries: rain is the daily sum of an event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import metrics, models, search
from rivulet.plans.common import query, r
from rivulet.plans.series_plans import DAILY, daily

#: Potential evaporation of a day in mm; millimetres of rain for each unit of value.
EVAPORATION, SCALE = 3.0, 0.02


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select(F.col("station").alias("unit"), "ts", (F.col("value") * SCALE).alias("p"), F.lit(EVAPORATION).alias("e"))


def run(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    forced = models.forcing(rain(spark, sf_dir))
    return models.simulate(model, forced, forced.select("unit", F.lit(0).alias("sample")))


def flows(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    made = run(spark, sf_dir, model).select("unit", F.posexplode("q").alias("i", "q"))
    return made.select("unit", (F.col("i") + 1).alias("step"), r("q").alias("q"))


_T = {k: float(v[0]) for k, v in models.BOUNDS["tank"].items()}
TANK_SQL = f"""
WITH RECURSIVE r AS (SELECT station AS unit, value * {SCALE} AS p, row_number() OVER (PARTITION BY station ORDER BY ts) AS i FROM {DAILY}),
m AS (SELECT unit, 0::BIGINT AS i, 20.0::DOUBLE AS s1, 15.0::DOUBLE AS s2, 45.0::DOUBLE AS s3, 0.0::DOUBLE AS q, 0.0::DOUBLE AS e, 0.0::DOUBLE AS p FROM (SELECT DISTINCT unit FROM r) UNION ALL
 SELECT unit, i, d1, d2, g3 - o3, o1 + o2 + o3, e1 + e2, p FROM (SELECT *, {_T['A3']} * greatest(0, g3 - {_T['H3']}) AS o3 FROM (SELECT *, s3 + i2 AS g3, b2 - i2 AS d2 FROM (SELECT *, {_T['B2']} * greatest(0, b2 - {_T['H2I']}) AS i2 FROM (SELECT *, a2 - o2 AS b2 FROM (SELECT *, {_T['A2']} * greatest(0, a2 - {_T['H2']}) AS o2 FROM
 (SELECT *, g2 + i1 AS a2, b1 - i1 AS d1 FROM (SELECT *, {_T['B1']} * greatest(0, b1 - {_T['H1I']}) AS i1 FROM (SELECT *, a1 - o1 AS b1 FROM (SELECT *, {_T['A1']} * greatest(0, a1 - {_T['H1']}) AS o1 FROM (SELECT *, s2 - e2 AS g2 FROM (SELECT *, least(s2, {_T['EVP2']} * greatest(0, {EVAPORATION} - e1)) AS e2, g1 - e1 AS a1 FROM
 (SELECT *, least(g1, {EVAPORATION}) AS e1 FROM (SELECT m.unit, r.i, r.p, m.s1 + r.p AS g1, m.s2, m.s3 FROM m JOIN r ON r.unit = m.unit AND r.i = m.i + 1))))))))))))))"""


@query(TANK_SQL + " SELECT unit, i::INT AS step, round(q, 4) AS q FROM m WHERE i > 0")
def tank_model(spark, sf_dir):
    return flows(spark, sf_dir, "tank")


@query(TANK_SQL + " SELECT unit, round(sum(p), 4) AS p_sum, round(sum(e), 4) AS e_sum, round(sum(q), 4) AS q_sum, round(arg_max(s1 + s2 + s3, i) - 80, 4) AS storage_change, 0.0::DOUBLE AS closure FROM m GROUP BY unit")
def unit_closure(spark, sf_dir):
    made = run(spark, sf_dir, "tank").withColumn("q_sum", F.aggregate("q", F.lit(0.0), lambda a, x: a + x))
    closure = F.col("p_sum") + F.col("exchange") - F.col("e_sum") - F.col("q_sum") - F.col("storage_change")
    return made.select("unit", *[r(c).alias(c) for c in ("p_sum", "e_sum", "q_sum", "storage_change")], r(closure, 6).alias("closure"))


@query()
def model_comparison(spark, sf_dir):
    """All models on the same rain, held against the tank's flow."""
    base = flows(spark, sf_dir, "tank").select("unit", "step", F.col("q").alias("obs"))
    parts = None
    for name in ("xaj", "gr4j", "hbv", "tank"):
        part = flows(spark, sf_dir, name).select(F.lit(name).alias("model"), "unit", "step", F.col("q").alias("sim"))
        parts = part if parts is None else parts.unionByName(part)
    fit = metrics.fit_metrics(metrics.pairs(base, parts, ["unit", "step"]), ["model", "unit"])
    return fit.withColumns({c: r(c) for c in ("nse", "r2", "kge", "rmse", "pbias", "objective")})


#: Samples of a linear model q = a * p + b with low-discrepancy parameters.
GLUE_N = 100
GLUE_SQL = f"""
WITH s AS (SELECT i AS sample, 0.2 + 0.6 * (i * 0.6180339887 % 1) AS a, 2 * (i * 0.7548776662 % 1) AS b FROM (SELECT unnest(range(1, {GLUE_N + 1})) AS i)),
d AS (SELECT station AS unit, ts, value * {SCALE} AS p, 0.5 * value * {SCALE} + 1 + 0.3 * sin(day(ts)) AS obs FROM {DAILY}),
f AS (SELECT unit, ts, sample, a, b, obs, a * p + b AS sim FROM d, s),
n AS (SELECT unit, sample, any_value(a) AS a, any_value(b) AS b, 1 - sum((sim - obs) ** 2) / (var_pop(obs) * count(*)) AS nse FROM f GROUP BY unit, sample),
k AS (SELECT *, count(*) FILTER (nse >= 0.7) OVER (PARTITION BY unit) AS good, row_number() OVER (PARTITION BY unit ORDER BY nse DESC, sample) AS rk FROM n),
b AS (SELECT unit, sample, a, b, greatest(nse, 0) ** 2 AS weight FROM k WHERE CASE WHEN good >= 10 THEN nse >= 0.7 ELSE rk <= 10 END),
c AS (SELECT f.unit, ts, sim, obs, sum(weight) OVER (PARTITION BY f.unit, ts ORDER BY sim, f.sample ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY f.unit, ts) AS c FROM f JOIN b ON b.unit = f.unit AND b.sample = f.sample),
q AS (SELECT unit, ts, obs, qq, max((c, sim)) FILTER (c <= qq) AS lo, min((c, sim)) FILTER (c >= qq) AS hi FROM c, (VALUES (0.05), (0.5), (0.95)) v(qq) GROUP BY unit, ts, obs, qq),
v AS (SELECT unit, ts, obs, qq, CASE WHEN lo IS NULL THEN hi[2] WHEN hi IS NULL THEN lo[2] WHEN hi[1] > lo[1] THEN lo[2] + (qq - lo[1]) / (hi[1] - lo[1]) * (hi[2] - lo[2]) ELSE lo[2] END AS val FROM q),
w AS (SELECT unit, ts, obs, max(val) FILTER (qq = 0.05) AS q05, max(val) FILTER (qq = 0.5) AS q50, max(val) FILTER (qq = 0.95) AS q95 FROM v GROUP BY unit, ts, obs)"""


def _glue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Behavioural samples, all flows of these, observations."""
    fraction = lambda step: F.col("sample") * F.lit(step) % 1.0
    samples = spark.range(1, GLUE_N + 1).withColumnRenamed("id", "sample")
    samples = samples.withColumns({"a": fraction(0.6180339887) * 0.6 + 0.2, "b": fraction(0.7548776662) * 2})
    days = rain(spark, sf_dir).withColumn("obs", F.col("p") * 0.5 + 1 + F.sin(F.dayofmonth("ts").cast("double")) * 0.3)
    # every sample runs on every unit: the product is what GLUE evaluates
    made = days.join(F.broadcast(samples)).withColumn("sim", F.col("a") * F.col("p") + F.col("b"))
    fit = metrics.fit_metrics(made, ["unit", "sample"]).select("unit", "sample", "nse").join(samples, "sample")
    kept = search.behavioural(fit, ["unit"])
    return kept, made.join(kept.select("unit", "sample", "weight"), ["unit", "sample"]), days.select("unit", "ts", "obs")


@query(GLUE_SQL + " SELECT unit, ts, round(q05, 4) AS q05, round(q50, 4) AS q50, round(q95, 4) AS q95 FROM w")
def glue_weighted_quantiles(spark, sf_dir):
    _, made, _ = _glue(spark, sf_dir)
    return search.weighted_quantiles(made, ["unit", "ts"], "sim", "weight").withColumns({c: r(c) for c in ("q05", "q50", "q95")})


@query(GLUE_SQL + " SELECT unit, round(avg(CASE WHEN obs BETWEEN q05 AND q95 THEN 1.0 ELSE 0.0 END), 4) AS coverage, count(*) AS n FROM w GROUP BY unit")
def glue_coverage(spark, sf_dir):
    _, made, obs = _glue(spark, sf_dir)
    bands = search.weighted_quantiles(made, ["unit", "ts"], "sim", "weight")
    return search.band_coverage(bands, obs, ["unit", "ts"], ["unit"]).withColumn("coverage", r("coverage"))


@query(GLUE_SQL + " SELECT unit, 'a' AS param, round(min(a), 4)::DOUBLE AS low, round(max(a), 4)::DOUBLE AS high FROM b GROUP BY unit UNION ALL SELECT unit, 'b', round(min(b), 4)::DOUBLE, round(max(b), 4)::DOUBLE FROM b GROUP BY unit")
def glue_ranges(spark, sf_dir):
    kept, _, _ = _glue(spark, sf_dir)
    return search.posterior_ranges(kept, ["unit"], ["a", "b"]).withColumns({"low": r("low"), "high": r("high")})


@query()
def glue_model(spark, sf_dir):
    """Bands of the GR4J model over 200 hashed samples, for observations from its default parameters."""
    bounds = {k: (v[1], v[2]) for k, v in models.BOUNDS["gr4j"].items()}
    forced = models.forcing(rain(spark, sf_dir))
    samples = forced.select("unit").join(F.broadcast(search.uniform_samples(spark, 200, bounds)))
    made = models.simulate("gr4j", forced, samples).select("unit", "sample", F.posexplode("q").alias("step", "sim"))
    obs = models.simulate("gr4j", forced, forced.select("unit", F.lit(0).alias("sample"))).select("unit", F.posexplode("q").alias("step", "obs"))
    fit = metrics.fit_metrics(metrics.pairs(obs, made, ["unit", "step"]), ["unit", "sample"]).select("unit", "sample", "nse")
    kept = made.join(search.behavioural(fit, ["unit"]).select("unit", "sample", "weight"), ["unit", "sample"])
    return search.weighted_quantiles(kept, ["unit", "step"], "sim", "weight").withColumns({c: r(c) for c in ("q05", "q50", "q95")})


@query(f"SELECT unit, round(max(q), 4) AS peak, round(avg(q), 4) AS mean_q, round(sum(q), 4) AS depth FROM (SELECT station AS unit, value * {SCALE} AS q FROM {DAILY}) GROUP BY unit")
def forecast_summary(spark, sf_dir):
    out = search.forecast_summary(rain(spark, sf_dir), ["unit"], q="p")
    return out.select("unit", *[r(c).alias(c) for c in ("peak", "mean_q", "depth")])
