"""Calibration and uncertainty: samples, behavioural sets, weighted bands, evolution of complexes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.operators.lineage import cut

#: Least efficiency of a behavioural sample; samples that are behavioural in any case; quantiles of the bands.
BEHAVIOURAL, LEAST_BEHAVIOURAL, BANDS = 0.7, 10, (0.05, 0.5, 0.95)


def uniform_samples(spark: SparkSession, n: int, bounds: dict[str, tuple[float, float]], seed: int = 1) -> DataFrame:
    """(sample, parameters) uniform within bounds; a value depends on seed, sample and name alone, so a lost task makes the same ones again."""
    unit = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(1 << 53)) / float(1 << 53)
    return spark.range(n).select(F.col("id").alias("sample"), *[(F.lit(float(a)) + unit(k) * (b - a)).alias(k) for k, (a, b) in bounds.items()])


def behavioural(scores: DataFrame, by: list[str], score: str = "nse", least: float = BEHAVIOURAL, fewest: int = LEAST_BEHAVIOURAL) -> DataFrame:
    """Rows with ``weight`` (squared score): samples that reach ``least``; where they are fewer than ``fewest``, the best tenth (and at least ``fewest``)."""
    whole = Window.partitionBy(*by)
    ranked = scores.withColumns({"_good": F.count_if(F.col(score) >= least).over(whole), "_n": F.count("*").over(whole), "_rank": F.row_number().over(whole.orderBy(F.desc(score), "sample"))})
    top = F.greatest(F.call_function("div", F.col("_n"), F.lit(10)), F.lit(fewest))
    kept = ranked.where(F.when(F.col("_good") >= fewest, F.col(score) >= least).otherwise(F.col("_rank") <= top))
    raw = F.pow(F.greatest(F.col(score), F.lit(0.0)), 2)
    kept = kept.withColumn("_raw", raw)
    return kept.withColumn("weight", F.when(F.sum("_raw").over(whole) > 0, F.col("_raw")).otherwise(1.0)).drop("_good", "_n", "_rank", "_raw")


def weighted_quantiles(rows: DataFrame, by: list[str], value: str, weight: str, at: tuple[float, ...] = BANDS) -> DataFrame:
    """(by..., q05, ...): values interpolated over the running share of weight in order of value; ends are the ends' values."""
    order = Window.partitionBy(*by).orderBy(value, "sample")
    run = rows.withColumn("_c", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy(*by)))
    point = F.struct(F.col("_c").alias("c"), F.col(value).alias("v"))

    def between(q: float) -> list[Column]:
        return [F.max(F.when(F.col("_c") <= q, point)).alias(f"_a{q}"), F.min(F.when(F.col("_c") >= q, point)).alias(f"_b{q}")]

    found = run.groupBy(*by).agg(*[c for q in at for c in between(q)])

    def made(q: float) -> Column:
        a, b = F.col(f"`_a{q}`"), F.col(f"`_b{q}`")
        slope = F.when(b["c"] > a["c"], (q - a["c"]) / (b["c"] - a["c"])).otherwise(0.0)
        return F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + slope * (b["v"] - a["v"]))

    return found.select(*by, *[made(q).alias(f"q{round(q * 100):02d}") for q in at])


def band_coverage(bands: DataFrame, obs: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """(by..., coverage, n): share of observations within the outer bands."""
    inside = F.when(F.col("obs").between(F.col("q05"), F.col("q95")), 1.0).otherwise(0.0)
    return bands.join(obs, on).where("obs is not null").groupBy(*by).agg(F.avg(inside).alias("coverage"), F.count("*").alias("n"))


def posterior_ranges(kept: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by..., param, low, high) of the behavioural samples."""
    return kept.unpivot(by, names, "param", "value").groupBy(*by, "param").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def complex_evolution(
    spark: SparkSession, objective: Callable[[np.ndarray], np.ndarray], bounds: dict[str, tuple[float, float]], max_evals: int = 3000, tol: float = 1e-4, seed: int = 1, complexes: int | None = None
) -> tuple[dict[str, float], float, list[float]]:
    """Shuffled complex evolution: best parameters, their objective, and the best of each generation.

    ``objective`` takes points [n, dim]. A generation is one Spark job: each complex (a block of the sorted population)
    evolves in a task of its own. The population has complexes x (2 dim + 1) points, a size that data don't change.
    """
    names, low, high = list(bounds), np.array([b[0] for b in bounds.values()], float), np.array([b[1] for b in bounds.values()], float)
    dim = len(names)
    size, sub, groups = 2 * dim + 1, dim + 1, complexes or max(2, dim)

    def safe(points: np.ndarray) -> np.ndarray:
        scores = np.asarray(objective(points), float)
        return np.where(np.isfinite(scores), scores, 1e6)

    def evolve(rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(rows.generation.iloc[0]), int(rows.complex.iloc[0])])
        x, f = np.array(rows.point.tolist()), rows.score.to_numpy().copy()
        if np.isnan(f).any():
            f = safe(x)
        else:
            chance = 2.0 * (size - np.arange(size)) / (size * (size + 1))
            for _ in range(size):
                order = np.argsort(f, kind="stable")
                x, f = x[order], f[order]
                chosen = np.sort(rng.choice(size, sub, replace=False, p=chance))
                worst, centre = chosen[-1], x[chosen].mean(0)
                for guess in (2 * centre - x[worst], (centre + x[worst]) / 2, low + rng.random(dim) * (high - low)):
                    guess = np.clip(guess, low, high)
                    score = safe(guess[None])[0]
                    if score < f[worst]:
                        break
                x[worst], f[worst] = guess, score  # a random point is taken even if it is worse
        return pd.DataFrame({"point": list(x), "score": f})

    start = low + np.random.default_rng(seed).random((groups * size, dim)) * (high - low)
    population = spark.createDataFrame([(p.tolist(), float("nan")) for p in start], "point array<double>, score double")
    evals, history = groups * size, []
    for generation in range(10_000):
        ranked = population.withColumn("_i", F.row_number().over(Window.orderBy("score", "point")) - 1)
        dealt = ranked.select("point", "score", F.call_function("div", F.col("_i"), F.lit(size)).cast("int").alias("complex"), F.lit(generation).alias("generation"))
        population = cut(dealt.groupBy("complex").applyInPandas(evolve, "point array<double>, score double"))
        best = population.orderBy("score", "point").limit(1).head()
        history.append(best.score)
        evals += 2 * groups * size if generation else 0
        if evals >= max_evals or (len(history) > 6 and abs(history[-6] - history[-1]) < tol):
            break
    return dict(zip(names, best.point, strict=True)), best.score, history


def forecast_summary(flows: DataFrame, by: list[str], ts: str = "ts", q: str = "q") -> DataFrame:
    """Peak, its time, mean and depth (sum) over the horizon, at full resolution."""
    return flows.groupBy(*by).agg(F.max(q).alias("peak"), F.max_by(ts, F.struct(F.col(q), -F.unix_seconds(F.col(ts).cast("timestamp")))).alias("peak_ts"), F.avg(q).alias("mean_q"), F.sum(q).alias("depth"))
