"""What a model leaves over, learned by ridge regression for every unit: phases, fits over several penalties, a permuted control.

Every unit's products are summed in one aggregation, also those of the phase on which the penalty is chosen: the squared
errors of all penalties follow from sums, so no row is read again for them. What is solved is a small system for each unit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the first two phases, and the penalties that are tried.
SHARES, PENALTIES = (0.45, 0.25), (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


def phases(rows: DataFrame, unit: str, order: str, shares: Sequence[float] = SHARES) -> DataFrame:
    """``rows`` with ``phase``: of each unit's n rows by ``order`` the first floor(n * share) are a, up to floor(n * both shares) b, the rest c."""
    mine = Window.partitionBy(unit)
    k, n = F.row_number().over(mine.orderBy(order)) - 1, F.count("*").over(mine)
    placed = rows.withColumns({"_k": k, "_n": n})
    first, second = F.floor(F.col("_n") * shares[0] + 1e-9), F.floor(F.col("_n") * (shares[0] + shares[1]) + 1e-9)
    return placed.withColumn("phase", F.when(F.col("_k") < first, "a").when(F.col("_k") < second, "b").otherwise("c")).drop("_k", "_n")


def _scaled(features: Sequence[str]) -> list[Column]:
    """Features less their mean, by their deviation; those without deviation are left as they are but for the mean."""
    return [(F.col(f) - F.get("mean", F.lit(i))) / F.get("deviation", F.lit(i)) for i, f in enumerate(features)]


def moments(rows: DataFrame, unit: str, features: Sequence[str]) -> DataFrame:
    """(unit, mean, deviation): of each feature over phase a, as arrays in their order; a deviation below 1e-9 counts as 1."""
    sums = rows.where("phase = 'a'").groupBy(unit).agg(F.array(*[F.avg(f) for f in features]).alias("mean"), F.array(*[F.stddev_pop(f) for f in features]).alias("_ds"))
    return sums.select(unit, "mean", F.transform("_ds", lambda d: F.when(d < 1e-9, 1.0).otherwise(d)).alias("deviation"))


def fit(rows: DataFrame, unit: str, features: Sequence[str], target: str, penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """(unit, n, mean, deviation, coefficients, penalty, sse): ridge regression on phase a, the penalty with the least squared error on phase b (ties: the smaller).

    The first coefficient is the intercept, which is not penalised; the others are of scaled features. Rows with a null take no
    part. A unit without rows in b takes the smallest penalty; one without rows in a has no model.
    """
    full = rows.dropna(subset=[unit, *features, target])
    scale = moments(full, unit, features)
    d = len(features) + 1
    names = [f"_x{i}" for i in range(d)]
    x = full.join(scale, unit).select(unit, "phase", F.lit(1.0).alias("_x0"), *[c.alias(f"_x{i + 1}") for i, c in enumerate(_scaled(features))], F.col(target).cast("double").alias("_y"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def sums(phase: str) -> list[Column]:
        here = lambda v: F.coalesce(F.sum(F.when(F.col("phase") == phase, v)), F.lit(0.0))
        return [F.array(*[here(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias(f"xx_{phase}"), F.array(*[here(F.col(n) * F.col("_y")) for n in names]).alias(f"xy_{phase}"), here(F.col("_y") * F.col("_y")).alias(f"yy_{phase}")]

    summed = x.groupBy(unit).agg(F.count_if(F.col("phase") == "a").alias("n"), *sums("a"), *sums("b")).join(scale, unit)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def square(flat) -> np.ndarray:
            out = np.zeros((d, d))
            for (i, j), v in zip(pairs, flat, strict=True):
                out[i, j] = out[j, i] = v
            return out

        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                a, b, best = square(row.xx_a), square(row.xx_b), None
                for penalty in penalties:
                    ridge = penalty * np.eye(d)
                    ridge[0, 0] = 0
                    lower = np.linalg.cholesky(a + ridge)
                    w = np.linalg.solve(lower.T, np.linalg.solve(lower, np.array(row.xy_a)))
                    sse = w @ b @ w - 2 * w @ np.array(row.xy_b) + row.yy_b
                    if best is None or sse < best[2]:
                        best = (w.tolist(), penalty, max(float(sse), 0.0))
                found.append(best)
            yield batch[[unit, "n", "mean", "deviation"]].assign(coefficients=[f[0] for f in found], penalty=[f[1] for f in found], sse=[f[2] for f in found])

    kind = dict(rows.dtypes)[unit]
    return summed.where("n > 0").mapInPandas(solve, f"{unit} {kind}, n long, mean array<double>, deviation array<double>, coefficients array<double>, penalty double, sse double")


def predict(rows: DataFrame, models: DataFrame, unit: str, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``predicted``; null where a feature is or the unit has no model."""
    known = rows.join(models.select(unit, "mean", "deviation", "coefficients"), unit, "left")
    total = F.get("coefficients", F.lit(0))
    for i, c in enumerate(_scaled(features)):
        total = total + F.get("coefficients", F.lit(i + 1)) * c
    return known.withColumn("predicted", total).drop("mean", "deviation", "coefficients")


def permuted(rows: DataFrame, unit: str, order: str, target: str, seed: int = 7) -> DataFrame:
    """``rows`` whose targets are dealt anew within each unit and phase, by a hash of ``order``: what features then tell is chance."""
    mine = Window.partitionBy(unit, "phase")
    numbered = rows.withColumn("_n", F.row_number().over(mine.orderBy(order)))
    dealt = rows.select(unit, "phase", F.col(target).alias("_dealt"), F.row_number().over(mine.orderBy(F.xxhash64(F.col(order).cast("string"), F.lit(seed)), order)).alias("_n"))
    return numbered.join(dealt, [unit, "phase", "_n"]).withColumn(target, F.col("_dealt")).drop("_n", "_dealt")


def study(rows: DataFrame, unit: str, order: str, observed: str, simulated: str, features: Sequence[str], penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """(unit, penalty, n_test, nse_base, nse_corrected, nse_control): how well a simulation, one corrected by its learned residual and one by that of permuted residuals fit phase c.

    Rows with a null in any of the columns take no part. Where phase c has one value only, the measures are null.
    """
    full = rows.select(unit, order, F.col(observed).cast("double").alias("_obs"), F.col(simulated).cast("double").alias("_sim"), *features).dropna()
    told = phases(full, unit, order).withColumn("_left", F.col("_obs") - F.col("_sim"))
    models = fit(told, unit, features, "_left", penalties)
    control = fit(permuted(told, unit, order, "_left"), unit, features, "_left", penalties)
    tested = predict(told.where("phase = 'c'"), models, unit, features).withColumnRenamed("predicted", "_p")
    tested = predict(tested, control, unit, features)
    spread = F.count("*") * F.var_pop("_obs")
    nse = lambda v: (1 - F.try_divide(F.sum((F.col("_obs") - v) * (F.col("_obs") - v)), spread))
    measured = tested.groupBy(unit).agg(F.count("*").alias("n_test"), nse(F.col("_sim")).alias("nse_base"), nse(F.col("_sim") + F.col("_p")).alias("nse_corrected"), nse(F.col("_sim") + F.col("predicted")).alias("nse_control"))
    return measured.join(models.select(unit, "penalty"), unit, "left").select(unit, "penalty", "n_test", "nse_base", "nse_corrected", "nse_control")
