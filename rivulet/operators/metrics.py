"""Goodness of fit of paired observed and simulated values, all in one combined aggregation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs below which no metric is told; objective where none is.
LEAST_PAIRS, NO_FIT = 3, 1e6


def pairs(obs: DataFrame, sim: DataFrame, on: list[str]) -> DataFrame:
    """(on..., obs, sim) where both are finite."""
    both = obs.join(sim, on)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return both.where(finite("obs") & finite("sim"))


def fit_metrics(paired: DataFrame, by: list[str], obs: str = "obs", sim: str = "sim") -> DataFrame:
    """n, nse, r2, kge, rmse, pbias and the calibration objective of each group; null where they are not defined."""
    o, s = F.col(obs), F.col(sim)
    sums = paired.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.pow(s - o, 2)).alias("_se"), (F.var_pop(o) * F.count("*")).alias("_so"), F.corr(s, o).alias("_r"),
        F.stddev_pop(o).alias("_do"), F.stddev_pop(s).alias("_ds"), F.avg(o).alias("_mo"), F.avg(s).alias("_ms"), F.sum(o).alias("_o"), F.sum(s).alias("_s"),
    )
    c, enough = F.col, F.col("n") >= LEAST_PAIRS
    r = F.when(F.isnan("_r"), None).otherwise(c("_r"))
    alpha, beta = F.try_divide("_ds", "_do"), F.try_divide("_ms", "_mo")
    out = sums.withColumns({
        "nse": F.when(enough & (c("_so") > 0), 1 - c("_se") / c("_so")), "r2": F.when(enough, r * r),
        "kge": F.when(enough, 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2))),
        "rmse": F.sqrt(c("_se") / c("n")), "pbias": F.when(c("_o") > 0, (c("_s") - c("_o")) / c("_o") * 100),
    })
    out = out.withColumn("objective", F.when(c("nse").isNull(), F.lit(NO_FIT)).otherwise(objective(c("nse"), c("pbias"), c("rmse"), c("_do"))))
    return out.select(*by, "n", "nse", "r2", "kge", "rmse", "pbias", "objective")


def objective(nse: Column, pbias: Column, rmse: Column, spread: Column) -> Column:
    """What calibration minimises."""
    return 1 - nse + 0.3 * F.abs(F.coalesce(pbias, F.lit(0.0))) / 100 + 0.1 * F.coalesce(F.try_divide(rmse, spread), F.lit(0.0))


def peaks(series: DataFrame, key: str = "station", value: str = "value", most: int = 5, apart: int = 10, factor: float = 1.5) -> DataFrame:
    """(key, rank, pos, value): the highest steps, taken in order of value, each ``apart`` steps from those taken and (but for the first) ``factor`` times the mean.

    ``series`` has the step number ``pos``. Taking one excludes others, so order matters; a kernel takes a series' own
    candidates (steps above the bound or at the maximum), never the whole series.
    """
    whole = Window.partitionBy(key)
    some = series.withColumn("_bound", F.avg(value).over(whole) * factor).withColumn("_top", F.max(value).over(whole))
    some = some.where((F.col(value) >= F.col("_bound")) | (F.col(value) == F.col("_top"))).select(key, "pos", value)

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        rows = rows.sort_values([value, "pos"], ascending=[False, True])
        for i, pos in enumerate(rows.pos):
            if len(taken) < most and all(abs(pos - rows.pos.iloc[j]) >= apart for j in taken):
                taken.append(i)
        return rows.iloc[taken].assign(rank=range(1, len(taken) + 1))[[key, "rank", "pos", value]]

    kinds = dict(series.dtypes)
    return some.groupBy(key).applyInPandas(take, f"{key} {kinds[key]}, rank int, pos {kinds['pos']}, {value} {kinds[value]}")


def peak_errors(found: DataFrame, sim: DataFrame, key: str = "station", value: str = "value", reach: int = 15) -> DataFrame:
    """Per peak: steps by which the largest simulated value within ``reach`` comes late, and its relative error."""
    near = found.alias("o").join(sim.select(key, F.col("pos").alias("sim_pos"), F.col("sim")), key).where(F.col("sim_pos").between(F.col("pos") - reach, F.col("pos") + reach))
    best = near.groupBy(key, "rank", "pos", value).agg(F.max(F.struct("sim", (-F.col("sim_pos")).alias("early"))).alias("m"))
    return best.select(key, "rank", "pos", value, (-F.col("m.early") - F.col("pos")).alias("late"), ((F.col("m.sim") - F.col(value)) / F.col(value)).alias("relative_error"))


def split_periods(series: DataFrame, key: str, order: list[str], warmup: int = 0, share: float = 0.7) -> DataFrame:
    """``series`` with pos from 0 and period: warmup for the first steps, then calibration for ``share`` of the rest (rounded down), then validation."""
    mine = Window.partitionBy(key)
    placed = series.withColumn("pos", F.row_number().over(mine.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(mine))
    until = F.floor(warmup + (F.col("_n") - warmup) * F.lit(share))
    period = F.when(F.col("pos") < warmup, "warmup").when(F.col("pos") < until, "calibration").otherwise("validation")
    return placed.withColumn("period", period).drop("_n")


def relative_errors(truth: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(on..., truth, found, error) of values (on..., value) that both have; the error is relative to the size of the truth, null where that is 0."""
    both = truth.select(*on, F.col("value").alias("truth")).join(found.select(*on, F.col("value").alias("found")), on)
    return both.withColumn("error", F.try_divide(F.col("found") - F.col("truth"), F.abs("truth")))


def error_summary(errors: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """Per group: n, median, least, greatest and worst (greatest absolute) error."""
    return errors.groupBy(*by).agg(F.count(error).alias("n"), F.median(error).alias("median"), F.min(error).alias("least"), F.max(error).alias("greatest"), F.max(F.abs(error)).alias("worst"))
