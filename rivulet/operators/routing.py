"""Flow routing: channel filters, linear reservoirs and unit hydrographs over ordered series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most segments of a reach.
SEGMENTS = 40


def segments(k_hours: float, dt_hours: float) -> int:
    """Segments of a reach: each is passed in half a step at most, up to SEGMENTS."""
    return min(SEGMENTS, max(1, math.ceil(k_hours / (dt_hours / 2)))) if k_hours > 0 else 1


def coefficients(k_hours: float, x: float, dt_hours: float) -> tuple[float, float, float]:
    """Weights of this inflow, the last inflow and the last outflow in a segment; none negative, their sum 1."""
    k, x = max(k_hours, dt_hours / 2), min(max(x, -0.2), 0.45)
    raw = np.maximum([dt_hours / 2 - k * x, dt_hours / 2 + k * x, k * (1 - x) - dt_hours / 2], 0.0)
    return tuple(float(c) for c in (raw / raw.sum() if raw.sum() > 0 else (0.0, 1.0, 0.0)))


def route(series: DataFrame, k_hours: float, x: float, dt_hours: float, key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``routed``. Where the outflow's own weight is 0 (all but long reaches at short steps) the segments are a chain of lags, else one pass per series."""
    n = segments(k_hours, dt_hours)
    c0, c1, c2 = coefficients(k_hours / n, x, dt_hours)
    if c2 > 1e-12:
        return _route_recursive(series, n, (c0, c1, c2), key, ts, value)
    order = Window.partitionBy(key).orderBy(ts)
    # n segments of two taps are n + 1 binomial taps; before the series stands its first value
    taps = [math.comb(n, k) * c0 ** (n - k) * c1**k for k in range(n + 1)]
    first = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    terms = [F.coalesce(F.lag(value, k).over(order), first) * w if k else F.col(value) * w for k, w in enumerate(taps)]
    return series.withColumn("routed", sum(terms[1:], terms[0]))


def _route_recursive(series: DataFrame, n: int, c: tuple, key: str, ts: str, value: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ts)
        flow = rows[value].to_numpy(float)
        for _ in range(n):
            out, last = flow.copy(), flow[0]
            for t in range(1, len(flow)):
                last = out[t] = c[0] * flow[t] + c[1] * flow[t - 1] + c[2] * last
            flow = out
        return rows.assign(routed=flow)

    schema = ", ".join(f"`{f}` {t}" for f, t in series.dtypes) + ", routed double"
    return series.groupBy(key).applyInPandas(run, schema)


def reservoir(series: DataFrame, k: float, start: float = 0.0, key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """Per series the arrays of a linear reservoir: out = (1 - k) store, then store = k store + inflow. Rows (key, ts, inflow, out, store)."""
    listed = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(value).cast("double").alias("inflow")))).alias("s"))
    zero = F.struct(F.lit(start).alias("store"), F.array().cast("array<struct<ts:timestamp_ntz,inflow:double,out:double,store:double>>").alias("rows"))

    def step(state: Column, x: Column) -> Column:
        store = state["store"] * k + x["inflow"]
        row = F.struct(x["ts"].alias("ts"), x["inflow"].alias("inflow"), (state["store"] * (1 - k)).alias("out"), store.alias("store"))
        return F.struct(store.alias("store"), F.concat(state["rows"], F.array(row)).alias("rows"))

    return listed.select(key, F.inline(F.aggregate("s", zero, step)["rows"]))


def s_curve(x: float, base: float) -> float:
    """Share of a triangular unit hydrograph that has left after ``x``."""
    r = min(max(x / base, 0.0), 1.0)
    return 2 * r * r if r <= 0.5 else 1 - 2 * (1 - r) ** 2


def unit_hydrograph(series: DataFrame, base: float, dt: float = 1.0, key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``routed``: the series convolved with a triangular unit hydrograph, which answers one step after its inflow."""
    order = Window.partitionBy(key).orderBy(ts)
    base = max(base, dt)
    parts = [s_curve(k * dt, base) - s_curve((k - 1) * dt, base) for k in range(1, math.ceil(base / dt) + 1)]
    terms = [F.coalesce(F.lag(value, k).over(order), F.lit(0.0)) * w for k, w in enumerate(parts, 1)]
    return series.withColumn("routed", sum(terms[1:], terms[0]))
