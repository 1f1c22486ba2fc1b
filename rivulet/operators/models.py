"""Rainfall-runoff models as kernels that step through time for many parameter sets at once.

Spark deals out the units and samples; a kernel's state is an array over the rows of a batch that share their forcing.
Stores are in mm, fluxes in mm a step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default, least and greatest value of each parameter.
BOUNDS: dict[str, dict[str, tuple[float, float, float]]] = {
    "xaj": {"K": (0.85, 0.5, 1.2), "B": (0.3, 0.1, 0.7), "SM": (30, 5, 120), "EX": (1.5, 1, 1.8), "KGF": (0.5, 0.25, 0.75), "CG": (0.985, 0.93, 0.998), "CI": (0.7, 0.4, 0.9), "CS": (0.3, 0.05, 0.6)},
    "gr4j": {"X1": (350, 100, 1200), "X2": (0, -5, 3), "X3": (90, 20, 300), "X4": (1.7, 1.1, 2.9)},
    "tank": {"H1": (12, 0, 60), "A1": (0.15, 0.01, 0.6), "H1I": (6, 0, 60), "B1": (0.06, 0.005, 0.5), "H2": (10, 0, 60), "A2": (0.08, 0.005, 0.5), "H2I": (4, 0, 60), "B2": (0.04, 0.002, 0.4), "H3": (35, 0, 120), "A3": (0.012, 0.001, 0.15), "EVP2": (0.35, 0, 1)},
    "hbv": {"FC": (250, 50, 900), "LP": (0.9, 0.3, 1), "BETA": (2, 0.5, 6), "CET": (1, 0.4, 1.6), "TT": (0, -2.5, 2.5), "CFMAX": (3, 0.5, 12), "SFCF": (1, 0.4, 1.6), "CWH": (0.1, 0, 0.2), "CFR": (0.05, 0, 0.1), "K0": (0.3, 0.02, 0.8), "K1": (0.1, 0.005, 0.5), "K2": (0.02, 0.001, 0.15), "UZL": (20, 0, 100), "PERC": (2, 0, 12), "MAXBAS": (3, 0.5, 8)},
}

Params = dict[str, np.ndarray]
Result = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tank(p: np.ndarray, e0: np.ndarray, x: Params, t: np.ndarray | None = None, dt: float = 1.0) -> Result:
    """Three tanks one above another."""
    n = len(x["H1"])
    s = [np.full(n, v) for v in (20.0, 15.0, 45.0)]
    start, q, e = sum(s), np.empty((len(p), n)), np.zeros(n)
    over = lambda rate, store, sill: rate * np.maximum(0, store - sill)
    for i, rain in enumerate(p):
        s[0] = s[0] + rain
        e1 = np.minimum(s[0], e0[i])
        s[0] = s[0] - e1
        e2 = np.minimum(s[1], x["EVP2"] * np.maximum(0, e0[i] - e1))
        s[1] = s[1] - e2
        out = []
        for k, (rate, sill, down, low) in enumerate((("A1", "H1", "B1", "H1I"), ("A2", "H2", "B2", "H2I"))):
            side = over(x[rate], s[k], x[sill])
            s[k] = s[k] - side
            drop = over(x[down], s[k], x[low])
            s[k], s[k + 1] = s[k] - drop, s[k + 1] + drop
            out.append(side)
        side = over(x["A3"], s[2], x["H3"])
        s[2] = s[2] - side
        q[i], e = out[0] + out[1] + side, e + e1 + e2
    return q, np.full(n, p.sum()), e, sum(s) - start, np.zeros(n)


def xaj(p: np.ndarray, e0: np.ndarray, x: Params, t: np.ndarray | None = None, dt: float = 1.0) -> Result:
    """Saturation excess with three soil layers and three reservoirs."""
    # Storage capacities (whole, upper, lower, deep), deep evaporation, impervious share, free-water outflow.
    wm, um, lm, dm, c, imp, kss = 140.0, 20.0, 60.0, 60.0, 0.15, 0.01, 0.7
    n = len(x["K"])
    wu, wl, wd, s = (np.full(n, v) for v in (20.0, 60.0, 60.0, 5.0))
    stores = [np.zeros(n) for _ in range(3)]
    start, q, e_sum = wu + wl + wd + s, np.empty((len(p), n)), np.zeros(n)
    b = np.maximum(x["B"], 0.05)
    wmm = wm * (1 + b)
    for i, rain in enumerate(p):
        ep = x["K"] * max(0.0, e0[i])
        enough = wu + rain >= ep
        eu = np.where(enough, ep, wu + rain)
        rest = ep - eu
        el = np.where(wl >= c * lm, rest * wl / lm, np.where(wl >= c * rest, c * rest, wl))
        ed = np.where((wl >= c * lm) | (wl >= c * rest), 0.0, np.maximum(0, c * rest - el))
        e = np.minimum(np.where(enough, eu, eu + el + ed), wu + wl + wd + rain)
        quick = imp * rain
        pe = rain - e - quick
        w = np.clip(wu + wl + wd, 0, wm)
        a = wmm * (1 - np.maximum(0, 1 - w / wm) ** (1 / (1 + b)))
        part = pe - (wm - w) + wm * np.maximum(0, 1 - (pe + a) / wmm) ** (b + 1)
        r = np.where(pe <= 0, 0.0, np.maximum(0, np.where(pe + a < wmm, part, pe - (wm - w))))
        w = np.clip(w + pe - r, 0, wm)
        wu = np.minimum(um, w)
        wl = np.minimum(lm, w - wu)
        wd = np.minimum(dm, w - wu - wl)
        filled = s + r + quick
        spill = np.maximum(0, filled - x["SM"])
        s = np.minimum(filled, x["SM"])
        surface = spill * (1 - np.maximum(0, 1 - s / x["SM"]) ** np.maximum(1, x["EX"]))
        s = s + spill - surface
        out = kss * s
        s = s - out
        q[i] = 0
        for k, (rate, inflow) in enumerate((("CS", surface), ("CI", (1 - x["KGF"]) * out), ("CG", x["KGF"] * out))):
            keep = np.clip(x[rate], 0, 0.999)
            q[i] += (1 - keep) * stores[k]
            stores[k] = keep * stores[k] + inflow
        e_sum = e_sum + e
    return q, np.full(n, p.sum()), e_sum, wu + wl + wd + s + sum(stores) - start, np.zeros(n)


def _convolve(inflow: np.ndarray, curve: Callable[[float], np.ndarray], base: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Inflow [time, sample] released along cumulative curves from the next step on; also what is still under way at the end."""
    out, kept = np.zeros_like(inflow), np.zeros(inflow.shape[1])
    last = int(np.ceil(base.max() / dt)) if base.size else 0
    done = [curve(k * dt) for k in range(last + 1)]
    for k in range(1, last + 1):
        out[k:] += inflow[:-k] * (done[k] - done[k - 1]) if k < len(inflow) else 0
    for age in range(min(last, len(inflow))):
        kept += inflow[len(inflow) - 1 - age] * (1 - done[age])
    return out, kept


def gr4j(p: np.ndarray, e0: np.ndarray, x: Params, t: np.ndarray | None = None, dt: float = 1.0) -> Result:
    """A production store, two unit hydrographs and a routing store with exchange; both hydrographs feed the routing store."""
    n = len(x["X1"])
    s, r = np.minimum(100.0, x["X1"]), np.full(n, 30.0)
    start, e_sum, made = s + r, np.zeros(n), np.empty((len(p), n))
    for i, rain in enumerate(p):
        net, dry = max(0.0, rain - e0[i]), max(0.0, e0[i] - rain)
        full, wet = s / x["X1"], np.tanh(net / x["X1"])
        ps = x["X1"] * (1 - full**2) * wet / (1 + full * wet) if net > 0 else np.zeros(n)
        s = s + ps
        perc = s * (1 - (1 + (4 * s / (9 * x["X1"])) ** 4) ** -0.25)
        s = s - perc
        e = np.full(n, e0[i])
        if dry > 0:
            full, thirst = s / x["X1"], np.tanh(dry / x["X1"])
            es = s * (2 - full) * thirst / (1 + (1 - full) * thirst)
            s, e = s - es, es + rain
        made[i], e_sum = perc + net - ps, e_sum + e
    x4 = x["X4"]
    one = lambda d: 1 - np.maximum(0, 1 - d / x4) ** 2.5
    two = lambda d: np.where(d <= x4, 0.5 * (d / x4) ** 2.5, 1 - 0.5 * np.maximum(0, 2 - d / x4) ** 2.5)
    first, way1 = _convolve(0.9 * made, one, x4, dt)
    second, way2 = _convolve(0.1 * made, two, 2 * x4, dt)
    q, gained = np.empty_like(made), np.zeros(n)
    for i in range(len(p)):
        f = np.clip(x["X2"] * np.minimum(r / x["X3"], 10) ** 3.5, -100, 100)
        filled = r + first[i] + second[i] + f
        f = f + np.maximum(0, -filled)
        r = np.maximum(0, filled)
        q[i] = r * (1 - (1 + (r / x["X3"]) ** 4) ** -0.25)
        r, gained = r - q[i], gained + f
    return q, np.full(n, p.sum()), e_sum, s + r + way1 + way2 - start, gained


def hbv(p: np.ndarray, e0: np.ndarray, x: Params, t: np.ndarray | None = None, dt: float = 1.0) -> Result:
    """Degree-day snow (only with temperatures), a soil store, two boxes and a triangular hydrograph."""
    n = len(x["FC"])
    soil, upper, lower, snow, melt = np.minimum(100.0, x["FC"]), np.full(n, 10.0), np.full(n, 50.0), np.zeros(n), np.zeros(n)
    start, e_sum, p_sum, made = soil + upper + lower, np.zeros(n), np.zeros(n), np.empty((len(p), n))
    cold = t is not None and len(t) == len(p) and np.isfinite(t).any()
    for i, rain in enumerate(p):
        water = np.full(n, rain)
        if cold:
            degrees = t[i] if np.isfinite(t[i]) else 10.0
            freezing = degrees < x["TT"]
            fallen = np.where(freezing, x["SFCF"] * rain, 0.0)
            frozen = np.where(freezing, np.minimum(melt, x["CFR"] * x["CFMAX"] * (x["TT"] - degrees)), 0.0)
            melted = np.where(freezing, 0.0, np.minimum(snow, x["CFMAX"] * (degrees - x["TT"])))
            snow, melt = snow + fallen + frozen - melted, melt - frozen + melted
            wet = np.where(freezing, 0.0, rain)
            p_sum = p_sum + fallen + wet
            pack = (snow > 0) | (melt > 0)
            held = melt + wet
            gone = np.maximum(0, held - x["CWH"] * snow)
            water, melt = np.where(pack, gone, wet), np.where(pack, held - gone, melt)
        else:
            p_sum = p_sum + rain
        e = np.minimum(x["CET"] * e0[i] * np.minimum(1, soil / (x["FC"] * x["LP"])), soil + water)
        recharge = water * np.minimum(1, soil / x["FC"]) ** x["BETA"]
        wanted = soil + water - recharge - e
        soil = np.clip(wanted, 0, x["FC"])
        upper = upper + recharge + wanted - soil
        q0 = x["K0"] * np.maximum(0, upper - x["UZL"])
        perc = np.minimum(x["PERC"], upper - q0)
        upper, lower = upper - q0 - perc, lower + perc
        q1, q2 = x["K1"] * upper, x["K2"] * lower
        upper, lower, made[i], e_sum = upper - q1, lower - q2, q0 + q1 + q2, e_sum + e
    base = np.maximum(x["MAXBAS"], dt)

    def curve(d: float) -> np.ndarray:
        r = np.clip(d / base, 0, 1)
        return np.where(r <= 0.5, 2 * r * r, 1 - 2 * (1 - r) ** 2)

    q, way = _convolve(made, curve, base, dt)
    return q, p_sum, e_sum, soil + upper + lower + snow + melt + way - start, np.zeros(n)


MODELS: dict[str, Callable[..., Result]] = {"xaj": xaj, "gr4j": gr4j, "tank": tank, "hbv": hbv}


def complete(model: str, given: pd.DataFrame) -> Params:
    """Arrays of all parameters of a model: given values clamped to their bounds, defaults for missing and non-finite ones; others are ignored."""
    out = {}
    for name, (default, low, high) in BOUNDS[model].items():
        values = given[name].to_numpy(float) if name in given else np.full(len(given), float(default))
        out[name] = np.clip(np.where(np.isfinite(values), values, default), low, high)
    return out


def forcing(series: DataFrame, key: str = "unit", ts: str = "ts") -> DataFrame:
    """One row for each unit: ts, p, e (and t, if there) as arrays in order of time. A unit's axis is one row, so its length is bounded by an array."""
    names = [c for c in ("p", "e", "t", "obs") if c in series.columns]
    listed = series.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("ts"), *[F.col(c).cast("double").alias(c) for c in names]))).alias("s"))
    return listed.select(key, *[F.col(f"s.{c}").alias(c) for c in ("ts", *names)])


def simulate(model: str, forced: DataFrame, params: DataFrame, key: str = "unit", dt: float = 1.0) -> DataFrame:
    """(key, sample, q array, p_sum, e_sum, storage_change, exchange) for every row of ``params`` (key, sample, parameters) with its unit's forcing.

    An unknown model name means xaj. Negative rain and evaporation count as 0. Rows of a batch that share a unit step together.
    """
    run = MODELS.get(model, xaj)
    model = model if model in MODELS else "xaj"
    named = [c for c in params.columns if c in BOUNDS[model]]
    joined = params.select(key, "sample", *named).join(forced.select(key, *[c for c in ("p", "e", "t") if c in forced.columns]), key)
    kinds = dict(joined.dtypes)

    def stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(key, sort=False):
                p, e = (np.maximum(0, np.nan_to_num(np.asarray(rows[c].iloc[0], float))) for c in ("p", "e"))
                t = np.asarray(rows.t.iloc[0], float) if "t" in rows else None
                q, p_sum, e_sum, change, exchange = run(p, e, complete(model, rows), t, dt)
                yield pd.DataFrame({key: rows[key], "sample": rows["sample"], "q": list(q.T), "p_sum": p_sum, "e_sum": e_sum, "storage_change": change, "exchange": exchange})

    schema = f"`{key}` {kinds[key]}, sample {kinds['sample']}, q array<double>, p_sum double, e_sum double, storage_change double, exchange double"
    return joined.mapInPandas(stepped, schema)


def to_m3s(mm: Column, area_km2: Column, step_s: float) -> Column:
    return mm * area_km2 * 1000.0 / step_s
