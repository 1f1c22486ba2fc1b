"""Time-series operators over (station, ts, value) rows; column names are parameters.

Readings are first reduced per (station, bucket), which is combined before the shuffle; windows run over these buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of missing steps above which a series is flagged, and is unusable.
MISSING_WARN, MISSING_BAD = 0.05, 0.20


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def resample(series: DataFrame, step: int, how: str = "mean", key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, ts, value, n): sums or means of buckets of ``step`` seconds that begin at multiples of it; empty buckets have no row."""
    bucket = F.window(ts, f"{step} seconds")["start"]
    reduced = {"sum": F.sum, "mean": F.avg}[how](value)
    return series.where(F.col(value).isNotNull()).groupBy(F.col(key), bucket.alias("ts")).agg(reduced.alias("value"), F.count("*").alias("n"))


def detect_interval(series: DataFrame, key: str = "station", ts: str = "ts", default: int = 86400) -> DataFrame:
    """(key, interval_s): the most frequent positive step between neighbours, the first seen of several; ``default`` without any."""
    order = Window.partitionBy(key).orderBy(ts)
    steps = series.select(key, ts, seconds_between(F.lag(ts).over(order), F.col(ts)).alias("step"))
    counted = steps.where("step > 0").groupBy(key, "step").agg(F.count("*").alias("n"), F.min(ts).alias("first"))
    best = counted.groupBy(key).agg(F.min_by("step", F.struct(-F.col("n"), F.col("first"))).alias("step"))
    return series.select(key).distinct().join(best, key, "left").select(key, F.coalesce("step", F.lit(default)).cast("long").alias("interval_s"))


def gaps(series: DataFrame, step: int, key: str = "station", ts: str = "ts", most: int | None = 20) -> DataFrame:
    """(key, gap_no, gap_start, gap_end, steps): where neighbours are more than a step apart; the first ``most`` of a series (the report's length, None for all; ``gap_totals`` counts all)."""
    order = Window.partitionBy(key).orderBy(ts)
    beside = series.select(key, F.col(ts).alias("gap_start"), F.lead(ts).over(order).alias("gap_end"))
    found = beside.withColumn("steps", (F.round(seconds_between(F.col("gap_start"), F.col("gap_end")) / step) - 1).cast("long")).where("steps > 0")
    found = found.withColumn("gap_no", F.row_number().over(Window.partitionBy(key).orderBy("gap_start")))
    return found if most is None else found.where(F.col("gap_no") <= most)


def gap_totals(series: DataFrame, step: int, key: str = "station", ts: str = "ts") -> DataFrame:
    """(key, n_gaps, missing_steps) over all gaps of a series; series without gaps have no row."""
    return gaps(series, step, key, ts, None).groupBy(key).agg(F.count("*").alias("n_gaps"), F.sum("steps").alias("missing_steps"))


def quality(series: DataFrame, step: int, key: str = "station", ts: str = "ts") -> DataFrame:
    """Per series: n (distinct times), duplicates, start, end, expected, missing, missing_rate, status."""
    each = series.groupBy(key, ts).agg(F.count("*").alias("_c"))
    out = each.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("_c") - 1).alias("duplicates"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))
    out = out.withColumn("expected", (F.round(seconds_between(F.col("start_ts"), F.col("end_ts")) / step) + 1).cast("long"))
    out = out.withColumn("missing", F.greatest(F.col("expected") - F.col("n"), F.lit(0).cast("long")))
    out = out.withColumn("missing_rate", F.col("missing") / F.col("expected"))
    return out.withColumn("status", F.when(F.col("missing_rate") <= MISSING_WARN, "ok").when(F.col("missing_rate") <= MISSING_BAD, "warn").otherwise("bad"))


def summary_by_kind(series: DataFrame, kind: str, key: str = "station", ts: str = "ts") -> DataFrame:
    """Per kind: number of series and points, and the span."""
    each = series.groupBy(kind, key).agg(F.count("*").alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return each.groupBy(kind).agg(F.count("*").alias("n_series"), F.sum("_n").alias("n_points"), F.min("_a").alias("start_ts"), F.max("_b").alias("end_ts"))


def thin(series: DataFrame, limit: int, key: str = "station", ts: str = "ts") -> DataFrame:
    """For charts: every k-th point of a series, k = max(1, n div limit)."""
    whole = Window.partitionBy(key)
    ranked = series.withColumn("_n", F.count("*").over(whole)).withColumn("_i", F.row_number().over(whole.orderBy(ts)) - 1)
    k = F.greatest(F.call_function("div", F.col("_n"), F.lit(limit)), F.lit(1).cast("long"))
    return ranked.where(F.col("_i") % k == 0).drop("_n", "_i")


def spine_fill(series: DataFrame, keys: DataFrame, start: str, end: str, step: int, fill: Column | None = None, key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, ts, value) at every step of the axis for every key; gaps get ``fill`` or the series' mean."""
    axis = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.make_dt_interval(secs=F.lit(step)))
    spine = keys.select(key).distinct().select(key, F.explode(axis).alias(ts))
    joined = spine.join(series.select(key, ts, value), [key, ts], "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(key)) if fill is None else fill))


def areal_mean(series: DataFrame, weights: DataFrame, key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """(unit, ts, value): mean of a unit's stations that have a value then, their weights renormalised. ``weights`` has unit, key, weight."""
    joined = series.where(F.col(value).isNotNull()).join(weights, key)
    return joined.groupBy("unit", ts).agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("value"))


def _held(names: DataFrame, others: DataFrame) -> DataFrame:
    """(name, other) of the names (name) that another (other) holds as a part of it: parts of the lengths that names have, joined on the name itself, so only true pairs meet."""
    lengths = sorted(r.n for r in names.select(F.length("name").alias("n")).distinct().collect())  # no more than the longest name is long
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: (n > 0) & (n < F.length("other")))
    parts = others.select("other", F.explode(sizes).alias("n")).select("other", F.explode(F.sequence(F.lit(1), F.length("other") - F.col("n") + 1)).alias("i"), "n")
    return parts.select("other", F.substring(F.col("other"), F.col("i"), F.col("n")).alias("name")).distinct().join(names, "name")


def match_names(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str) -> DataFrame:
    """(left_id, right_id, tier) of the best match: 1 the same id, 2 the same name, 3 one name holds the other; ties to the smaller right_id.

    Names are compared as distinct ones, each with its smallest right_id, so a name that many rows share meets once. All
    joins are on whole ids or names: for tier 3 the parts of a name that are as long as some other name. Null and empty
    names hold nothing and match none.
    """
    a = left.select(F.col(left_id).alias("left_id"), F.col(left_name).alias("name"))
    b = right.select(F.col(right_id).alias("right_id"), F.col(right_name).alias("name"))
    own = a.select("left_id", F.col("left_id").cast("string").alias("key")).join(b.groupBy(F.col("right_id").cast("string").alias("key")).agg(F.min("right_id").alias("right_id")), "key").select("left_id", "right_id", F.lit(1).alias("tier"))
    ours, theirs = a.where("name != ''").select("name").distinct(), b.where("name != ''").groupBy("name").agg(F.min("right_id").alias("right_id"))
    other = theirs.withColumnRenamed("name", "other")
    inside = _held(ours, other.select("other")).join(other, "other").select("name", "right_id")
    around = _held(theirs.select("name"), ours.withColumnRenamed("name", "other")).join(theirs, "name").select(F.col("other").alias("name"), "right_id")
    told = theirs.select("name", "right_id", F.lit(2).alias("tier")).unionByName(inside.unionByName(around).withColumn("tier", F.lit(3)))
    best = told.groupBy("name").agg(F.min(F.struct("tier", "right_id")).alias("m"))
    named = a.join(best, "name").select("left_id", "m.right_id", "m.tier")
    return own.unionByName(named).groupBy("left_id").agg(F.min(F.struct("tier", "right_id")).alias("m")).select("left_id", "m.right_id", "m.tier")


def coverage(stations: DataFrame, present: DataFrame, unit: str, key: str, weight: str) -> DataFrame:
    """Per unit: stations, those with a series, the share of weight that they cover, and ok / partial / none."""
    have = present.select(key).distinct().withColumn("_has", F.lit(True))
    joined = stations.join(have, key, "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    out = joined.groupBy(unit).agg(F.count("*").alias("n_stations"), F.count_if("_has").alias("n_present"), (F.sum(F.when(F.col("_has"), F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("coverage"))
    return out.withColumn("status", F.when(F.col("n_present") == 0, "none").when(F.col("n_present") == F.col("n_stations"), "ok").otherwise("partial"))


def climatology(series: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """(month, day, value): mean of each calendar day over the years."""
    return series.groupBy(F.month(ts).alias("month"), F.dayofmonth(ts).alias("day")).agg(F.avg(value).alias("value"))


def lags(series: DataFrame, column: str, most: int, key: str = "station", ts: str = "ts") -> DataFrame:
    """Adds column_lag1 ... column_lag<most>."""
    order = Window.partitionBy(key).orderBy(ts)
    return series.select("*", *[F.lag(column, k).over(order).alias(f"{column}_lag{k}") for k in range(1, most + 1)])


def normal_equations(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row with n and the sums of products that ridge regression needs: xx_i_j (i <= j) and xy_i; combined before the shuffle."""
    full = rows.dropna(subset=[*features, target])
    products = [F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    return full.agg(F.count("*").alias("n"), *products, *[F.sum(F.col(a) * F.col(target)).alias(f"xy_{i}") for i, a in enumerate(features)])


def design_rain(total: Column, steps: Column, peak: float = 0.4, floor: float = 0.05) -> Column:
    """array<double> of a triangular storm: weights fall from 1 at the peak to ``floor`` at the ends, scaled to ``total``."""
    n = F.greatest(steps, F.lit(1))
    at = peak * (n - 1)

    def weight(i: Column) -> Column:
        up = F.when(at > 0, i / at).otherwise(1.0)
        down = F.when(n - 1 > at, (n - 1 - i) / (n - 1 - at)).otherwise(1.0)
        return F.greatest(F.lit(floor), F.when(i <= at, up).otherwise(down))

    w = F.transform(F.sequence(F.lit(0), n - 1), weight)
    return F.transform(w, lambda x: x * total / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))


def extend(history: DataFrame, tail: DataFrame) -> DataFrame:
    """A history and its scenario in one series; ``is_forecast`` tells them apart."""
    return history.withColumn("is_forecast", F.lit(False)).unionByName(tail.withColumn("is_forecast", F.lit(True)))


def season_terms(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year, the year being 365.25 days."""
    angle = F.dayofyear(ts) * (2 * math.pi / 365.25)
    return F.sin(angle), F.cos(angle)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order): each key once, with the place where it first stands."""
    return rows.groupBy(key).agg(F.min(order).alias(order))
