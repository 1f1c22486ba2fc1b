"""Queries of the study of what a simulation leaves over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.operators import residual
from rivulet.plans.common import query, r
from rivulet.sources.tables import table

#: Daily quantities by return flag; yesterday's is the simulation, its last change and last week's are the features.
_DAILY = """d AS (SELECT l_returnflag AS unit, l_shipdate AS day, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
f AS (SELECT * FROM (SELECT unit, day, v, lag(v) OVER w AS sim, lag(v) OVER w - lag(v, 2) OVER w AS f1, lag(v, 7) OVER w AS f2 FROM d WINDOW w AS (PARTITION BY unit ORDER BY day)) WHERE f2 IS NOT NULL),
p AS (SELECT *, v - sim AS y, CASE WHEN k < floor(n * 0.45::DOUBLE + 1e-9) THEN 'a' WHEN k < floor(n * 0.7::DOUBLE + 1e-9) THEN 'b' ELSE 'c' END AS phase FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n FROM f)),
m AS (SELECT unit, avg(f1) AS m1, avg(f2) AS m2, stddev_pop(f1) AS d1, stddev_pop(f2) AS d2, avg(y) AS w0 FROM p WHERE phase = 'a' GROUP BY unit),
z AS (SELECT p.unit, phase, v, sim, y, w0, (f1 - m1) / d1 AS z1, (f2 - m2) / d2 AS z2 FROM p JOIN m USING (unit)),
g AS (SELECT unit, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c, sum(z1 * y) AS s1, sum(z2 * y) AS s2 FROM z WHERE phase = 'a' GROUP BY unit),
w AS (SELECT unit, pen, ((c + pen) * s1 - b * s2) / ((a + pen) * (c + pen) - b * b) AS w1, ((a + pen) * s2 - b * s1) / ((a + pen) * (c + pen) - b * b) AS w2 FROM g, (SELECT unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0])::DOUBLE AS pen)),
b AS (SELECT unit, arg_min({'pen': pen, 'w1': w1, 'w2': w2}, (sse, pen)) AS w FROM (SELECT unit, pen, w1, w2, sum((w0 + w1 * z1 + w2 * z2 - y) ** 2) AS sse FROM w JOIN z USING (unit) WHERE phase = 'b' GROUP BY ALL) GROUP BY unit)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("unit"), F.col("l_shipdate").alias("day")).agg(F.sum("l_quantity").cast("double").alias("v"))
    order = Window.partitionBy("unit").orderBy("day")
    last = F.lag("v").over(order)
    return days.select("unit", "day", "v", last.alias("sim"), (last - F.lag("v", 2).over(order)).alias("f1"), F.lag("v", 7).over(order).alias("f2"))


@query(f"""WITH {_DAILY} SELECT unit, w.pen AS penalty, count(*) AS n_test, round(1 - sum((v - sim) ** 2) / (count(*) * var_pop(v)), 6) AS nse_base,
round(1 - sum((v - sim - w0 - w.w1 * z1 - w.w2 * z2) ** 2) / (count(*) * var_pop(v)), 6) AS nse_corrected FROM z JOIN b USING (unit) WHERE phase = 'c' GROUP BY unit, w""")
def residual_study(spark, sf_dir):
    found = residual.study(_rows(spark, sf_dir), "unit", "day", "v", "sim", ["f1", "f2"])
    return found.select("unit", "penalty", "n_test", r("nse_base", 6).alias("nse_base"), r("nse_corrected", 6).alias("nse_corrected"))


@query(f"WITH {_DAILY} SELECT unit, round(w0, 6) AS intercept, round(w.w1, 6) AS change, round(w.w2, 6) AS last_week FROM b JOIN m USING (unit)")
def residual_coefficients(spark, sf_dir):
    told = residual.phases(_rows(spark, sf_dir).dropna(), "unit", "day").withColumn("left", F.col("v") - F.col("sim"))
    models = residual.fit(told, "unit", ["f1", "f2"], "left")
    return models.select("unit", *[r(F.get("coefficients", F.lit(i)), 6).alias(n) for i, n in enumerate(("intercept", "change", "last_week"))])
