"""Queries of channels as lines and of rasters as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import channels, grid
from rivulet.plans.common import query, r
from rivulet.plans.geometry_plans import apart
from rivulet.plans.network_plans import CELLS, D8_SQL, UPS, XY, cells
from rivulet.sources import sinks
from rivulet.sources.tables import table

_REACHES = f"""WITH RECURSIVE {D8_SQL}, {UPS}, ac AS (SELECT ri AS i, rj AS j, count(*) AS acc FROM up GROUP BY ri, rj), ch AS (SELECT flow.*, acc FROM flow JOIN ac USING (i, j) WHERE acc >= 3),
nx AS (SELECT c.i, c.j, c.z, c.acc, d.i AS di, d.j AS dj FROM ch c LEFT JOIN ch d ON d.i = c.down_i AND d.j = c.down_j), dg AS (SELECT di AS i, dj AS j, count(*) AS n FROM nx WHERE di IS NOT NULL GROUP BY di, dj),
st AS (SELECT nx.*, coalesce(n, 0) != 1 OR di IS NULL OR i IN (0, (SELECT max(i) FROM cells)) OR j IN (0, (SELECT max(j) FROM cells)) AS first FROM nx LEFT JOIN dg USING (i, j)),
wk AS (SELECT i AS si, j AS sj, 0 AS k, i, j, z, acc, di, dj, false AS done FROM st WHERE first UNION ALL SELECT wk.si, wk.sj, wk.k + 1, st.i, st.j, st.z, st.acc, st.di, st.dj, st.first FROM wk JOIN st ON st.i = wk.di AND st.j = wk.dj WHERE NOT wk.done)"""


@query(f"""{_REACHES}, ends AS (SELECT si, sj, arg_max(i, k) AS ei, arg_max(j, k) AS ej FROM wk GROUP BY si, sj HAVING count(*) > 1)
SELECT si AS i, sj AS j, count(*) AS n_cells, round(sum(CASE WHEN done OR di IS NULL THEN 0 ELSE sqrt((di - wk.i) ** 2 + (dj - wk.j) ** 2) END), 4) AS length, round(avg(z), 4) AS z_mean, max(acc) AS acc,
(max(ei), max(ej)) IN (SELECT (si, sj) FROM ends) AS goes_on FROM wk JOIN ends USING (si, sj) GROUP BY si, sj""")
def channel_reaches(spark, sf_dir):
    flows = grid.d8(cells(spark, sf_dir))
    found = channels.reaches(channels.reach_cells(flows, grid.accumulate(flows), threshold=3))
    at = [F.shiftright("reach", 32).cast("int").alias("i"), F.col("reach").bitwiseAND((1 << 32) - 1).cast("int").alias("j")]
    return found.select(*at, "n_cells", r("length").alias("length"), r("z_mean").alias("z_mean"), "acc", F.col("below").isNotNull().alias("goes_on"))


@query(f"""{_REACHES}, v AS (SELECT si, sj, wk.k, (wk.j + 0.5::DOUBLE) * 10 + 100 AS x, (60 - wk.i - 0.5::DOUBLE) * 10 + 200 AS y, count(*) OVER (PARTITION BY si, sj) AS n FROM wk), rl AS (SELECT * FROM v WHERE n > 1),
iv AS (SELECT si, sj, 0 AS low, n - 1 AS high FROM rl WHERE k = 0 UNION ALL SELECT si, sj, unnest([low, mid]), unnest([mid, high]) FROM (SELECT iv.si, iv.sj, low, high, arg_max(q.k, ({apart('q.x', 'q.y', 'a.', 'b.')}, -q.k)) AS mid, max({apart('q.x', 'q.y', 'a.', 'b.')}) AS far FROM iv
JOIN rl a ON a.si = iv.si AND a.sj = iv.sj AND a.k = low JOIN rl b ON b.si = iv.si AND b.sj = iv.sj AND b.k = high JOIN rl q ON q.si = iv.si AND q.sj = iv.sj AND q.k > low AND q.k < high WHERE q.n > 4 GROUP BY iv.si, iv.sj, low, high) WHERE far > 6),
kept AS (SELECT si, sj, low AS k FROM iv UNION SELECT si, sj, high FROM iv UNION SELECT si, sj, k FROM rl WHERE n <= 4)
SELECT si AS i, sj AS j, (row_number() OVER (PARTITION BY si, sj ORDER BY k) - 1)::INT AS k, round(x, 4) AS x, round(y, 4) AS y FROM rl JOIN kept USING (si, sj, k)""")
def reach_lines(spark, sf_dir):
    """The reaches as simplified lines of a raster with cells of 10."""
    flows = grid.d8(cells(spark, sf_dir))
    found = channels.reach_lines(channels.reach_cells(flows, grid.accumulate(flows), threshold=3), 100.0, 200.0, 10.0, 60, tolerance=6.0)
    at = [F.shiftright("reach", 32).cast("int").alias("i"), F.col("reach").bitwiseAND((1 << 32) - 1).cast("int").alias("j")]
    return found.select(*at, F.col("k").cast("int").alias("k"), r("x").alias("x"), r("y").alias("y"))


@query(f"""WITH {XY}, l AS (SELECT label AS edge, row_number() OVER o - 1 AS k, x, y, lead(x) OVER o AS ex, lead(y) OVER o AS ey, count(*) OVER (PARTITION BY label) AS n FROM xy WINDOW o AS (PARTITION BY label ORDER BY vec_id)),
p AS (SELECT edge, k, 0 AS part, x, y FROM l WHERE k IN (0, n - 1) OR n < 3 UNION ALL SELECT edge, k, 1, x * 0.75::DOUBLE + ex * 0.25::DOUBLE, y * 0.75::DOUBLE + ey * 0.25::DOUBLE FROM l WHERE ex IS NOT NULL AND n > 2
UNION ALL SELECT edge, k, 2, x * 0.25::DOUBLE + ex * 0.75::DOUBLE, y * 0.25::DOUBLE + ey * 0.75::DOUBLE FROM l WHERE ex IS NOT NULL AND n > 2)
SELECT edge, (row_number() OVER (PARTITION BY edge ORDER BY k, part) - 1)::INT AS k, round(x, 6) AS x, round(y, 6) AS y FROM p""")
def smooth_lines(spark, sf_dir):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    lines = table(spark, sf_dir, "embeddings").select(F.col("label").alias("edge"), F.col("vec_id").alias("k"), at(0).alias("x"), at(1).alias("y"))
    return channels.smooth(lines, 1).withColumns({"x": r("x", 6), "y": r("y", 6)})


@query(f"""WITH {CELLS}, a AS (SELECT unnest(range((SELECT max(i) + 2 FROM cells)))::INT AS i), b AS (SELECT unnest(range(50))::INT AS j)
SELECT a.i, string_agg(CASE WHEN z IS NULL OR (i + j) % 11 = 0 THEN '-9999' ELSE round(z * 100)::BIGINT::VARCHAR END, ' ' ORDER BY j) AS line FROM a CROSS JOIN b LEFT JOIN cells USING (i, j) GROUP BY a.i""")
def grid_lines(spark, sf_dir):
    """Heights in hundredths as lines of a grid file that has one row more than the cells."""
    surface = cells(spark, sf_dir)
    rows = surface.agg(F.max("i")).head()[0] + 2
    return sinks.grid_lines(surface.where((F.col("i") + F.col("j")) % 11 != 0).withColumn("z", F.round(F.col("z") * 100).cast("long")), rows, 50)
