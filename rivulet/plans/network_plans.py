"""Network and raster queries: customers form a binary tree, parts a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import attach, grid, network
from rivulet.plans.common import query, r
from rivulet.sources.tables import table

#: Customers as a river network: the parent of k is (k - 1) div 2; subtrees under keys that leave 3 when divided by 7 are cut off by a condition on the way down.
TREE = """tree AS (SELECT 0::BIGINT AS id, NULL::BIGINT AS parent, 0::BIGINT AS level UNION ALL
  SELECT c.c_custkey, t.id, t.level + 1 FROM tree t JOIN customer c ON (c.c_custkey - 1) // 2 = t.id AND c.c_custkey > 0 WHERE c.c_custkey % 7 != 3),
n AS (SELECT t.*, abs(c.c_acctbal) AS len FROM tree t JOIN customer c ON c.c_custkey = t.id),
up AS (SELECT id AS root, id FROM tree UNION ALL SELECT up.root, t.id FROM up JOIN tree t ON t.parent = up.id),
s AS (SELECT root AS id, sum(len) AS total, count(*) AS nodes FROM up JOIN n ON n.id = up.id GROUP BY root)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.abs("c_acctbal").alias("len"), (F.col("c_custkey") % 7 == 3).alias("off"))
    parent = F.when(F.col("id") > 0, F.call_function("div", F.col("id") - 1, F.lit(2)))
    whole = rows.withColumn("parent", parent)
    cut_off = network.first_marked(whole, "off").where("mark is null").select("id")
    return whole.join(cut_off, "id").select("id", "parent", "len")


@query(f"WITH RECURSIVE {TREE} SELECT id, level FROM tree")
def tree_levels(spark, sf_dir):
    return network.levels(tree(spark, sf_dir))


@query(f"WITH RECURSIVE {TREE} SELECT id, round(total, 2) AS len, nodes FROM s")
def tree_upstream_sum(spark, sf_dir):
    sums = network.upstream_sums(tree(spark, sf_dir).withColumn("nodes", F.lit(1).cast("long")), ["len", "nodes"])
    return sums.withColumn("len", r("len", 2))


@query(f"""WITH RECURSIVE {TREE},
best AS (SELECT n.id, row_number() OVER (PARTITION BY n.parent ORDER BY s.total DESC, n.id) AS k FROM n JOIN s USING (id)),
stem AS (SELECT id FROM tree WHERE parent IS NULL UNION ALL SELECT t.id FROM stem JOIN tree t ON t.parent = stem.id JOIN best b ON b.id = t.id AND b.k = 1)
SELECT id, round(total, 2) AS upstream_length, id IN (SELECT id FROM stem) AS is_main FROM s""")
def tree_mainstem(spark, sf_dir):
    return network.main_stem(tree(spark, sf_dir), "len").withColumn("upstream_length", r("upstream_length", 2))


def _order_sql(levels: int = 24) -> str:
    """Orders level by level, from the deepest one to the outlet: enough for 2**24 customers."""
    parts = [f"WITH RECURSIVE {TREE}", f"o{levels} AS (SELECT id, parent, 1 AS o FROM tree WHERE level = {levels})"]
    for k in range(levels - 1, -1, -1):
        parts.append(
            f"o{k} AS (SELECT t.id, t.parent, coalesce(m.o, 1) AS o FROM tree t LEFT JOIN (SELECT parent, max(o) + CASE WHEN count(*) FILTER (o = top) >= 2 THEN 1 ELSE 0 END AS o FROM (SELECT *, max(o) OVER (PARTITION BY parent) AS top FROM o{k + 1}) GROUP BY parent) m ON m.parent = t.id WHERE t.level = {k})"
        )
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT id, o::INT AS stream_order FROM o{k}" for k in range(levels + 1))


@query(_order_sql())
def tree_order(spark, sf_dir):
    return network.orders(tree(spark, sf_dir))


@query("SELECT c_custkey AS id, (c_custkey % 7)::BIGINT AS component FROM customer WHERE c_custkey + 7 <= (SELECT max(c_custkey) FROM customer) OR c_custkey >= 7")
def graph_components(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    edges = customer.select(F.col("c_custkey").alias("a")).join(customer.select((F.col("c_custkey") - 7).alias("a"), F.col("c_custkey").alias("b")), "a")
    return network.components(edges)


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey + 100 AS b FROM customer c JOIN supplier s ON c.c_custkey % 10 = s.s_suppkey % 10),
x AS (SELECT a AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT b, 1, 0 FROM e)
SELECT id, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, CASE WHEN sum(i) = 0 THEN 'source' WHEN sum(o) = 0 THEN 'outlet' WHEN sum(i) >= 2 THEN 'junction' ELSE 'node' END AS kind FROM x GROUP BY id""")
def node_kinds(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    start = c.select(F.col("c_nationkey").alias("from_node"), (F.col("c_custkey") % 10).alias("k")).distinct()
    end = s.select((F.col("s_nationkey") + 100).alias("to_node"), (F.col("s_suppkey") % 10).alias("k")).distinct()
    edges = start.join(end, "k").select("from_node", "to_node").distinct()
    return network.node_kinds(edges)


#: Parts as a grid of 50 columns, with pits.
CELLS = "cells AS (SELECT (p_partkey // 50)::INT AS i, (p_partkey % 50)::INT AS j, (0.1::DOUBLE * ((p_partkey * 37) % 1009) + 0.01::DOUBLE * (p_partkey // 50))::DOUBLE AS z FROM part)"
D8_SQL = f"""{CELLS}, w(k, di, dj, dist, code) AS (VALUES {', '.join(str((k, a, b, d, c)) for k, (a, b, d, c) in enumerate(grid.D8))}),
best AS (SELECT c.i, c.j, arg_max({{'code': w.code, 'i': n.i, 'j': n.j}}, ((c.z - n.z) / w.dist, -w.k)) AS b FROM cells c, w JOIN cells n ON n.i = c.i + w.di AND n.j = c.j + w.dj WHERE (c.z - n.z) / w.dist > 0 GROUP BY c.i, c.j),
flow AS (SELECT c.i, c.j, c.z, coalesce(b.code, 0)::INT AS code, b.i AS down_i, b.j AS down_j FROM cells c LEFT JOIN best USING (i, j))"""
UPS = "up AS (SELECT i AS ri, j AS rj, i, j FROM flow UNION ALL SELECT up.ri, up.rj, f.i, f.j FROM up JOIN flow f ON f.down_i = up.i AND f.down_j = up.j)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    row = F.call_function("div", k, F.lit(50))
    return table(spark, sf_dir, "part").select(row.cast("int").alias("i"), (k % 50).cast("int").alias("j"), (((k * 37) % 1009) * 0.1 + row * 0.01).alias("z"))


@query(f"WITH {D8_SQL} SELECT i, j, round(z, 4) AS z, code, down_i, down_j FROM flow")
def grid_d8(spark, sf_dir):
    return grid.d8(cells(spark, sf_dir)).withColumn("z", r("z"))


@query(f"WITH RECURSIVE {D8_SQL}, {UPS} SELECT ri AS i, rj AS j, count(*) AS acc FROM up GROUP BY ri, rj")
def grid_accumulate(spark, sf_dir):
    return grid.accumulate(grid.d8(cells(spark, sf_dir)))


@query(f"""WITH RECURSIVE {D8_SQL},
lab AS (SELECT i, j, i * 1000 + j AS label FROM flow WHERE (i + j) % 5 = 0 UNION ALL SELECT f.i, f.j, lab.label FROM lab JOIN flow f ON f.down_i = lab.i AND f.down_j = lab.j WHERE (f.i + f.j) % 5 != 0)
SELECT f.i, f.j, label FROM flow f LEFT JOIN lab USING (i, j)""")
def grid_labels(spark, sf_dir):
    flows = grid.d8(cells(spark, sf_dir))
    seeds = flows.where((F.col("i") + F.col("j")) % 5 == 0).select("i", "j", (F.col("i") * 1000 + F.col("j")).alias("label"))
    return grid.watersheds(flows, seeds)


@query("SELECT p_size AS label, count(*) AS cells, count(*) * 0.25 AS area, min(p_retailprice) AS z_min, max(p_retailprice) AS z_max, round(avg(p_retailprice), 4) AS z_mean, round(max(p_retailprice) - min(p_retailprice), 4) AS relief FROM part GROUP BY p_size")
def grid_zonal(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("label"), F.col("p_retailprice").alias("z"))
    return grid.zonal(rows, cell_area=0.25).withColumns({"z_mean": r("z_mean"), "relief": r("relief")})


def _relaxed(start: str, step: str, rounds: int = 150) -> str:
    """SQL of a value of every cell after so many rounds in which each takes the least of its own and what its neighbours let it take."""
    near = f"(VALUES {', '.join(str((a, b)) for a, b, _, _ in grid.D8)}) AS w(di, dj)"
    return f"""rec AS (SELECT 0 AS round, i, j, z, {start} AS f FROM cells UNION ALL
SELECT r.round + 1, r.i, r.j, r.z, least(min(r.f), coalesce(min({step}), 'inf'::DOUBLE)) FROM rec r, {near} LEFT JOIN rec n ON n.i = r.i + di AND n.j = r.j + dj WHERE r.round < {rounds} GROUP BY r.round, r.i, r.j, r.z),
last AS (SELECT i, j, z, f FROM rec WHERE round = {rounds})"""


_BORDER = "i IN (0, (SELECT max(i) FROM cells)) OR j IN (0, 49)"
_FILLED = D8_SQL.replace(CELLS, f"{CELLS.replace('cells AS', 'cells AS MATERIALIZED')}, {_relaxed(f"CASE WHEN {_BORDER} THEN z ELSE 'inf'::DOUBLE END", 'greatest(r.z, n.f + 0.01)')}, raised AS (SELECT i, j, f AS z FROM last)").replace("FROM cells c, w JOIN cells n", "FROM raised c, w JOIN raised n").replace("FROM cells c LEFT JOIN best", "FROM raised c LEFT JOIN best")


@query(f"WITH RECURSIVE {_FILLED} SELECT i, j, round(z, 4) AS z, code FROM flow")
def grid_fill(spark, sf_dir):
    filled = grid.fill(cells(spark, sf_dir), 0.01, tile=8)
    return grid.d8(filled).select("i", "j", r("z").alias("z"), "code")


_STEPPED = D8_SQL.replace("(0.1::DOUBLE * ((p_partkey * 37) % 1009) + 0.01::DOUBLE * (p_partkey // 50))::DOUBLE AS z", "(((p_partkey * 37) % 1009) // 300)::DOUBLE AS z")


@query(f"""WITH RECURSIVE {_STEPPED}, {_relaxed("(SELECT CASE WHEN down_i IS NULL THEN 'inf'::DOUBLE ELSE 0 END FROM flow x WHERE x.i = cells.i AND x.j = cells.j)", 'CASE WHEN r.z >= n.z - 0.05::DOUBLE THEN n.f + 1 END')},
way AS (SELECT l.i, l.j, arg_min({{'code': w.code, 'i': n.i, 'j': n.j}}, w.k) AS w FROM last l, w JOIN last n ON n.i = l.i + w.di AND n.j = l.j + w.dj WHERE l.f > 0 AND l.f < 'inf' AND n.f = l.f - 1 AND l.z >= n.z - 0.05::DOUBLE GROUP BY l.i, l.j)
SELECT flow.i, flow.j, coalesce(way.w.code, code)::INT AS code, coalesce(way.w.i, down_i) AS down_i, coalesce(way.w.j, down_j) AS down_j FROM flow LEFT JOIN way USING (i, j)""")
def flat_directions(spark, sf_dir):
    """Heights in a few steps, so that most cells lie on flats."""
    stepped = table(spark, sf_dir, "part").select(F.call_function("div", F.col("p_partkey"), F.lit(50)).cast("int").alias("i"), (F.col("p_partkey") % 50).cast("int").alias("j"), F.call_function("div", (F.col("p_partkey") * 37) % 1009, F.lit(300)).cast("double").alias("z"))
    return grid.resolve_flats(grid.d8(stepped), tile=8).select("i", "j", "code", "down_i", "down_j")


@query(f"""WITH {CELLS}, g AS (SELECT i, j, z, CASE WHEN lag(z) OVER r IS NULL AND lead(z) OVER r IS NULL THEN 0 WHEN lag(z) OVER r IS NULL THEN lead(z) OVER r - z WHEN lead(z) OVER r IS NULL THEN z - lag(z) OVER r ELSE (lead(z) OVER r - lag(z) OVER r) / 2 END AS dx,
 CASE WHEN lag(z) OVER c IS NULL AND lead(z) OVER c IS NULL THEN 0 WHEN lag(z) OVER c IS NULL THEN lead(z) OVER c - z WHEN lead(z) OVER c IS NULL THEN z - lag(z) OVER c ELSE (lead(z) OVER c - lag(z) OVER c) / 2 END AS dy FROM cells WINDOW r AS (PARTITION BY i ORDER BY j), c AS (PARTITION BY j ORDER BY i))
SELECT i, j, round(least(greatest(sin(pi() / 2 - atan(sqrt(dx * dx + dy * dy))) * sin(radians(45)) + cos(pi() / 2 - atan(sqrt(dx * dx + dy * dy))) * cos(radians(45)) * cos(radians(135) - atan2(-dx, dy)), 0), 1), 4) AS shade FROM g""")
def grid_hillshade(spark, sf_dir):
    return grid.hillshade(cells(spark, sf_dir)).withColumn("shade", r("shade"))


_HOLES = "c AS (SELECT * FROM cells WHERE (i * 7 + j * 3) % 5 != 0)"
_SLOPE = "CASE WHEN {0}.z IS NULL AND {1}.z IS NULL THEN 0 WHEN {0}.z IS NULL THEN {1}.z - c.z WHEN {1}.z IS NULL THEN c.z - {0}.z ELSE ({1}.z - {0}.z) / 2 END"


@query(f"""WITH {CELLS}, {_HOLES}, g AS (SELECT c.i, c.j, {_SLOPE.format('w', 'e')} AS dx, {_SLOPE.format('n', 's')} AS dy FROM c LEFT JOIN c w ON w.i = c.i AND w.j = c.j - 1 LEFT JOIN c e ON e.i = c.i AND e.j = c.j + 1
LEFT JOIN c n ON n.i = c.i - 1 AND n.j = c.j LEFT JOIN c s ON s.i = c.i + 1 AND s.j = c.j)
SELECT i, j, round(least(greatest(sin(pi() / 2 - atan(sqrt(dx * dx + dy * dy))) * sin(radians(45)) + cos(pi() / 2 - atan(sqrt(dx * dx + dy * dy))) * cos(radians(45)) * cos(radians(135) - atan2(-dx, dy)), 0), 1), 4) AS shade FROM g""")
def hillshade_beside_holes(spark, sf_dir):
    """One cell in five has no data."""
    return grid.hillshade(cells(spark, sf_dir).where((F.col("i") * 7 + F.col("j") * 3) % 5 != 0)).withColumn("shade", r("shade"))


XY = "xy AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), st AS (SELECT label AS target, arg_min(x, vec_id) AS tx, arg_min(y, vec_id) AS ty FROM xy GROUP BY label)"


def _stations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    xy = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    first = xy.groupBy(F.col("label").alias("target")).agg(F.min_by("x", "id").alias("x"), F.min_by("y", "id").alias("y"))
    return xy, first


@query(f"WITH {XY} SELECT vec_id AS id, arg_min(target, (sqrt((x - tx) ** 2 + (y - ty) ** 2), target)) AS target, round(min(sqrt((x - tx) ** 2 + (y - ty) ** 2)), 6) AS distance FROM xy, st GROUP BY vec_id")
def nearest_station(spark, sf_dir):
    return grid.nearest(*_stations(spark, sf_dir)).withColumn("distance", r("distance", 6))


@query(f"WITH {XY}, m AS (SELECT vec_id AS id, arg_min(target, (sqrt((x - tx) ** 2 + (y - ty) ** 2), target)) AS target, min(sqrt((x - tx) ** 2 + (y - ty) ** 2)) AS d FROM xy, st GROUP BY vec_id) SELECT id, target, round(d, 6) AS distance FROM m WHERE d <= 0.05")
def nearest_threshold_snap(spark, sf_dir):
    return grid.nearest(*_stations(spark, sf_dir), most=0.05).withColumn("distance", r("distance", 6))


@query(f"""WITH {XY}, m AS (SELECT vec_id, any_value(label) AS zone, arg_min(target, (sqrt((x - tx) ** 2 + (y - ty) ** 2), target)) AS station FROM xy, st GROUP BY vec_id)
SELECT zone, station, count(*) AS cells, round(count(*) / sum(count(*)) OVER (PARTITION BY zone), 4) AS weight FROM m GROUP BY zone, station""")
def thiessen_weights(spark, sf_dir):
    points, stations = _stations(spark, sf_dir)
    near = grid.nearest(points, stations).join(points.select("id", F.col("label").alias("zone")), "id").withColumnRenamed("target", "station")
    return grid.thiessen_weights(near, "zone", "station").withColumn("weight", r("weight"))


LINES = f"""{XY}, pt AS (SELECT vec_id AS id, embedding[3]::DOUBLE AS px, embedding[4]::DOUBLE AS py FROM embeddings),
ln AS (SELECT label AS edge, x AS ax, y AS ay, lead(x) OVER o AS ex, lead(y) OVER o AS ey, row_number() OVER o AS k FROM xy WINDOW o AS (PARTITION BY label ORDER BY vec_id)),
sg AS (SELECT *, sqrt((ex - ax) ** 2 + (ey - ay) ** 2) AS len FROM ln WHERE ex IS NOT NULL),
s2 AS (SELECT *, sum(len) OVER (PARTITION BY edge ORDER BY k) - len AS ahead, sum(len) OVER (PARTITION BY edge) AS total FROM sg),
m AS (SELECT id, edge, k, ahead, total, len, px, py, ax, ay, ex, ey, CASE WHEN len = 0 THEN 0 ELSE least(1, greatest(0, ((px - ax) * (ex - ax) + (py - ay) * (ey - ay)) / (len * len))) END AS u FROM pt, s2),
d AS (SELECT id, edge, k, (ahead + u * len) / total AS ratio, sqrt((px - ax - u * (ex - ax)) ** 2 + (py - ay - u * (ey - ay)) ** 2) AS distance FROM m)"""


@query(f"WITH {LINES} SELECT id, arg_min(edge, (distance, edge, k)) AS edge, round(min(distance), 6) AS distance, round(arg_min(ratio, (distance, edge, k)), 4) AS ratio FROM d GROUP BY id")
def nearest_edge(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    lines = vectors.select(F.col("label").alias("edge"), F.col("vec_id").alias("k"), at(0).alias("x"), at(1).alias("y"))
    points = vectors.select(F.col("vec_id").alias("id"), at(2).alias("x"), at(3).alias("y"))
    return attach.nearest_edge(points, lines).withColumns({"distance": r("distance", 6), "ratio": r("ratio")})
