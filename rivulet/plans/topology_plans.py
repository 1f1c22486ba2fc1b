"""Queries of topology, delineation and feature attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import props
from rivulet.operators import attach, context, grid, metrics, network, series, simplify, topology, units
from rivulet.plans.common import query, r
from rivulet.plans.network_plans import CELLS, D8_SQL, TREE, UPS, cells, tree
from rivulet.sources.tables import table

# Keywords in layer names, and layer types of geometries.
NAME_HINTS = [
    (("水文", "HYDRO", "STATION"), "hydro_station"),
    (("雨量", "RAIN", "PRECIP"), "rain_station"),
    (("湖泊", "水库", "湖", "LAKE", "RESERVOIR"), "lake"),
    (("河流", "水系", "河道", "RIVER", "STREAM", "CHANNEL"), "river"),
    (("边界", "流域", "BOUNDARY", "BASIN", "WATERSHED"), "boundary"),
]
GEOMETRY_TYPES = {"LineString": "river", "MultiLineString": "river", "Point": "other", "MultiPoint": "other", "Polygon": "lake", "MultiPolygon": "lake"}


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers k to k + 1 as edges, in chains of ten nodes; every seventh chain is closed to a ring."""
    k, block = F.col("c_custkey"), F.call_function("div", F.col("c_custkey"), F.lit(10))
    rows = table(spark, sf_dir, "customer").where((k % 10 != 9) | (block % 7 == 3))
    return rows.select(k.alias("edge"), k.alias("from_node"), F.when(k % 10 == 9, k - 9).otherwise(k + 1).alias("to_node"), F.abs("c_acctbal").alias("length"))


_CHAINS = "e AS (SELECT c_custkey AS edge, c_custkey AS from_node, CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 9 ELSE c_custkey + 1 END AS to_node, abs(c_acctbal) AS length FROM customer WHERE c_custkey % 10 != 9 OR c_custkey // 10 % 7 = 3)"


@query(f"""WITH {_CHAINS}, st AS (SELECT edge, 0 AS side, 0::DOUBLE AS ratio, from_node AS node FROM e UNION ALL SELECT edge, 2, 1, to_node FROM e
UNION ALL SELECT o_custkey, 1, (o_orderkey % 101) / 100::DOUBLE, -o_orderkey FROM orders WHERE o_custkey IN (SELECT edge FROM e) AND o_orderkey % 101 BETWEEN 3 AND 97),
p AS (SELECT edge, row_number() OVER w AS piece, node AS from_node, lead(node) OVER w AS to_node, lead(ratio) OVER w - ratio AS share FROM st WINDOW w AS (PARTITION BY edge ORDER BY side, ratio, node))
SELECT edge, piece::INT AS piece, p.from_node, p.to_node, round(share * length, 4) AS length FROM p JOIN e USING (edge) WHERE share IS NOT NULL""")
def split_at_stations(spark, sf_dir):
    stations = table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("node"), F.col("o_custkey").alias("edge"), ((F.col("o_orderkey") % 101) / 100).alias("ratio"))
    return topology.split_at(_chains(spark, sf_dir), stations).withColumn("length", r("length"))


@query(f"""WITH {_CHAINS} SELECT min(edge) AS edge, min(from_node) AS from_node, max(to_node) AS to_node, round(sum(length), 4) AS length FROM e
WHERE edge // 10 % 7 != 3 GROUP BY edge // 10, edge % 10 < 4""")
def dissolve_pseudo_nodes(spark, sf_dir):
    """A node in ten is protected; rings go."""
    edges = _chains(spark, sf_dir)
    kept = edges.where(F.col("from_node") % 10 == 4).select(F.col("from_node").alias("node"))
    return topology.dissolve(edges, kept).withColumn("length", r("length"))


@query(f"""WITH RECURSIVE {TREE} SELECT id AS edge, id AS from_node, coalesce(parent, -1) AS to_node, round(len, 4) AS length, id % 2 = 0 AS flipped FROM n""")
def orient_to_outlet(spark, sf_dir):
    """Every second edge of the tree points away from the outlet, node -1, which lies lowest of all ends."""
    down = tree(spark, sf_dir).select("id", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), "len")
    odd = F.col("id") % 2 == 1
    edges = down.select(F.col("id").alias("edge"), F.when(odd, F.col("id")).otherwise(F.col("parent")).alias("from_node"), F.when(odd, F.col("parent")).otherwise(F.col("id")).alias("to_node"), F.col("len").alias("length"))
    nodes = edges.select(F.explode(F.array("from_node", "to_node")).alias("node")).distinct()
    roots = topology.outlets(edges, nodes.withColumn("z", F.col("node").cast("double")))
    return topology.orient(edges, roots).withColumn("length", r("length"))


_UNITS = f"""WITH RECURSIVE {D8_SQL}, {UPS}, ac AS (SELECT ri AS i, rj AS j, count(*) AS acc FROM up GROUP BY ri, rj),
pt AS (SELECT i * 50 + j AS id, i + 0.125::DOUBLE AS y, j + 0.25::DOUBLE AS x FROM cells WHERE (i * 50 + j) % 7 = 0),
sn AS (SELECT id, arg_min({{'i': ac.i, 'j': ac.j, 'acc': acc}}, (sqrt((x - ac.j) ** 2 + (y - ac.i) ** 2), ac.i, ac.j)) AS c, min(sqrt((x - ac.j) ** 2 + (y - ac.i) ** 2)) AS d FROM pt, ac WHERE acc >= 3 GROUP BY id HAVING d <= 3),
sd AS (SELECT min(id) AS label, c.i AS i, c.j AS j, any_value(c.acc) AS acc, arg_min(d, id) AS d FROM sn WHERE c.acc >= 4 GROUP BY c.i, c.j),
lab AS (SELECT i, j, label FROM sd UNION ALL SELECT f.i, f.j, lab.label FROM lab JOIN flow f ON f.down_i = lab.i AND f.down_j = lab.j LEFT JOIN sd ON sd.i = f.i AND sd.j = f.j WHERE sd.label IS NULL),
z AS (SELECT label, count(*) * 0.25::DOUBLE AS area, avg(z) AS z_mean, max(z) - min(z) AS relief FROM lab JOIN cells USING (i, j) GROUP BY label),
pa AS (SELECT sd.label, lab.label AS parent FROM sd JOIN flow f USING (i, j) LEFT JOIN lab ON lab.i = f.down_i AND lab.j = f.down_j),
lv AS (SELECT label, 0::BIGINT AS depth FROM pa WHERE parent IS NULL UNION ALL SELECT pa.label, lv.depth + 1 FROM lv JOIN pa ON pa.parent = lv.label),
an AS (SELECT label AS root, label FROM pa UNION ALL SELECT an.root, pa.label FROM an JOIN pa ON pa.parent = an.label),
cu AS (SELECT root AS label, sum(area) AS cumulative FROM an JOIN z USING (label) GROUP BY root)
SELECT label, i, j, acc, round(d, 6) AS "offset", parent, area, round(z_mean, 4) AS z_mean, round(relief, 4) AS relief, depth, row_number() OVER (ORDER BY depth DESC, area DESC, label) AS rank, cumulative,
format('S{{:02d}}', row_number() OVER (ORDER BY depth DESC, area DESC, label)) AS code FROM sd JOIN pa USING (label) JOIN lv USING (label) JOIN z USING (label) JOIN cu USING (label)"""


@query(_UNITS)
def delineate_units(spark, sf_dir):
    surface = cells(spark, sf_dir)
    flows = grid.d8(surface)
    at = surface.select((F.col("i") * 50 + F.col("j")).alias("id"), (F.col("j") + 0.25).alias("x"), (F.col("i") + 0.125).alias("y")).where("id % 7 = 0")
    found, _ = units.delineate(flows, grid.accumulate(flows), at, threshold=3, most=3.0, least_cells=4, cell_area=0.25)
    return found.drop("z_min", "z_max").withColumns({"offset": r("offset", 6), "z_mean": r("z_mean"), "relief": r("relief")})


@query(f"""WITH RECURSIVE {D8_SQL}, {UPS}, ac AS (SELECT ri AS i, rj AS j, count(*) AS acc FROM up GROUP BY ri, rj), pt AS (SELECT i * 50 + j AS id, i + 0.125::DOUBLE AS y, j + 0.25::DOUBLE AS x FROM cells WHERE (i * 50 + j) % 3 = 0),
sn AS (SELECT id, arg_min({{'i': ac.i, 'j': ac.j, 'acc': acc}}, (sqrt((x - ac.j) ** 2 + (y - ac.i) ** 2), ac.i, ac.j)) AS c, min(sqrt((x - ac.j) ** 2 + (y - ac.i) ** 2)) AS d FROM pt, ac WHERE acc >= 4 GROUP BY id),
k AS (SELECT id, c, d, min(id) OVER (PARTITION BY c.i, c.j) AS first FROM sn WHERE d <= 2)
SELECT id, CASE WHEN c IS NULL THEN 'out of reach' WHEN id != first THEN 'same cell' WHEN c.acc < 6 THEN 'too small' WHEN d > 0.7 THEN 'far' ELSE 'placed' END AS status, c.i AS i, c.j AS j, c.acc AS acc, round(d, 6) AS "offset" FROM pt LEFT JOIN k USING (id)""")
def control_points(spark, sf_dir):
    """What becomes of every third cell's point as a control point."""
    surface = cells(spark, sf_dir)
    at = surface.select((F.col("i") * 50 + F.col("j")).alias("id"), (F.col("j") + 0.25).alias("x"), (F.col("i") + 0.125).alias("y")).where("id % 3 = 0")
    return units.place(at, grid.accumulate(grid.d8(surface)), threshold=4, most=2.0, far=0.7, least_cells=6).withColumn("offset", r("offset", 6))


_UNIT_LINES = """ln AS (SELECT i * 50 + j AS edge, i, j, sqrt(2.5 ** 2 + 1.25 ** 2) AS length FROM cells WHERE (i * 50 + j) % 4 = 1),
zl AS (SELECT ln.edge, length, coalesce(a.label, b.label) AS label FROM ln LEFT JOIN lab a ON a.i = ln.i + 1 AND a.j = ln.j + 3 LEFT JOIN lab b ON b.i = ln.i + 1 AND b.j = ln.j + 1)"""


@query(f"""{_UNITS.rsplit('SELECT label, i, j, acc, round(d, 6)', 1)[0].rstrip()}, {_UNIT_LINES},
un AS (SELECT label, acc, parent, area, z_mean, format('S{{:02d}}', row_number() OVER (ORDER BY depth DESC, area DESC, label)) AS code FROM sd JOIN pa USING (label) JOIN lv USING (label) JOIN z USING (label)),
rv AS (SELECT label, count(*) AS n_edges, sum(length) AS river_length FROM zl WHERE label IS NOT NULL GROUP BY label), ab AS (SELECT parent AS label, string_agg(code, ' ' ORDER BY code) AS upstream FROM un WHERE parent IS NOT NULL GROUP BY parent),
zz AS (SELECT label, min(z) AS z_min, max(z) AS z_max FROM lab JOIN cells USING (i, j) GROUP BY label), ss AS (SELECT label, string_agg('P' || (i * 50 + j), ' ' ORDER BY 'P' || (i * 50 + j)) AS stations FROM lab WHERE (i * 50 + j) % 11 = 5 GROUP BY label)
SELECT un.code, 'point ' || label AS name, un.area, coalesce(p.code, '') AS parent, coalesce(upstream, '') AS upstream, round(coalesce(river_length, 0), 6) AS river_length, coalesce(n_edges, 0)::BIGINT AS n_edges, round(z_min, 4) AS z_min, round(z_max, 4) AS z_max, round(un.z_mean, 4) AS z_mean, un.acc, coalesce(stations, '') AS stations
FROM un LEFT JOIN (SELECT label AS parent, code FROM un) p USING (parent) LEFT JOIN rv USING (label) LEFT JOIN ab USING (label) LEFT JOIN zz USING (label) LEFT JOIN ss USING (label)""")
def unit_report(spark, sf_dir):
    """The units of ``delineate_units`` with the lines from every fourth cell and the stations in every eleventh."""
    surface = cells(spark, sf_dir)
    flows, key = grid.d8(surface), F.col("i") * 50 + F.col("j")
    at = surface.select(key.alias("id"), (F.col("j") + 0.25).alias("x"), (F.col("i") + 0.125).alias("y")).where("id % 7 = 0")
    found, labels = units.delineate(flows, grid.accumulate(flows), at, threshold=3, most=3.0, least_cells=4, cell_area=0.25)
    ends = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("j") + 2.5 * k).alias("x"), (F.col("i") + 1.25 * k).alias("y")) for k in (0, 1)])
    lines = surface.where(key % 4 == 1).select(key.alias("edge"), F.explode(ends).alias("p")).select("edge", "p.*")
    stations = units.zones_at(surface.where(key % 11 == 5).select(F.concat(F.lit("P"), key.cast("string")).alias("name"), F.col("j").alias("x"), F.col("i").alias("y")), labels, "name")
    lengths = lines.select("edge").distinct().withColumn("length", F.lit((2.5**2 + 1.25**2) ** 0.5))
    names = found.select("label", F.concat(F.lit("point "), F.col("label").cast("string")).alias("name"))
    rows = units.report(found, names, units.zones_of_lines(lines, labels), lengths, stations)
    return rows.withColumns({"river_length": r("river_length", 6), "z_min": r("z_min"), "z_max": r("z_max"), "z_mean": r("z_mean")})


@query("""SELECT source, id, name, x, y, attached FROM (SELECT 'station' AS source, s_suppkey::VARCHAR AS id, s_name AS name, s_suppkey::DOUBLE AS x, s_nationkey::DOUBLE AS y, s_suppkey % 2 = 0 AS attached FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'manual', p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE p_name END, p_partkey, p_size, true FROM part WHERE p_partkey % 7 != 0 UNION ALL SELECT 'junction', c_custkey::VARCHAR, c_custkey::VARCHAR, c_custkey, 1, true FROM customer WHERE c_custkey % 4 = 1 AND (c_custkey % 5 = 0 OR c_acctbal >= 100))""")
def control_candidates(spark, sf_dir):
    """Suppliers as stations, parts as points given by hand, customers as nodes."""
    k = F.col("s_suppkey")
    stations = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "hydro").otherwise("rain").alias("type"), k.alias("x"), F.col("s_nationkey").alias("y"), F.when(k % 2 == 0, True).alias("attached"))
    k = F.col("p_partkey")
    manual = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 2 == 1, F.col("p_name")).alias("name"), F.when(k % 7 != 0, k).alias("x"), F.col("p_size").alias("y"))
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 == 1, "junction").otherwise("node").alias("kind"), k.alias("x"), F.lit(1).alias("y"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("area"))
    return units.candidates(stations, manual, nodes, 100.0)


@query(f"WITH RECURSIVE {D8_SQL}, {UPS}, ac AS (SELECT ri AS i, rj AS j, count(*) AS acc FROM up GROUP BY ri, rj) SELECT i, j, acc FROM ac ORDER BY acc DESC, i, j LIMIT 1")
def outlet_cell(spark, sf_dir):
    return units.outlet(grid.accumulate(grid.d8(cells(spark, sf_dir))))


@query(f"WITH {CELLS}, p AS (SELECT i * 50 + j AS id, i + 1 AS i, j FROM cells WHERE (i + j) % 3 = 0) SELECT p.id, round(min(z), 4) AS low, round(max(z), 4) AS high FROM p LEFT JOIN cells c ON c.i BETWEEN p.i - 2 AND p.i + 2 AND c.j BETWEEN p.j - 2 AND p.j + 2 GROUP BY p.id")
def window_extremes(spark, sf_dir):
    surface = cells(spark, sf_dir)
    points = surface.where((F.col("i") + F.col("j")) % 3 == 0).select((F.col("i") * 50 + F.col("j")).alias("id"), (F.col("i") + 1).alias("i"), "j")
    return grid.around(points, surface, "z", 2).withColumns({"low": r("low"), "high": r("high")})


@query("SELECT label, min(embedding[1])::DOUBLE AS x_min, min(embedding[2])::DOUBLE AS y_min, max(embedding[1])::DOUBLE AS x_max, max(embedding[2])::DOUBLE AS y_max FROM embeddings GROUP BY label")
def extents(spark, sf_dir):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return attach.extent(table(spark, sf_dir, "embeddings").select("label", at(0).alias("x"), at(1).alias("y")), ["label"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name, 2::INT AS n_kept FROM customer")
def feature_names(spark, sf_dir):
    """The first name that is not empty, and how many attributes are not hidden."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "").otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.create_map(F.lit(" Name"), name, F.lit("ALIAS"), F.col("c_mktsegment"), F.lit("_id"), k.cast("string")).alias("props"))
    return rows.select("c_custkey", props.pick(F.col("props"), ["name", "alias"]).alias("name"), F.size(props.clean(F.col("props"))).alias("n_kept"))


_KINDS = "['Point', 'MultiPoint', 'LineString', 'MultiPolygon', 'Other']"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'hydro_station' WHEN p_partkey % 4 = 1 THEN 'river' WHEN k = 'LineString' THEN 'river' WHEN k = 'MultiPolygon' THEN 'lake' ELSE 'other' END AS layer_type,
k IN ('Point', 'MultiPoint') AS fits FROM (SELECT p_partkey, {_KINDS}[p_partkey % 5 + 1] AS k FROM part)""")
def layer_types(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Point", "MultiPoint", "LineString", "MultiPolygon", "Other")]), (k % 5 + 1).cast("int"))
    name = F.when(k % 4 == 0, "Lake stations").when(k % 4 == 1, "main stream").when(k % 4 == 2, "")
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), kind.alias("kind"))
    return rows.select("p_partkey", props.layer_type(F.col("name"), F.col("kind"), NAME_HINTS, GEOMETRY_TYPES).alias("layer_type"), props.same_geometry(F.lit("Point"), F.col("kind")).alias("fits"))


@query("""SELECT o_orderkey, CASE WHEN k < 2 THEN 'warmup' WHEN k < floor(2 + (n - 2) * 0.75::DOUBLE) THEN 'calibration' ELSE 'validation' END AS period
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def calibration_split(spark, sf_dir):
    return metrics.split_periods(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 2, 0.75).select("o_orderkey", "period")


_ERRORS = "e AS (SELECT p_size, (f - p_retailprice) / abs(p_retailprice) AS error FROM part JOIN (SELECT l_partkey, avg(l_extendedprice) AS f FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"


@query(f"WITH {_ERRORS} SELECT p_size, count(*) AS n, round(median(error), 6) AS median, round(min(error), 6) AS least, round(max(error), 6) AS greatest, round(max(abs(error)), 6) AS worst FROM e GROUP BY p_size")
def parameter_recovery(spark, sf_dir):
    """How far mean line prices lie from the parts' own, by size."""
    truth = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("value"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_extendedprice").alias("value"))
    errors = metrics.relative_errors(truth, found, ["p_partkey"]).join(truth.select("p_partkey", "p_size"), "p_partkey")
    return metrics.error_summary(errors, ["p_size"]).withColumns({c: r(c, 6) for c in ("median", "least", "greatest", "worst")})


@query("SELECT o_orderdate, round(sin(dayofyear(o_orderdate) * 2 * pi() / 365.25), 6) + 0 AS season_sin, round(cos(dayofyear(o_orderdate) * 2 * pi() / 365.25), 6) + 0 AS season_cos FROM (SELECT DISTINCT o_orderdate FROM orders)")
def season_terms(spark, sf_dir):
    sine, cosine = series.season_terms(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderdate").distinct().select("o_orderdate", r(sine, 6).alias("season_sin"), r(cosine, 6).alias("season_cos"))


@query("SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderpriority")
def first_seen(spark, sf_dir):
    return series.first_seen(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query(f"WITH RECURSIVE {TREE}, x AS (SELECT parent AS id FROM tree WHERE parent IS NOT NULL), d AS (SELECT id, count(*) AS n_in FROM x GROUP BY id) SELECT kind, count(*) AS nodes, round(sum(len), 2) AS len FROM (SELECT n.id, len, CASE WHEN n_in IS NULL THEN 'source' WHEN parent IS NULL THEN 'outlet' WHEN n_in >= 2 THEN 'junction' ELSE 'node' END AS kind FROM n LEFT JOIN d USING (id)) GROUP BY kind")
def topology_stats(spark, sf_dir):
    """Nodes and length of the reaches below them, by kind of node."""
    whole = tree(spark, sf_dir)
    kinds = network.node_kinds(whole.where("parent is not null").select(F.col("id").alias("from_node"), F.col("parent").alias("to_node")))
    return whole.join(kinds, "id").groupBy("kind").agg(F.count("*").alias("nodes"), r(F.sum("len"), 2).alias("len"))


_AREAS = f"""WITH RECURSIVE {D8_SQL}, {UPS}, ac AS (SELECT ri AS i, rj AS j, count(*) AS acc FROM up GROUP BY ri, rj), sz AS (SELECT max(i) + 1 AS n FROM cells),
pt AS (SELECT c_custkey AS node, c_custkey % 67 * 0.01::DOUBLE + 100 AS x, c_custkey % 41 * 0.005::DOUBLE + 30 AS y FROM customer),
spot AS (SELECT node, round_even(n - 0.5 - (y - 30) / 0.01, 0)::INT AS i, round_even((x - 100) / 0.01 - 0.5, 0)::INT AS j, n FROM pt, sz)"""


@query(f"""{_AREAS} SELECT node, round(CASE WHEN any_value(spot.i) BETWEEN 0 AND any_value(n) - 1 AND any_value(spot.j) BETWEEN 0 AND 49 THEN max(acc) * (0.01 * 111320 * cos(radians(30 + any_value(n) * 0.01 / 2)) * 0.01 * 110540 / 1e6) END, 3) AS area,
any_value(c.z) AS z FROM spot LEFT JOIN ac ON ac.i BETWEEN spot.i - 2 AND spot.i + 2 AND ac.j BETWEEN spot.j - 2 AND spot.j + 2 LEFT JOIN cells c ON c.i = spot.i AND c.j = spot.j GROUP BY node""")
def node_areas(spark, sf_dir):
    """Heights and areas upstream of customers as nodes in degrees, some of them outside the raster."""
    surface = cells(spark, sf_dir)
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(k.alias("node"), ((k % 67) * 0.01 + 100).alias("x"), ((k % 41) * 0.005 + 30).alias("y"))
    raster = context.Raster(100.0, 30.0, 0.01, surface.agg(F.max("i")).head()[0] + 1, 50)
    areas = context.area_at(nodes, grid.accumulate(grid.d8(surface)), raster)
    return areas.join(context.heights_at(nodes, surface, raster), "node").select("node", r("area", 3).alias("area"), "z")


@query("""WITH p AS (SELECT label, vec_id // 40 AS part, row_number() OVER (PARTITION BY label, vec_id // 40 ORDER BY vec_id) - 1 AS k, count(*) OVER (PARTITION BY label, vec_id // 40) AS n, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS u, embedding[4]::DOUBLE AS v FROM embeddings),
m AS (SELECT label * 1000 + part AS id, x, y, u, v FROM p WHERE k = n // 2) SELECT a.id AS segment, arg_min(b.id, (sqrt((a.x - b.u) ** 2 + (a.y - b.v) ** 2), b.id)) AS edge FROM m a, m b GROUP BY a.id""")
def segment_edges(spark, sf_dir):
    """Pieces of the vectors' first two numbers, and of their next two, by their middle vertices. From the thousandth on pieces of several labels share an id, which then has the nearest edge of any of them."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    part = F.call_function("div", F.col("vec_id"), F.lit(40))
    rows = table(spark, sf_dir, "embeddings").select(F.struct((F.col("label").cast("long") * 1000 + part).alias("id"), "label").alias("edge"), F.col("vec_id").alias("k"), *[at(i).alias(f"c{i}") for i in range(4)])
    lines = lambda a, b: simplify.renumbered(rows.select("edge", "k", F.col(a).alias("x"), F.col(b).alias("y")))
    found = context.segments_to_edges(lines("c0", "c1").withColumnRenamed("edge", "segment"), lines("c2", "c3"))
    best = found.groupBy(F.col("segment.id").alias("segment")).agg(F.min(F.struct("distance", F.col("edge.id").alias("edge"))).alias("m"))
    return best.select("segment", "m.edge")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 != 0 AND c_custkey % 6 != 3 THEN c_custkey + 0.5::DOUBLE ELSE c_nationkey::DOUBLE END AS x,
CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 != 0 AND c_custkey % 6 != 3 THEN 1 ELSE c_acctbal::DOUBLE END AS y FROM customer""")
def layout_overrides(spark, sf_dir):
    """Customers' places, a part of them moved by hand; some moves lack a number."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    moves = rows.where((k % 3 == 0) & (k % 5 != 0)).select("c_custkey", (k + 0.5).alias("x"), F.when(k % 6 != 3, 1.0).alias("y"))
    moves = moves.unionByName(moves.select((-1 - F.col("c_custkey")).alias("c_custkey"), "x", "y"))
    return context.overridden(rows.select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").cast("double").alias("y")), moves, "c_custkey", ["x", "y"])
