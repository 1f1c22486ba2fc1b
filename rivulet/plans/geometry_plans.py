"""Queries of noding, source lines, zone outlines, simplification and networks with several ways down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import geojson
from rivulet.operators import attach, dag, noding, polygons, simplify
from rivulet.operators.lineage import cut
from rivulet.plans.common import query, r
from rivulet.plans.network_plans import TREE, tree
from rivulet.sources import sinks
from rivulet.sources.tables import table

_LINES = """v AS (SELECT label AS edge, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, vec_id * 0.02::DOUBLE + embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT * FROM (SELECT edge, k, x AS ax, y AS ay, lead(x) OVER w AS zx, lead(y) OVER w AS zy FROM v WINDOW w AS (PARTITION BY edge ORDER BY k)) WHERE zx IS NOT NULL)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each label that runs along the vectors' ids and wavers with their first two numbers."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("edge"), F.col("vec_id").alias("k"), (F.col("vec_id") * 0.02 + at(0)).alias("x"), at(1).alias("y"))
    return simplify.renumbered(rows)


@query(f"""WITH {_LINES}, p AS (SELECT a.edge, a.k, a.ax, a.ay, a.zx - a.ax AS rx, a.zy - a.ay AS ry, b.ax - a.ax AS qx, b.ay - a.ay AS qy, b.zx - b.ax AS sx, b.zy - b.ay AS sy FROM s a, s b WHERE a.edge != b.edge OR abs(a.k - b.k) > 1),
c AS (SELECT edge, k, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, ax, ay, rx, ry FROM p WHERE (qx * sy - qy * sx) / (rx * sy - ry * sx) BETWEEN 0 AND 1 AND (qx * ry - qy * rx) / (rx * sy - ry * sx) BETWEEN 0 AND 1),
n AS (SELECT edge, k, 0::DOUBLE AS t, x, y, 0 AS cut FROM v UNION ALL SELECT edge, k, t, ax + t * rx, ay + t * ry, 1 FROM c),
z AS (SELECT *, sum(cut) OVER (PARTITION BY edge ORDER BY k, t) + 1 AS piece FROM n)
SELECT edge, piece::BIGINT AS piece, (row_number() OVER (PARTITION BY edge, piece ORDER BY k, t) - 1)::INT AS k, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT edge, k, t, x, y, piece FROM z UNION ALL SELECT edge, k, t, x, y, piece - 1 FROM z WHERE cut = 1)""")
def node_lines(spark, sf_dir):
    return noding.node_lines(_lines(spark, sf_dir)).withColumns({"piece": F.col("piece").cast("long"), "x": r("x", 6), "y": r("y", 6)})


def _along(px: str, py: str, a: str, b: str) -> str:
    """SQL of the place on a segment that is nearest to a point, from 0 to 1."""
    return f"greatest(0, least(1, (({px} - {a}x) * ({b}x - {a}x) + ({py} - {a}y) * ({b}y - {a}y)) / (({b}x - {a}x) ** 2 + ({b}y - {a}y) ** 2)))"


def apart(px: str, py: str, a: str, b: str) -> str:
    """SQL of the distance of a point from a segment."""
    u = _along(px, py, a, b)
    return f"sqrt(({px} - {a}x - {u} * ({b}x - {a}x)) ** 2 + ({py} - {a}y - {u} * ({b}y - {a}y)) ** 2)"


_CROSS = "(zx - ax) * (dy - cy) - (zy - ay) * (dx - cx)"


@query(f"""WITH {_LINES}, pv AS (SELECT label AS edge, vec_id // 40 AS piece, vec_id AS k, vec_id * 0.02::DOUBLE + embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings),
ps AS (SELECT * FROM (SELECT edge, piece, k, x AS ax, y AS ay, lead(x) OVER w AS zx, lead(y) OVER w AS zy, row_number() OVER w AS n FROM pv WINDOW w AS (PARTITION BY edge, piece ORDER BY k)) WHERE zx IS NOT NULL),
src AS (SELECT edge AS line, k AS lk, ax AS cx, ay AS cy, zx AS dx, zy AS dy, sum(sqrt((zx - ax) ** 2 + (zy - ay) ** 2)) OVER (PARTITION BY edge ORDER BY k) - sqrt((zx - ax) ** 2 + (zy - ay) ** 2) AS before, sqrt((zx - ax) ** 2 + (zy - ay) ** 2) AS len FROM s),
m AS (SELECT ps.*, src.*, {_CROSS} AS x, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / ({_CROSS}) AS t, ((cx - ax) * (zy - ay) - (cy - ay) * (zx - ax)) / ({_CROSS}) AS u,
  least({apart('ax', 'ay', 'c', 'd')}, {apart('zx', 'zy', 'c', 'd')}, {apart('cx', 'cy', 'a', 'z')}, {apart('dx', 'dy', 'a', 'z')}) AS far, CASE WHEN n = 1 THEN {apart('(ax + zx) / 2', '(ay + zy) / 2', 'c', 'd')} END AS middle FROM ps, src),
g AS (SELECT edge, piece, line, min(round(CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN 0 ELSE far END, 9)) AS apart, min(round(middle, 9)) AS middle FROM m GROUP BY edge, piece, line),
b AS (SELECT * FROM g WHERE apart <= 0.05 QUALIFY row_number() OVER (PARTITION BY edge, piece ORDER BY apart, middle, line) = 1),
e AS (SELECT edge, piece, arg_min(ax, k) AS sx, arg_min(ay, k) AS sy, arg_max(zx, k) AS ex, arg_max(zy, k) AS ey FROM ps GROUP BY edge, piece),
w AS (SELECT edge, piece, min(({apart('sx', 'sy', 'c', 'd')}, before + {_along('sx', 'sy', 'c', 'd')} * len)) AS a, min(({apart('ex', 'ey', 'c', 'd')}, before + {_along('ex', 'ey', 'c', 'd')} * len)) AS z FROM b JOIN e USING (edge, piece) JOIN src USING (line) GROUP BY edge, piece)
SELECT edge, piece, line, apart AS distance, a[2] < z[2] AS forward FROM (SELECT DISTINCT edge, piece FROM ps) LEFT JOIN b USING (edge, piece) LEFT JOIN w USING (edge, piece)""")
def source_lines(spark, sf_dir):
    """Pieces of four vertices, by the vectors' next two numbers, and the lines within 0.05 of them."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    pieces = table(spark, sf_dir, "embeddings").select(F.col("label").alias("edge"), F.call_function("div", F.col("vec_id"), F.lit(40)).alias("piece"), F.col("vec_id").alias("k"), (F.col("vec_id") * 0.02 + at(2)).alias("x"), at(3).alias("y"))
    return noding.source_lines(pieces, _lines(spark, sf_dir), 0.05).withColumn("distance", r("distance", 9))


_ZONES = "c AS (SELECT (p_partkey // 50)::INT AS i, (p_partkey % 50)::INT AS j, ((p_partkey * 37) % 1009) // 400 AS label FROM part)"


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return table(spark, sf_dir, "part").select(div((k * 37) % 1009, 400).alias("label"), div(k, 50).cast("int").alias("i"), (k % 50).cast("int").alias("j"))


@query(f"""WITH {_ZONES}, q AS (SELECT label, i + di AS ci, j + dj AS cj, di * 2 + dj AS quarter FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS w(di, dj)),
p AS (SELECT label, count(*) AS n, sum(quarter) = 3 AND min(quarter) != max(quarter) AND count(*) = 2 AS opposite FROM q GROUP BY label, ci, cj)
SELECT label, any_value(cells)::DOUBLE AS area, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN opposite THEN 2 ELSE 0 END)::BIGINT AS corners, (sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN opposite THEN 2 ELSE 0 END) / 4)::BIGINT AS parts_less_holes
FROM p JOIN (SELECT label, count(*) AS cells FROM c GROUP BY label) USING (label) GROUP BY label""")
def zone_rings(spark, sf_dir):
    """Of each zone what its rings enclose, their corners, and how many more parts than holes there are."""
    areas = polygons.ring_areas(polygons.rings(_zones(spark, sf_dir)))
    return areas.groupBy("label").agg(F.sum("area").alias("area"), F.sum("n").alias("corners"), F.sum(F.when(F.col("hole"), -1).otherwise(1)).alias("parts_less_holes"))


@query(f"""WITH RECURSIVE {_ZONES}, z AS (SELECT label, i * 50 + j AS id, i, j FROM c), near AS (SELECT a.id, b.id AS other FROM z a JOIN z b ON a.label = b.label AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
w AS (SELECT id AS root, id FROM z UNION SELECT w.root, near.other FROM w JOIN near USING (id)), part AS (SELECT id, min(root) AS part FROM w GROUP BY id),
sized AS (SELECT label, part, count(*) AS cells, min(i) AS i0, max(i) + 1 AS i1, min(j) AS j0, max(j) + 1 AS j1 FROM part JOIN z USING (id) GROUP BY label, part)
SELECT label, max(cells)::DOUBLE AS area FROM sized GROUP BY label""")
def largest_parts(spark, sf_dir):
    """The area of each zone's largest polygon, its holes taken off."""
    zones = cut(_zones(spark, sf_dir))
    found = polygons.polygons(zones, cut(polygons.rings(zones)))
    return found.groupBy("label", "polygon").agg(F.sum("area").alias("area")).groupBy("label").agg(F.max("area").alias("area"))


@query(f"""WITH RECURSIVE {_LINES}, iv AS (SELECT edge, 0::BIGINT AS low, max(k) AS high FROM v GROUP BY edge
UNION ALL SELECT edge, unnest([low, mid]), unnest([mid, high]) FROM (SELECT iv.edge, low, high, arg_max(q.k, ({apart('q.x', 'q.y', 'a.', 'b.')}, -q.k)) AS mid, max({apart('q.x', 'q.y', 'a.', 'b.')}) AS far FROM iv
JOIN v a ON a.edge = iv.edge AND a.k = low JOIN v b ON b.edge = iv.edge AND b.k = high JOIN v q ON q.edge = iv.edge AND q.k > low AND q.k < high GROUP BY iv.edge, low, high) WHERE far > 0.12)
SELECT edge, k::INT AS k, round(x, 6) AS x, round(y, 6) AS y FROM v WHERE (edge, k) IN (SELECT (edge, low) FROM iv UNION SELECT (edge, high) FROM iv)""")
def simplified_lines(spark, sf_dir):
    return simplify.simplify(_lines(spark, sf_dir), 0.12).select("edge", "k", r("x", 6).alias("x"), r("y", 6).alias("y"))


#: Customers k > 0 flow to (k - 1) div 2, every fifth also to (k - 1) div 3; edges are numbered 2k and 2k + 1.
_BRAID = """e AS (SELECT 2 * c_custkey AS edge, c_custkey AS f, (c_custkey - 1) // 2 AS t, abs(c_acctbal) AS len FROM customer WHERE c_custkey > 0
UNION ALL SELECT 2 * c_custkey + 1, c_custkey, (c_custkey - 1) // 3, abs(c_acctbal) * 2 FROM customer WHERE c_custkey > 0 AND c_custkey % 5 = 0)"""


def _braid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0").select(k.alias("k"), F.abs("c_acctbal").alias("len"))
    down = lambda b: F.call_function("div", F.col("k") - 1, F.lit(b))
    first = rows.select((2 * F.col("k")).alias("edge"), F.col("k").alias("from_node"), down(2).alias("to_node"), F.col("len").alias("length"))
    return first.unionByName(rows.where("k % 5 = 0").select((2 * F.col("k") + 1).alias("edge"), F.col("k").alias("from_node"), down(3).alias("to_node"), (F.col("len") * 2).alias("length")))


@query(f"""WITH RECURSIVE {_BRAID}, way AS (SELECT edge, len, t AS node FROM e UNION ALL SELECT way.edge, way.len, e.t FROM way JOIN e ON e.f = way.node),
n AS (SELECT node, sum(len) AS len, count(*) AS edges FROM way GROUP BY node) SELECT edge, round(coalesce(n.len, 0), 2) AS up_length, coalesce(n.edges, 0)::BIGINT AS up_edges FROM e LEFT JOIN n ON node = f""")
def braided_totals(spark, sf_dir):
    return dag.upstream_totals(_braid(spark, sf_dir)).select("edge", r("up_length", 2).alias("up_length"), "up_edges")


@query(f"""WITH RECURSIVE {_BRAID}, up AS (SELECT t AS node, edge FROM e UNION SELECT e.t, up.edge FROM up JOIN e ON e.f = up.node),
n AS (SELECT f AS node FROM e UNION SELECT t FROM e) SELECT n.node, count(up.edge) AS edges, round(coalesce(sum(len), 0), 2) AS length FROM n LEFT JOIN up USING (node) LEFT JOIN e USING (edge) GROUP BY n.node""")
def braided_reach(spark, sf_dir):
    return dag.distinct_totals(_braid(spark, sf_dir)).withColumn("length", r("length", 2))


#: Customers in blocks of 30 as trees; every fourth leaf turns its edge, which makes it an outlet.
_BLOCKS = """e AS (SELECT c_custkey AS edge, CASE WHEN turned THEN b + (l - 1) // 2 ELSE c_custkey END AS f, CASE WHEN turned THEN c_custkey ELSE b + (l - 1) // 2 END AS t, len
FROM (SELECT c_custkey, c_custkey // 30 * 30 AS b, c_custkey % 30 AS l, c_custkey % 30 >= 15 AND c_custkey % 4 = 1 AS turned, abs(c_acctbal) AS len FROM customer) WHERE l > 0)"""


@query(f"""WITH RECURSIVE {_BLOCKS}, way AS (SELECT edge, len, t AS node FROM e UNION ALL SELECT way.edge, way.len, e.t FROM way JOIN e ON e.f = way.node), n AS (SELECT node, sum(len) AS len FROM way GROUP BY node),
d AS (SELECT node, count(*) AS n, sum(leaves) AS leaves FROM (SELECT f AS node, 1 AS leaves FROM e UNION ALL SELECT t, 0 FROM e) GROUP BY node)
SELECT node // 30 * 30 AS component, arg_min(node, (n != 1, leaves > 0, -coalesce(len, 0), node)) AS root FROM d LEFT JOIN n USING (node) GROUP BY ALL""")
def longest_outlets(spark, sf_dir):
    k, local = F.col("c_custkey"), F.col("c_custkey") % 30
    up = k - local + F.call_function("div", local - 1, F.lit(2))
    turned = (local >= 15) & (k % 4 == 1)
    edges = table(spark, sf_dir, "customer").where(local > 0).select(k.alias("edge"), F.when(turned, up).otherwise(k).alias("from_node"), F.when(turned, k).otherwise(up).alias("to_node"), F.abs("c_acctbal").alias("length"))
    return dag.outlets(edges)


@query(f"""WITH RECURSIVE {TREE}, best AS (SELECT n.id, n.parent, s.total, row_number() OVER (PARTITION BY n.parent ORDER BY s.total DESC, n.id) AS k FROM n JOIN s USING (id)),
stem AS (SELECT id, id AS stem FROM best WHERE parent IS NULL OR k > 1 UNION ALL SELECT b.id, stem.stem FROM stem JOIN best b ON b.parent = stem.id AND b.k = 1),
ranked AS (SELECT id AS stem, row_number() OVER (ORDER BY total DESC, id) AS n FROM best WHERE parent IS NOT NULL AND k > 1)
SELECT id, stem, CASE WHEN n IS NULL THEN 'Main' WHEN n = 1 THEN 'Elm' WHEN n = 2 THEN 'Oak' ELSE format('Main tributary {{}}', n) END AS name FROM stem LEFT JOIN ranked USING (stem)""")
def river_names(spark, sf_dir):
    return dag.name_rivers(tree(spark, sf_dir), "len", "Main", ["Elm", "Oak"])


#: Customers as features: by key a point, some points, a line with heights, two lines, a polygon with a hole, two polygons, an empty line, none and a broken one.
_FORMS = (
    ("Point", "[{k}, 1]"), ("MultiPoint", "[[{k}, 1], [{k}, 2, 9]]"), ("LineString", "[[{k}, 1, 5.5], [{k}, 2, 6.5]]"), ("MultiLineString", "[[[{k}, 1], [{k}, 2]], [], [[{k}, 3], [{k}, 4]]]"),
    ("Polygon", "[[[{k}, 0], [{k}, 9], [0, 0], [{k}, 0]], [[1, 1], [2, 2], [1, 2], [1, 1]]]"), ("MultiPolygon", "[[[[{k}, 0], [0, 1], [{k}, 0]]], [[[{k}, 5], [0, 6], [{k}, 5]]]]"), ("LineString", "[]"), ("GeometryCollection", "[]"), ("Point", "[{k}"),
)


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    made = F.lit("")
    for n, (kind, form) in enumerate(_FORMS):
        parts = [F.lit(f'{{"type": "Feature", "properties": {{"Name": "')] + [text, F.lit(f'", "n": {n}}}, "geometry": {{"type": "{kind}", "coordinates": ')]  # noqa: F541
        pieces = form.split("{k}")
        for place, piece in enumerate(pieces):
            parts += [F.lit(piece)] if place == 0 else [text, F.lit(piece)]
        made = F.when(k % len(_FORMS) == n, F.concat(*parts, F.lit("}}"))).otherwise(made)
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("layer"), made.alias("feature"))


def _form_rows() -> str:
    """SQL of the vertices that each form has, a null x being the key."""
    rows = [(0, "point", 0, 0, 0, None, 1), (1, "point", 0, 0, 0, None, 1), (1, "point", 1, 0, 0, None, 2), (2, "line", 0, 0, 0, None, 1), (2, "line", 0, 0, 1, None, 2)]
    rows += [(3, "line", p, 0, k, None, y) for p, k, y in ((0, 0, 1), (0, 1, 2), (2, 0, 3), (2, 1, 4))]
    rows += [(4, "polygon", 0, 0, k, x, y) for k, (x, y) in enumerate(((None, 0), (None, 9), (0, 0), (None, 0)))] + [(4, "polygon", 0, 1, k, x, y) for k, (x, y) in enumerate(((1, 1), (2, 2), (1, 2), (1, 1)))]
    rows += [(5, "polygon", p, 0, k, x, y + 5 * p) for p in (0, 1) for k, (x, y) in enumerate(((None, 0), (0, 1), (None, 0)))]
    return ", ".join(str(row).replace("None", "NULL") for row in rows)


@query(f"SELECT c_custkey, kind, part::INT AS part, ring::INT AS ring, k::INT AS k, coalesce(x, c_custkey)::DOUBLE AS x, y::DOUBLE AS y FROM customer JOIN (VALUES {_form_rows()}) AS f(n, kind, part, ring, k, x, y) ON c_custkey % {len(_FORMS)} = n")
def feature_vertices(spark, sf_dir):
    return geojson.vertices(_forms(spark, sf_dir), "feature", ["c_custkey"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 != 8 THEN c_custkey::VARCHAR END AS name, n_nationkey::VARCHAR AS layer_id, n_name AS layer_name, CASE WHEN n_nationkey % 3 = 0 THEN 'river' ELSE 'lake' END AS layer_type
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 < 2""")
def layer_features(spark, sf_dir):
    """Nations are layers of three types; the features of two of them."""
    kind = F.element_at(F.array(F.lit("river"), F.lit("lake"), F.lit("other")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    layers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layer"), F.col("n_name").alias("name"), kind.alias("type"))
    rows = _forms(spark, sf_dir).withColumn("props", geojson.properties(F.col("feature")))
    found = geojson.features_of_types(rows, layers, ["river", "lake"])
    return found.select("c_custkey", *[F.col("props")[key].alias(name) for key, name in (("Name", "name"), ("_layer_id", "layer_id"), ("_layer_name", "layer_name"), ("_layer_type", "layer_type"))])


@query(f"""WITH {_LINES}, l AS (SELECT c_custkey AS id, c_custkey % 97 * 0.1::DOUBLE AS x, c_custkey % 31 * 0.03::DOUBLE - 0.4 AS y, (1 + c_custkey % 3) * 0.02::DOUBLE AS d FROM customer),
c AS (SELECT id, (4 * d * d * (x + d) - d * d / 4 * (x + d * 0.75)) / (4 * d * d - d * d / 4) AS px, (4 * d * d * (y + d) - d * d / 4 * (y + d * 0.75)) / (4 * d * d - d * d / 4) AS py FROM l)
SELECT id, arg_min(edge, ({apart('px', 'py', 'a', 'z')}, edge, k)) AS edge, round(min({apart('px', 'py', 'a', 'z')}), 6) AS distance FROM c, s GROUP BY id""")
def lake_edges(spark, sf_dir):
    """Customers as square lakes with a square island, and the lines nearest to their middles."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), ((k % 97) * 0.1).alias("x0"), ((k % 31) * 0.03 - 0.4).alias("y0"), ((1 + k % 3) * 0.02).alias("d"))
    ring = lambda n, points: F.struct(F.lit(n).alias("ring"), F.array(*[F.struct((F.col("x0") + F.col("d") * a).alias("x"), (F.col("y0") + F.col("d") * b).alias("y")) for a, b in points]).alias("at"))
    rings = F.array(ring(0, ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))), ring(1, ((0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1), (0.5, 0.5))))
    lakes = rows.select("id", F.explode(rings).alias("r")).select("id", F.lit(0).alias("part"), "r.ring", F.posexplode("r.at").alias("k", "p")).select("id", "part", "ring", "k", "p.x", "p.y")
    return attach.lakes_to_edges(lakes, _lines(spark, sf_dir)).select("id", "edge", r("distance", 6).alias("distance"))


@query(f"""WITH {_LINES} SELECT 'river_edge' AS kind, edge::VARCHAR AS id, 'line ' || edge AS name, 0::INT AS part, k::INT AS k, round(x, 6) AS x, round(y, 6) AS y FROM v
UNION ALL SELECT 'node', n_nationkey::VARCHAR, n_name, 0, 0, n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'station_node', s_suppkey::VARCHAR, s_name, 0, 0, s_suppkey, 0.5 FROM supplier""")
def network_features(spark, sf_dir):
    """Lines, nations as nodes and suppliers as stations written as features, and what reading them gives."""
    lines = _lines(spark, sf_dir)
    edges = lines.select("edge").distinct().withColumn("name", F.concat(F.lit("line "), F.col("edge").cast("string")))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"), F.col("n_name").alias("name"))
    stations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_suppkey").cast("double").alias("x"), F.lit(0.5).alias("y"), F.col("s_name").alias("name"))
    made = sinks.network_features(lines, edges, nodes, stations).withColumn("props", geojson.properties(F.col("feature")))
    back = geojson.vertices(made.select(F.col("props")["kind"].alias("told"), F.col("props")["id"].alias("id"), F.col("props")["name"].alias("name"), "feature"), "feature", ["told", "id", "name"])
    return back.select(F.col("told").alias("kind"), "id", "name", "part", "k", r("x", 6).alias("x"), r("y", 6).alias("y"))
