"""Delineation of units: control points on channels, the cells that drain to each, their order and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import attach, grid, network
from rivulet.operators.lineage import cut, shuffled


def snap(points: DataFrame, acc: DataFrame, threshold: int, most: float) -> DataFrame:
    """(id, i, j, acc, offset): the channel cell (acc of ``threshold`` or more) nearest to each point (id, x, y), x along j, y along i, in cells; none beyond ``most``."""
    channels = grid.streams(acc, threshold).withColumn("target", grid.cell_id())
    found = grid.nearest(points, channels.select("target", F.col("j").cast("double").alias("x"), F.col("i").cast("double").alias("y")), most)
    return found.join(shuffled(channels), "target").select("id", "i", "j", "acc", F.col("distance").alias("offset"))


def candidates(stations: DataFrame, manual: DataFrame, junctions: DataFrame, least_area: float = 0.0) -> DataFrame:
    """(source, id, name, x, y, attached) of possible control points: hydrological stations, points given by hand and junctions.

    Stations are (id, name, type, x, y, attached), points (id, name, x, y), junctions nodes (id, kind, x, y, area). Points
    without a place are none; junctions of a known area below ``least_area`` go. A missing name is the id.
    """
    shape = lambda rows, source, name, attached: rows.where("x is not null and y is not null").select(F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), F.coalesce(name.cast("string"), F.col("id").cast("string")).alias("name"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), attached.alias("attached"))
    hydro = shape(stations.where("type = 'hydro'"), "station", F.col("name"), F.coalesce(F.col("attached"), F.lit(False)))
    given = shape(manual, "manual", F.col("name"), F.lit(True))
    large = junctions.where((F.col("kind") == "junction") & (F.col("area").isNull() | (F.col("area") >= least_area)))
    return hydro.unionByName(given).unionByName(shape(large, "junction", F.col("id"), F.lit(True)))


def place(points: DataFrame, acc: DataFrame, threshold: int, most: float, far: float | None = None, least_cells: int = 0) -> DataFrame:
    """(id, status, i, j, acc, offset) of every point (id, x, y): what becomes of it as a control point.

    ``out of reach`` of any channel cell within ``most`` (its cell is null), ``same cell`` as one kept there (that of the
    smallest id), ``too small`` if fewer than ``least_cells`` drain there, ``far`` if kept but farther than ``far`` from its
    cell, else ``placed``. No point goes without a row.
    """
    found = points.select("id").join(shuffled(snap(points, acc, threshold, most)), "id", "left")
    first = found.where("i is not null").groupBy("i", "j").agg(F.min("id").alias("_first"))
    rated = found.join(shuffled(first), ["i", "j"], "left")
    off = F.col("offset") > far if far is not None else F.lit(False)
    status = F.when(F.col("i").isNull(), "out of reach").when(F.col("id") != F.col("_first"), "same cell").when(F.col("acc") < least_cells, "too small").when(off, "far").otherwise("placed")
    return rated.select("id", status.alias("status"), "i", "j", "acc", "offset")


def keep_largest(rows: DataFrame, keys: list[str], measure: str, tie: str) -> DataFrame:
    """One row for each key: that of the largest measure, ties to the smaller ``tie``; combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = F.struct(F.when(F.col(measure).isNull(), 1).otherwise(0).alias("_null"), (-F.col(measure)).alias("_most"), F.col(tie).alias("_tie"), F.struct(*others).alias("_row"))
    return rows.groupBy(*keys).agg(F.min(best).alias("_m")).select(*keys, "_m._row.*").select(*rows.columns)


def outlet(acc: DataFrame) -> DataFrame:
    """(i, j, acc) of the cell through which most drains; ties to the first by row and column."""
    return acc.agg(F.min(F.struct((-F.col("acc")).alias("_"), "i", "j", "acc")).alias("m")).where("m is not null").select("m.i", "m.j", "m.acc")


def parents(flows: DataFrame, labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(label, parent): the unit that the cell below each unit's seed (label, i, j) belongs to; null where there is none."""
    below = seeds.join(flows.select("i", "j", "down_i", "down_j"), ["i", "j"]).select("label", F.col("down_i").alias("i"), F.col("down_j").alias("j"))
    return below.join(labels.withColumnRenamed("label", "parent"), ["i", "j"], "left").select("label", "parent")


def drainage_rank(units: DataFrame, area: str) -> DataFrame:
    """``units`` (label, parent, ...) with depth and rank from 1: most steps to the outlet first, then the largest area, then the smaller label.

    Ranks are places within a depth plus the sizes of greater depths, so no task sorts all units.
    """
    deep = cut(units.join(network.levels(units.select(F.col("label").alias("id"), "parent")).select(F.col("id").alias("label"), F.col("level").alias("depth")), "label"))
    sizes = deep.groupBy("depth").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(F.desc("depth"))) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("depth").orderBy(F.desc(area), "label"))
    return deep.withColumn("_place", place).join(before, "depth").withColumn("rank", (F.col("_before") + F.col("_place")).cast("long")).drop("_before", "_place")


def at_share(lines: DataFrame, share: float) -> DataFrame:
    """(edge, x, y): the place of each line (edge, k, x, y) at a share of its length; 0 is its first vertex, 1 its last."""
    parts = attach.segments(lines)
    at = F.col("total") * share
    inside = parts.where((F.col("before") <= at) & (at <= F.col("before") + F.col("length")))
    u = F.coalesce(F.least(F.lit(1.0), F.try_divide(at - F.col("before"), F.col("length"))), F.lit(0.0))
    one = inside.groupBy("edge").agg(F.min_by(F.struct((F.col("ax") + u * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + u * (F.col("by") - F.col("ay"))).alias("y")), "k").alias("p"))
    return one.select("edge", "p.x", "p.y")


def zones_at(points: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, label): the zone of the cell (i, j, label) that each point (key, x, y) lies in, x along j and y along i, cells around whole numbers; null where none is."""
    cell = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    return points.select(key, cell("y").alias("i"), cell("x").alias("j")).join(labels.select("i", "j", "label"), ["i", "j"], "left").select(key, "label")


def zones_of_lines(lines: DataFrame, labels: DataFrame, shares: tuple[float, ...] = (1.0, 0.5)) -> DataFrame:
    """(edge, label): the zone of each line (edge, k, x, y): that of its lower end or, if this lies in none, that of its middle. Null if none does."""
    found = lines.select("edge").distinct()
    for n, share in enumerate(shares):
        found = found.join(zones_at(at_share(lines, share), labels, "edge").withColumnRenamed("label", f"_{n}"), "edge", "left")
    return found.select("edge", F.coalesce(*[f"_{n}" for n in range(len(shares))]).alias("label"))


def report(units: DataFrame, names: DataFrame, zoned: DataFrame, lengths: DataFrame, stations: DataFrame) -> DataFrame:
    """Units as rows of a report: code, name, area, parent, upstream (codes of the units just above, by code), river_length, n_edges, z_min, z_max, z_mean, acc, stations (names, sorted).

    ``names`` holds (label, name) of control points, ``zoned`` (edge, label), ``lengths`` (edge, length), ``stations`` (label,
    name). A unit without lines or stations has zeros and empty texts.
    """
    rivers = zoned.where("label is not null").join(lengths, "edge").groupBy("label").agg(F.count("*").alias("n_edges"), F.sum("length").alias("river_length"))
    above = units.where("parent is not null").groupBy(F.col("parent").alias("label")).agg(F.array_join(F.sort_array(F.collect_list("code")), " ").alias("upstream"))
    held = stations.where("label is not null").groupBy("label").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("stations"))
    parent = units.select(F.col("label").alias("parent"), F.col("code").alias("parent_code"))
    joined = units.join(parent, "parent", "left").join(names, "label", "left").join(rivers, "label", "left").join(above, "label", "left").join(held, "label", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return joined.select("code", text("name"), "area", F.coalesce("parent_code", F.lit("")).alias("parent"), text("upstream"), F.coalesce("river_length", F.lit(0.0)).alias("river_length"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), "z_min", "z_max", "z_mean", "acc", text("stations"))


def delineate(flows: DataFrame, acc: DataFrame, points: DataFrame, threshold: int, most: float, least_cells: int = 0, cell_area: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Units of the control points (id, x, y): (label, i, j, acc, offset, parent, area, z_min, z_max, z_mean, relief, depth, rank, cumulative, code), and their cells (i, j, label).

    Points become control points as ``place`` tells (``far`` ones stay); cells belong to the first control point that their
    water passes.
    """
    kept = place(points, acc, threshold, most, None, least_cells).where("status = 'placed'").drop("status")
    seeds = cut(kept.withColumnRenamed("id", "label"))
    labels = cut(grid.watersheds(flows, seeds.select("i", "j", "label")).where("label is not null"))
    zones = grid.zonal(labels.join(flows.select("i", "j", "z"), ["i", "j"]), cell_area=cell_area).select("label", "area", "z_min", "z_max", "z_mean", "relief")
    units = cut(seeds.join(parents(flows, labels, seeds), "label").join(zones, "label"))
    below = network.upstream_sums(units.select(F.col("label").alias("id"), "parent", F.col("area").alias("cumulative")), ["cumulative"]).withColumnRenamed("id", "label")
    ranked = drainage_rank(units, "area").join(below, "label")
    return ranked.withColumn("code", F.concat(F.lit("S"), F.when(F.col("rank") < 10, F.concat(F.lit("0"), F.col("rank").cast("string"))).otherwise(F.col("rank").cast("string")))), labels
