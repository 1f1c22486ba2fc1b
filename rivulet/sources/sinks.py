"""Exports: series files, wide flows, long parameters, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series_rows(series: DataFrame, places: int = 4) -> DataFrame:
    """(station, time, value) as text: minutes, and values of ``places`` decimals without trailing zeros."""
    text = F.format_string(f"%.{places}f", F.col("value"))
    return series.select("station", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("time"), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "").alias("value"))


def write_series(series: DataFrame, path: str) -> None:
    """One CSV folder for each station."""
    series_rows(series).write.partitionBy("station").option("header", True).csv(path)


def pivot_flows(series: DataFrame, stations: list[str], key: str = "station", ts: str = "ts", value: str = "value") -> DataFrame:
    """One row for each time with a column for each station (their list is given, so nothing is scanned for it)."""
    return series.groupBy(ts).pivot(key, stations).agg(F.first(value))


def unpivot_params(params: DataFrame, unit: str, names: list[str]) -> DataFrame:
    """(unit, param, value): a row for each parameter of each unit."""
    return params.unpivot([unit], names, "param", "value")


def feature(geometry_type: str, coordinates: Column, **properties: Column) -> Column:
    """One GeoJSON feature as text."""
    shape = F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties")))


def grid_lines(cells: DataFrame, nrows: int, ncols: int, nodata: str = "-9999") -> DataFrame:
    """(i, line): every row of an ESRI ASCII grid as text, from cells (i, j, z); cells that aren't there hold ``nodata``. A row is one line, so it is put together in one place."""
    found = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", F.col("z").cast("string").alias("z")))).alias("_at"))
    rows = cells.sparkSession.range(nrows).select(F.col("id").cast("int").alias("i")).join(found, "i", "left")
    line = F.transform(F.sequence(F.lit(0), F.lit(ncols - 1)), lambda j: F.coalesce(F.try_element_at("_at", j), F.lit(nodata)))
    return rows.select("i", F.array_join(line, " ").alias("line"))


def write_ascii_grid(cells: DataFrame, path: str, nrows: int, ncols: int, xll: float, yll: float, cellsize: float, nodata: str = "-9999") -> None:
    """A folder of text files: the six header lines and, in order, all rows."""
    head = [("ncols", ncols), ("nrows", nrows), ("xllcorner", xll), ("yllcorner", yll), ("cellsize", cellsize), ("NODATA_value", nodata)]
    first = cells.sparkSession.createDataFrame([(k - len(head), f"{name} {value}") for k, (name, value) in enumerate(head)], "i int, line string")
    first.unionByName(grid_lines(cells, nrows, ncols, nodata)).orderBy("i").select("line").write.text(path)


def _coordinates(lines: DataFrame, key: str) -> DataFrame:
    """(key, coordinates): a line's vertices (key, k, x, y) in order, as GeoJSON has them; a line is one feature, so it is put together in one place."""
    at = F.sort_array(F.collect_list(F.struct("k", F.array("x", "y").alias("at"))))
    return lines.groupBy(key).agg(F.transform(at, lambda v: v["at"]).alias("coordinates"))


def _features(shapes: DataFrame, told: DataFrame, key: str, geometry: str, kind: str) -> DataFrame:
    names = [c for c in told.columns if c != key]
    joined = shapes.join(told, key)
    return joined.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), feature(geometry, F.col("coordinates"), kind=F.lit(kind), id=F.col(key), **{n: F.col(n) for n in names}).alias("feature"))


def network_features(lines: DataFrame, edges: DataFrame, nodes: DataFrame, stations: DataFrame) -> DataFrame:
    """(kind, id, feature): a network as GeoJSON features: lines (edge, k, x, y) with the columns of ``edges``, ``nodes`` (node, x, y, ...) and ``stations`` (station, x, y, ...) as points. Every other column is a property."""
    found = _features(_coordinates(lines, "edge"), edges, "edge", "LineString", "river_edge")
    for rows, key, kind in ((nodes, "node", "node"), (stations, "station", "station_node")):
        found = found.unionByName(_features(rows.select(key, F.array("x", "y").alias("coordinates")), rows.drop("x", "y"), key, "Point", kind))
    return found


def unit_features(outlines: DataFrame, units: DataFrame, outlets: DataFrame) -> DataFrame:
    """(kind, id, feature): units as GeoJSON polygons from closed outlines (label, k, x, y) and their outlets (label, x, y) as points, with the columns of ``units`` (label, ...)."""
    rings = _coordinates(outlines, "label").withColumn("coordinates", F.array("coordinates"))
    points = outlets.select("label", F.array("x", "y").alias("coordinates"))
    return _features(rings, units, "label", "Polygon", "unit").unionByName(_features(points, units, "label", "Point", "unit_outlet"))


def write_features(features: DataFrame, path: str) -> None:
    """A folder of text files with a feature in every line."""
    features.select("feature").write.text(path)
