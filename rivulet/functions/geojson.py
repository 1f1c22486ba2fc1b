"""GeoJSON text as columns: geometries of any type and depth as rows of vertices, and features of layers by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How deep the positions of a geometry type lie, and the kind of its parts.
DEPTHS = {"Point": 1, "MultiPoint": 2, "LineString": 2, "LinearRing": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
KINDS = {"Point": "point", "MultiPoint": "point", "LineString": "line", "LinearRing": "line", "MultiLineString": "line", "Polygon": "polygon", "MultiPolygon": "polygon"}


def features(text: Column) -> Column:
    """The features of a GeoJSON text as an array of texts: those of a collection, or the feature itself; null for other texts."""
    seen = F.from_json(text, "type string, features array<string>")
    return F.when(seen["type"] == "FeatureCollection", seen["features"]).when(seen["type"] == "Feature", F.array(text))


def properties(feature: Column) -> Column:
    """A feature's properties as a map of texts; empty if it has none."""
    return F.coalesce(F.from_json(feature, "properties map<string,string>")["properties"], F.create_map().cast("map<string,string>"))


def geometry_type(feature: Column) -> Column:
    return F.from_json(feature, "geometry struct<type:string>")["geometry"]["type"]


def _nested(kind: Column, text: Column) -> Column:
    """Coordinates as parts, rings, vertices and numbers."""
    at = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    one = lambda x: F.array(x)
    forms = {
        "Point": F.array(F.array(F.array(at(1)))), "MultiPoint": F.transform(at(2), lambda p: F.array(F.array(p))), "LineString": F.array(F.array(at(2))), "LinearRing": F.array(F.array(at(2))),
        "MultiLineString": F.transform(at(3), one), "Polygon": F.array(at(3)), "MultiPolygon": at(4),
    }
    found = F.lit(None).cast("array<array<array<array<double>>>>")
    for name, form in forms.items():
        found = F.when(kind == name, form).otherwise(found)
    return found


def vertices(rows: DataFrame, feature: str, keep: Sequence[str], kinds: Sequence[str] = ("point", "line", "polygon")) -> DataFrame:
    """(keep..., kind, part, ring, k, x, y): the vertices of features of these kinds, all counted from 0; further numbers of a position go.

    Multiple geometries have several parts, a polygon's first ring is its outline, all others have ring 0. Features
    without a geometry, with an empty, broken or unknown one (collections too), empty parts and positions without two
    numbers give no rows; nothing but built-in functions reads the text, so no Python worker does.
    """
    shape = F.from_json(F.col(feature), "geometry struct<type:string,coordinates:string>")["geometry"]
    known = rows.select(*keep, shape["type"].alias("_type"), shape["coordinates"].alias("_text"))
    kind = F.lit(None).cast("string")
    for name, value in KINDS.items():
        kind = F.when(F.col("_type") == name, value).otherwise(kind)
    known = known.withColumn("kind", kind).where(F.col("kind").isin(*kinds))
    parts = known.select(*keep, "kind", F.posexplode(_nested(F.col("_type"), F.col("_text"))).alias("part", "_part"))
    rings = parts.select(*keep, "kind", "part", F.posexplode("_part").alias("ring", "_ring"))
    found = rings.select(*keep, "kind", "part", "ring", F.posexplode("_ring").alias("k", "_at"))
    numbers = [F.get("_at", F.lit(0)).alias("x"), F.get("_at", F.lit(1)).alias("y")]
    return found.select(*keep, "kind", "part", "ring", "k", *numbers).where("x is not null and y is not null")


def layers_of_types(layers: DataFrame, types: Sequence[str]) -> DataFrame:
    """The rows of ``layers`` (layer, name, type, ...) of any of the types."""
    return layers.where(F.col("type").isin(*types))


def find_layer(layers: DataFrame, kind: str, order: str = "layer") -> DataFrame:
    """The first layer of a type by ``order``; no row if there is none."""
    rest = [c for c in layers.columns if c != order]
    first = layers.where(F.col("type") == kind).agg(F.min(F.struct(order, *rest)).alias("_m")).where("_m is not null")
    return first.select("_m.*").select(*layers.columns)


def features_of_types(features: DataFrame, layers: DataFrame, types: Sequence[str]) -> DataFrame:
    """``features`` (layer, ..., props map) of the layers of any of the types, with the layer's id, name and type among the properties.

    The catalogue of layers is small next to the features; Spark decides by its size whether to broadcast it.
    """
    told = layers_of_types(layers, types).select("layer", F.map_from_arrays(F.array(F.lit("_layer_id"), F.lit("_layer_name"), F.lit("_layer_type")), F.array(F.col("layer").cast("string"), "name", "type")).alias("_told"))
    joined = features.join(told, "layer")
    own = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda key, _: ~key.isin("_layer_id", "_layer_name", "_layer_type"))
    return joined.withColumn("props", F.map_concat(own, "_told")).drop("_told")
