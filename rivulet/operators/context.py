"""What a raster of heights tells a network: filled heights, flows and accumulation at once, heights and areas at nodes, and which evidence directs edges."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.operators import grid
from rivulet.operators.lineage import cut

#: Metres of a degree along a meridian and along the equator.
NORTH, EAST = 110_540.0, 111_320.0


@dataclass
class Raster:
    """Where a raster lies: its lower left corner, the width of a cell and its rows and columns. A width up to 0.5 is in degrees."""

    xll: float
    yll: float
    cellsize: float
    n_rows: int
    n_columns: int

    def cell(self, x: str = "x", y: str = "y") -> tuple[Column, Column]:
        """Row and column of a place."""
        i = F.rint(F.lit(self.n_rows - 0.5) - (F.col(y) - self.yll) / self.cellsize).cast("int")
        return i, F.rint((F.col(x) - self.xll) / self.cellsize - 0.5).cast("int")

    @property
    def cell_area(self) -> float:
        """Square kilometres of a cell, in degrees that of the raster's middle latitude."""
        if abs(self.cellsize) > 0.5:
            return self.cellsize**2 / 1e6
        middle = math.radians(self.yll + self.n_rows * self.cellsize / 2)
        return self.cellsize * EAST * math.cos(middle) * self.cellsize * NORTH / 1e6


@dataclass
class Context:
    """A raster's heights (i, j, z) filled, its flows (i, j, z, code, down_i, down_j) with flats resolved, and its accumulation (i, j, acc)."""

    filled: DataFrame
    flows: DataFrame
    acc: DataFrame


def analyse(cells: DataFrame, eps: float = 1e-4, tolerance: float = 0.05, tile: int = grid.TILE) -> Context:
    """Everything that a network asks of a raster, computed once and kept in the shared folder."""
    filled = cut(grid.fill(cells, eps, tile))
    flows = cut(grid.resolve_flats(grid.d8(filled), tolerance, tile))
    return Context(filled, flows, cut(grid.accumulate(flows)))


def heights_at(points: DataFrame, cells: DataFrame, raster: Raster, key: str = "node") -> DataFrame:
    """(key, z): the height of the cell that each point (key, x, y) lies in; null outside and where there is no data."""
    i, j = raster.cell()
    return points.select(key, i.alias("i"), j.alias("j")).join(cells.select("i", "j", "z"), ["i", "j"], "left").select(key, "z")


def heights_of_edges(edges: DataFrame) -> DataFrame:
    """(node, z): of each node the height that its first edge (edge, from_node, to_node, height as text) with a number tells."""
    told = edges.select("edge", F.col("height").try_cast("double").alias("z"), F.explode(F.array("from_node", "to_node")).alias("node"))
    return told.groupBy("node").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("edge"))).alias("z"))


def evidence(from_raster: DataFrame | None, from_edges: DataFrame) -> tuple[str, DataFrame]:
    """What directs the edges, and the heights (node, z) to go by: ``dem`` if a raster tells any node's, else ``elevation_attribute`` if edges do, else ``digitized``."""
    if from_raster is not None and not from_raster.where("z is not null").isEmpty():
        return "dem", from_raster
    if not from_edges.where("z is not null").isEmpty():
        return "elevation_attribute", from_edges
    return "digitized", from_edges.limit(0)


def area_at(points: DataFrame, acc: DataFrame, raster: Raster, reach: int = 2, key: str = "node") -> DataFrame:
    """(key, area): square kilometres that drain through the fullest cell within ``reach`` rows and columns of each point (key, x, y); null for points outside the raster."""
    i, j = raster.cell()
    at = points.select(F.col(key).alias("id"), i.alias("i"), j.alias("j")).where(F.col("i").between(0, raster.n_rows - 1) & F.col("j").between(0, raster.n_columns - 1))
    found = grid.around(at, acc, "acc", reach).select(F.col("id").alias(key), (F.col("high") * raster.cell_area).alias("area"))
    return points.select(key).join(found, key, "left")


def middles(lines: DataFrame, key: str = "edge") -> DataFrame:
    """(key, x, y): of each line (key, k, x, y), k from 0, the vertex with n div 2 before it."""
    n = lines.groupBy(key).agg(F.count("*").alias("_n"))
    return lines.join(n, key).where(F.col("k") == F.call_function("div", F.col("_n"), F.lit(2))).select(key, "x", "y")


def segments_to_edges(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(segment, edge, distance): the edge whose middle vertex lies nearest to that of each segment; lines are (segment or edge, k, x, y). Ties go to the smaller edge."""
    found = grid.nearest(middles(segments, "segment").withColumnRenamed("segment", "id"), middles(edges).withColumnRenamed("edge", "target"))
    return found.select(F.col("id").alias("segment"), F.col("target").alias("edge"), "distance")


def overridden(layout: DataFrame, manual: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``layout`` with the values that ``manual`` (key, values...) has for the same key, where none of them is null; keys that only ``manual`` has are none of the layout's."""
    whole = F.lit(True)
    for v in values:
        whole &= F.col(f"_m_{v}").isNotNull()
    given = manual.select(key, *[F.col(v).alias(f"_m_{v}") for v in values])
    joined = layout.join(given, key, "left")
    return joined.select(*[F.when(whole, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) if c in values else c for c in layout.columns])
