"""Lengths, areas and coordinate shifts as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in metres, and the rounded one in kilometres for distances between outlets.
EARTH_M, EARTH_KM = 6371008.8, 6371.0
# Metres a degree of longitude (at the equator) and of latitude in the planar approximations.
LON_M, LAT_M, AREA_KM = 111320.0, 110540.0, 111.32
# Fixed values of the GCJ-02 shift: semi-major axis and squared eccentricity.
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162296594323


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def planar_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the plane that touches at the mean latitude."""
    return F.hypot((lon2 - lon1) * LON_M * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * LAT_M)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of longitude and of latitude, by the usual series."""
    r = F.radians(lat)
    lon = 111412.84 * F.cos(r) - 93.5 * F.cos(3 * r) + 0.118 * F.cos(5 * r)
    return lon, 111132.92 - 559.82 * F.cos(2 * r) + 1.175 * F.cos(4 * r)


def _along(points: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Sum of ``step`` over neighbours of an array<struct<x, y>>; 0 for fewer than two points."""
    after = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    before = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(before, after, step), F.lit(0.0), lambda total, d: total + d)


def polyline_length(points: Column) -> Column:
    """Metres along a line of lon/lat points."""
    return _along(points, lambda a, b: haversine(a["x"], a["y"], b["x"], b["y"]))


def planar_length(points: Column) -> Column:
    """Metres along a line of lon/lat points, each step on the plane that touches at its mean latitude."""
    return _along(points, lambda a, b: planar_distance(a["x"], a["y"], b["x"], b["y"]))


def row_col(lon: Column, lat: Column, xll: float, yll: float, cellsize: float, nrows: int) -> tuple[Column, Column]:
    """Row (from the north) and column of the cell that a point lies in."""
    return (nrows - 1 - F.floor((lat - yll) / cellsize)).cast("int"), F.floor((lon - xll) / cellsize).cast("int")


def cell_centre(i: Column, j: Column, xll: float, yll: float, cellsize: float, nrows: int) -> tuple[Column, Column]:
    """Longitude and latitude of a cell's centre."""
    return (j + 0.5) * cellsize + xll, (nrows - 0.5 - i) * cellsize + yll


def cell_area_km2(i: Column, yll: float, cellsize: float, nrows: int) -> Column:
    """Area of a cell of row i; cells of more than half a unit are in metres already."""
    if abs(cellsize) > 0.5:
        return F.lit(cellsize * cellsize / 1e6)
    lat = (nrows - i - 0.5) * cellsize + yll
    return F.cos(F.radians(lat)) * (cellsize * LON_M) * (cellsize * LAT_M) / 1e6


def polygon_area_km2(ring: Column) -> Column:
    """Area of a closed lon/lat ring, planar at its mean latitude."""
    twice = _along(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    mean_lat = F.aggregate(ring, F.lit(0.0), lambda total, p: total + p["y"]) / F.size(ring)
    return F.abs(twice) / 2 * AREA_KM * AREA_KM * F.cos(F.radians(mean_lat))


# The coefficients of the published GCJ-02 polynomial, in its order.
def _gcj_offset(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lon - 105.0, lat - 35.0
    wave = lambda v, k, n: F.sin(v * (k * math.pi)) * n
    common = (wave(x, 6, 20.0) + wave(x, 2, 20.0)) * 2 / 3
    dlat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + common
    dlat = dlat + (wave(y, 1, 20.0) + wave(y, 1 / 3, 40.0)) * 2 / 3 + (wave(y, 1 / 12, 160.0) + wave(y, 1 / 30, 320.0)) * 2 / 3
    dlon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + common
    dlon = dlon + (wave(x, 1, 20.0) + wave(x, 1 / 3, 40.0)) * 2 / 3 + (wave(x, 1 / 12, 150.0) + wave(x, 1 / 30, 300.0)) * 2 / 3
    r = F.radians(lat)
    magic = 1 - GCJ_EE * F.pow(F.sin(r), 2)
    meridian = GCJ_A * (1 - GCJ_EE) / (magic * F.sqrt(magic))
    return F.degrees(dlon / (GCJ_A / F.sqrt(magic) * F.cos(r))), F.degrees(dlat / meridian)


def to_gcj(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS-84 to GCJ-02; points outside the box in which the shift is defined stay."""
    inside = lon.between(72.004, 137.8347) & lat.between(0.8293, 55.8271)
    dlon, dlat = _gcj_offset(lon, lat)
    return F.when(inside, lon + dlon).otherwise(lon), F.when(inside, lat + dlat).otherwise(lat)


def from_gcj(lon: Column, lat: Column, rounds: int = 4) -> tuple[Column, Column]:
    """GCJ-02 to WGS-84 by fixed-point steps: each takes off the shift of the last guess. A fold, so that the expression doesn't grow with the rounds."""

    def step(at: Column, _: Column) -> Column:
        gx, gy = to_gcj(at["x"], at["y"])
        return F.struct((at["x"] + at["lon"] - gx).alias("x"), (at["y"] + at["lat"] - gy).alias("y"), at["lon"].alias("lon"), at["lat"].alias("lat"))

    lon, lat = lon.cast("double"), lat.cast("double")
    first = F.struct(lon.alias("x"), lat.alias("y"), lon.alias("lon"), lat.alias("lat"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)
    return found["x"], found["y"]
