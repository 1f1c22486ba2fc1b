"""Raster operators over cells (i, j, z); a cell that isn't there has no data."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import network
from rivulet.operators.lineage import cut, shuffled

# Row and column offset, distance and code of the eight neighbours, in the order that decides ties.
D8 = ((0, 1, 1.0, 1), (1, 1, math.sqrt(2), 2), (1, 0, 1.0, 4), (1, -1, math.sqrt(2), 8), (0, -1, 1.0, 16), (-1, -1, math.sqrt(2), 32), (-1, 0, 1.0, 64), (-1, 1, math.sqrt(2), 128))


def cell_id(i: str = "i", j: str = "j") -> Column:
    return F.shiftleft(F.col(i).cast("long"), 32) + F.col(j).cast("long")


def _neighbours(cells: DataFrame, *carried: str) -> DataFrame:
    """Every cell's values sent to its eight neighbours: (i, j) of the receiver, with order, distance and code of the way from it to the sender."""
    ways = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(-di).alias("di"), F.lit(-dj).alias("dj"), F.lit(d).alias("dist"), F.lit(code).alias("code")) for k, (di, dj, d, code) in enumerate(D8)])
    sent = cells.select("i", "j", *[F.col(c).alias(f"n_{c}") for c in carried], F.explode(ways).alias("w"))
    return sent.select((F.col("i") + F.col("w.di")).alias("i"), (F.col("j") + F.col("w.dj")).alias("j"), *[f"n_{c}" for c in carried], "w.k", "w.dist", "w.code", F.col("i").alias("down_i"), F.col("j").alias("down_j"))


def d8(cells: DataFrame) -> DataFrame:
    """(i, j, z, code, down_i, down_j): the neighbour with the steepest way down, ties to the first of E, SE, S, SW, W, NW, N, NE; code 0 where none is lower."""
    near = _neighbours(cells, "z").join(shuffled(cells), ["i", "j"])
    slope = (F.col("z") - F.col("n_z")) / F.col("dist")
    best = near.where(slope > 0).groupBy("i", "j").agg(F.max_by(F.struct("code", "down_i", "down_j"), F.struct(slope, -F.col("k"))).alias("b"))
    return cells.join(shuffled(best), ["i", "j"], "left").select("i", "j", "z", F.coalesce("b.code", F.lit(0)).alias("code"), "b.down_i", "b.down_j")


def forest(flows: DataFrame) -> DataFrame:
    """Cells as a forest: id, parent and the cell's columns."""
    return flows.withColumn("id", cell_id()).withColumn("parent", cell_id("down_i", "down_j"))


def accumulate(flows: DataFrame) -> DataFrame:
    """(i, j, acc): cells that drain through each, itself included."""
    sums = network.upstream_sums(forest(flows).withColumn("acc", F.lit(1).cast("long")), ["acc"])
    return flows.select("i", "j", cell_id().alias("id")).join(shuffled(sums), "id").select("i", "j", "acc")


def watersheds(flows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(i, j, label): label of the first seed (i, j, label) that a cell's water passes; null if it passes none."""
    marks = seeds.select(cell_id().alias("id"), "label")
    cells = forest(flows).join(marks, "id", "left").withColumn("marked", F.col("label").isNotNull())
    found = network.first_marked(cells.select("id", "parent", "marked"), "marked")
    return flows.select("i", "j", cell_id().alias("id")).join(found, "id").join(marks.withColumnRenamed("id", "mark"), "mark", "left").select("i", "j", "label")


def zonal(cells: DataFrame, label: str = "label", cell_area: float = 1.0) -> DataFrame:
    """Per label: cells, area, and lowest, highest and mean height and relief of the cells that have one."""
    return cells.groupBy(label).agg(
        F.count("*").alias("cells"), (F.count("*") * cell_area).alias("area"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), (F.max("z") - F.min("z")).alias("relief"),
    )


#: Rows and columns of a tile.
TILE = 256


def _in_tiles(cells: DataFrame, value: str, sink: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int) -> DataFrame:
    """``cells`` (i, j, z, value) with values sunk as far as ``sink`` (z, value -> lower values, from neighbours) can take them.

    Tiles sink by themselves until nothing moves in them, then tell the cells along their sides to the tiles beside them;
    this goes on while any cell moves, so rounds follow the tiles that a way crosses and not its cells. A task passes over
    its tiles in their order and sinks those of a batch of rows at once; ``sink`` gets them one behind the other.
    """
    at = lambda c, d=0: F.floor((F.col(c) + d) / tile).cast("int")
    ways = F.array(*[F.struct(at("i", a).alias("ti"), at("j", b).alias("tj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    home = F.struct(at("i").alias("ti"), at("j").alias("tj"))
    side = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        ti, tj, own = rows.ti.to_numpy(), rows.tj.to_numpy(), rows.own.to_numpy(bool)
        k = np.cumsum(np.r_[False, (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])])
        i, j = rows.i.to_numpy() - ti * tile + 1, rows.j.to_numpy() - tj * tile + 1
        z = np.full((k[-1] + 1, tile + 2, tile + 2), np.inf)
        v, mine = z.copy(), np.zeros(z.shape, bool)
        z[k, i, j], v[k, i, j], mine[k, i, j] = rows.z, rows.v, own
        before, moving = v.copy(), np.arange(len(v))
        while len(moving):
            old = v[moving]
            lower = np.where(mine[moving], np.minimum(old, sink(z[moving], old)), old)
            v[moving] = lower
            moving = moving[(lower != old).any(axis=(1, 2))]
        at = k[own], i[own], j[own]
        return pd.DataFrame({"i": rows.i[own], "j": rows.j[own], "z": z[at], "v": v[at], "moved": v[at] < before[at]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []  # of the last tile, which may go on in the next batch
        for rows in batches:
            if not len(rows):
                continue
            other = np.flatnonzero((rows.ti != rows.ti.iloc[-1]) | (rows.tj != rows.tj.iloc[-1]))
            first = other[-1] + 1 if len(other) else 0
            if parts and (first or tuple(parts[0].iloc[0][["ti", "tj"]]) != tuple(rows.iloc[0][["ti", "tj"]])):
                yield settle(pd.concat([*parts, rows[:first]]))
                parts = []
            elif first:
                yield settle(rows[:first])
            parts.append(rows[first:])
        if parts:
            yield settle(pd.concat(parts))

    state = cut(cells.select("i", "j", F.col("z").cast("double").alias("z"), F.col(value).cast("double").alias("v")))
    while True:
        beside = state.where(side("i") | side("j")).select("i", "j", "z", "v", F.explode(F.array_remove(F.array_distinct(ways), home)).alias("w"))
        dealt = state.select(home.alias("w"), "i", "j", "z", "v", F.lit(True).alias("own")).unionByName(beside.withColumn("own", F.lit(False)))
        sorted_tiles = dealt.select("w.ti", "w.tj", "i", "j", "z", "v", "own").repartition("ti", "tj").sortWithinPartitions("ti", "tj")
        moved = cut(sorted_tiles.mapInPandas(run, "i int, j int, z double, v double, moved boolean"))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state.withColumnRenamed("v", value)


def _shifts(a: np.ndarray) -> Iterator[np.ndarray]:
    """What lies beside each place of the last two axes, in the order of D8; infinite beyond the sides."""
    wide = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1)] * 2, constant_values=np.inf)
    for di, dj, _, _ in D8:
        yield wide[..., 1 + di : wide.shape[-2] - 1 + di, 1 + dj : wide.shape[-1] - 1 + dj]


def fill(cells: DataFrame, eps: float = 1e-4, tile: int = TILE) -> DataFrame:
    """(i, j, z): pits raised so that every cell has a way down to the border, each step of it at least ``eps``.

    Border cells keep their height; all others start high and sink to max(z, lowest neighbour + eps) until nothing moves.
    A cell beside no data is no border cell, as water leaves only at the edge of the raster; cells that no way leads from
    keep their height.
    """
    box = cells.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1")).head()
    if box.i0 is None:
        return cells.select("i", "j", "z")
    border = F.col("i").isin(box.i0, box.i1) | F.col("j").isin(box.j0, box.j1)
    high = cells.select("i", "j", "z", F.when(border, F.col("z")).otherwise(F.lit(float("inf"))).alias("f"))
    sunk = _in_tiles(high, "f", lambda z, f: np.maximum(z, np.minimum.reduce(list(_shifts(f))) + eps), tile)
    return sunk.select("i", "j", F.when(F.col("f") == float("inf"), F.col("z")).otherwise(F.col("f")).alias("z"))


def resolve_flats(flows: DataFrame, tolerance: float = 0.05, tile: int = TILE) -> DataFrame:
    """``flows`` (i, j, z, code, down_i, down_j) whose cells without a way down flow to a neighbour not above them by more than ``tolerance``, on the shortest way to a cell that has one.

    Steps to such cells are counted over all flats at once; of neighbours one step nearer the first in the order of D8 is
    taken. Cells from which none can be reached (outlets, single cells) stay as they are.
    """
    start = flows.select("i", "j", "z", F.when(F.col("down_i").isNotNull(), 0.0).otherwise(F.lit(float("inf"))).alias("steps"))

    def nearer(z: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([np.where(z >= n - tolerance, s, np.inf) for n, s in zip(_shifts(z), _shifts(steps), strict=True)]) + 1

    told = cut(_in_tiles(start, "steps", nearer, tile))
    flat = told.where("steps > 0 and steps < double('inf')")
    near = _neighbours(told, "z", "steps").join(flat, ["i", "j"]).where((F.col("n_steps") == F.col("steps") - 1) & (F.col("z") >= F.col("n_z") - tolerance))
    way = near.groupBy("i", "j").agg(F.min(F.struct("k", "code", "down_i", "down_j")).alias("w"))
    joined = flows.join(way, ["i", "j"], "left")
    return joined.select("i", "j", "z", *[F.coalesce(f"w.{c}", c).alias(c) for c in ("code", "down_i", "down_j")])


def streams(acc: DataFrame, threshold: int) -> DataFrame:
    return acc.where(F.col("acc") >= threshold)


def hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    """(i, j, shade) from 0 to 1, from central differences (one-sided at edges and beside cells without data)."""
    row, column = Window.partitionBy("i").orderBy("j"), Window.partitionBy("j").orderBy("i")

    def gradient(over, at: str) -> Column:
        back = F.when(F.lag(at).over(over) == F.col(at) - 1, F.lag("z").over(over))
        ahead = F.when(F.lead(at).over(over) == F.col(at) + 1, F.lead("z").over(over))
        return F.coalesce((ahead - back) / 2, ahead - F.col("z"), F.col("z") - back, F.lit(0.0))

    rated = cells.withColumn("_dx", gradient(row, "j")).withColumn("_dy", gradient(column, "i"))
    slope, aspect = math.pi / 2 - F.atan(F.hypot("_dx", "_dy") * z_factor), F.atan2(-F.col("_dx"), "_dy")
    sun, high = math.radians(360 - azimuth + 90), math.radians(altitude)
    shade = F.sin(slope) * math.sin(high) + F.cos(slope) * math.cos(high) * F.cos(sun - aspect)
    return rated.select("i", "j", F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)).alias("shade"))


#: Levels of cells, each with a quarter of the width of the one before; the first is one cell.
LEVELS, FINER = 17, 4


def box_of(*places: DataFrame) -> tuple[float, float, float] | None:
    """Smallest x and y and the side (a little more than needed) of the square that holds all places (x, y); null if there is none. One row goes to the driver."""
    rows = places[0].select("x", "y")
    for more in places[1:]:
        rows = rows.unionByName(more.select("x", "y"))
    box = rows.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).head()
    return None if box.x0 is None else (box.x0, box.y0, max(box.x1 - box.x0, box.y1 - box.y0, 1e-9) * 1.000001)


def cell_at(value: Column, low: float, side: float, level: Column) -> Column:
    """The cell of a level that a coordinate lies in."""
    return F.floor((value - low) / side * F.pow(F.lit(float(FINER)), level)).cast("long")


def finest_level(points: DataFrame, occupied: DataFrame, box: tuple[float, float, float]) -> DataFrame:
    """``points`` (id, x, y) with the finest level at which their own cell is among the ``occupied`` ones (level, cx, cy)."""
    x0, y0, side = box
    each = points.select("id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    each = each.withColumns({"cx": cell_at(F.col("x"), x0, side, F.col("level")), "cy": cell_at(F.col("y"), y0, side, F.col("level"))})
    return each.join(shuffled(occupied), ["level", "cx", "cy"], "left_semi").groupBy("id").agg(F.max("level").alias("level"), F.first("x").alias("x"), F.first("y").alias("y"))


def cells_around(reach: int) -> Column:
    """The offsets of a cell and its neighbours up to ``reach`` cells away."""
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])


def nearest(points: DataFrame, targets: DataFrame, most: float | None = None) -> DataFrame:
    """(id, target, distance) of planar points (id, x, y) and targets (target, x, y); ties to the smaller target; none beyond ``most``.

    Cells of all levels are dealt out at once. A point takes the finest level at which its own cell holds a target: the
    nearest is then within the cell's diagonal, so it lies in the cells up to two away. Where targets are dense these cells
    are small, and one far target makes no others' cells wider. Nothing is broadcast; two joins do it, whatever the places.
    """
    box = box_of(points, targets)
    if box is None or targets.isEmpty():
        return points.limit(0).crossJoin(targets.select("target").limit(0)).select("id", "target", F.lit(0.0).alias("distance"))
    x0, y0, side = box
    targets = targets.groupBy("x", "y").agg(F.min("target").alias("target"))  # of targets at one place only the smallest can be taken
    sent = targets.select("target", F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
    sent = sent.withColumns({"cx": cell_at(F.col("tx"), x0, side, F.col("level")), "cy": cell_at(F.col("ty"), y0, side, F.col("level"))})
    found = finest_level(points, sent.select("level", "cx", "cy").distinct(), box)
    if most is not None:  # cells up to two away of this level hold all that lies within ``most``
        found = found.withColumn("level", F.greatest("level", F.lit(level_of(most, side))))
    at = found.select("id", "x", "y", "level", F.explode(cells_around(2)).alias("o"))
    at = at.select("id", "x", "y", "level", (cell_at(F.col("x"), x0, side, F.col("level")) + F.col("o.a")).alias("cx"), (cell_at(F.col("y"), y0, side, F.col("level")) + F.col("o.b")).alias("cy"))
    met = at.join(shuffled(sent), ["level", "cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")))
    best = met.groupBy("id").agg(F.min(F.struct("distance", "target")).alias("m")).select("id", "m.target", "m.distance")
    return cut(best if most is None else best.where(F.col("distance") <= most))


def level_of(reach: float, side: float) -> int:
    """The finest level whose cells are at least as wide as ``reach``."""
    return int(min(LEVELS - 1, max(0, math.floor(math.log(side / reach, FINER))))) if reach > 0 else LEVELS - 1


def thiessen_weights(assigned: DataFrame, zone: str, station: str) -> DataFrame:
    """(zone, station, cells, weight): each station's share of a zone's cells."""
    each = assigned.groupBy(zone, station).agg(F.count("*").alias("cells"))
    return each.withColumn("weight", F.col("cells") / F.sum("cells").over(Window.partitionBy(zone)))


def around(points: DataFrame, cells: DataFrame, value: str, reach: int) -> DataFrame:
    """(id, low, high): extremes of ``value`` over the cells within ``reach`` rows and columns of each point (id, i, j); null where none is."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    sent = points.select("id", "i", "j", F.explode(steps).alias("s")).select("id", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    return sent.join(shuffled(cells.select("i", "j", F.col(value).alias("_v"))), ["i", "j"], "left").groupBy("id").agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
