"""Points and lines: which line a point lies nearest to, and where on it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import grid
from rivulet.operators.lineage import cut, shuffled


def segments(lines: DataFrame) -> DataFrame:
    """(edge, k, ax, ay, bx, by, length, before, total) of lines given by their vertices (edge, k, x, y): what lies before each segment and the whole line's length."""
    order = Window.partitionBy("edge").orderBy("k")
    ends = lines.select("edge", "k", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by")).where("bx is not null")
    ends = ends.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    return ends.withColumns({"before": F.sum("length").over(order) - F.col("length"), "total": F.sum("length").over(Window.partitionBy("edge"))})


#: Cells that a segment's longer side passes at most at its finest level, among segments, and where points look for segments.
PASSED, PASSED_MOST = 8, 64


def passed(rows: DataFrame, width: Column, reach: float = 0.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """``rows`` (ax, ay, bx, by) once for each cell (cx, cy) of a grid that their segment passes, widened by ``reach``: in each column the cells between where it enters and leaves."""
    ax, ay, bx, by = F.col("ax") - x0, F.col("ay") - y0, F.col("bx") - x0, F.col("by") - y0
    cell = lambda v: F.floor(v / width).cast("long")
    found = rows.withColumn("cx", F.explode(F.sequence(cell(F.least(ax, bx) - reach), cell(F.greatest(ax, bx) + reach))))
    low, high = F.col("cx") * width - reach, (F.col("cx") + 1) * width + reach
    rise = F.coalesce(F.try_divide(by - ay, bx - ax), F.lit(0.0))
    at = lambda x: ay + (F.least(F.greatest(x, F.least(ax, bx)), F.greatest(ax, bx)) - ax) * rise
    inside = lambda f: F.when(ax == bx, f(ay, by)).otherwise(f(at(low), at(high)))
    hair = (F.abs(ay) + F.abs(by)) * 1e-12 + reach  # rounding of the entry must not lose a cell
    return found.withColumn("cy", F.explode(F.sequence(cell(inside(F.least) - hair), cell(inside(F.greatest) + hair))))


def nearest_edge(points: DataFrame, lines: DataFrame, most: float | None = None) -> DataFrame:
    """(id, edge, distance, ratio) of planar points (id, x, y) and lines (edge, k, x, y): the nearest line, the distance to it and the place on it as a share of its length.

    Ties go to the smaller edge and its earlier segment; none beyond ``most``. A vertex in the point's own cell, at the
    finest level where one is, bounds the distance, so the nearest segment passes a cell that the circle with this radius
    touches. A segment is dealt to the cells it passes, at levels down to the finest at which these are few. A point meets those
    of the level as wide as its circle and, at their own levels, the longer segments, whose finest level is wider. Neither
    an outlier nor a long segment makes the others' cells wider. Pairs are gone through twice, for the least distance and
    for the segment that has it: the first is a plain sum of maps, so pairs are never sorted or spilled.
    """
    parts = cut(segments(lines))
    box = grid.box_of(points, lines)
    if box is None or parts.isEmpty():
        return points.limit(0).crossJoin(lines.select("edge").limit(0)).select("id", "edge", F.lit(0.0).alias("distance"), F.lit(0.0).alias("ratio"))
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    at = cut(_with_reach(points, parts, box, most))
    meeting = within_reach(at, parts, box)
    if meeting is None:
        return points.limit(0).crossJoin(lines.select("edge").limit(0)).select("id", "edge", F.lit(0.0).alias("distance"), F.lit(0.0).alias("ratio"))
    asked, paired = meeting

    def met(asked: DataFrame) -> DataFrame:
        pairs = paired(asked)
        along = F.try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), F.col("length") * F.col("length"))
        pairs = pairs.withColumn("u", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0)))
        return pairs.withColumn("distance", F.hypot(x - ax - F.col("u") * (bx - ax), y - ay - F.col("u") * (by - ay)))

    least = cut(met(asked).groupBy("id").agg(F.min("distance").alias("least")))
    place = F.coalesce(F.try_divide(F.col("before") + F.col("u") * F.col("length"), F.col("total")), F.lit(0.0))
    best = met(asked.join(shuffled(least), "id")).where(F.col("distance") <= F.col("least"))
    best = best.groupBy("id").agg(F.min(F.struct("distance", "edge", "k", place.alias("ratio"))).alias("m")).select("id", "m.edge", "m.distance", "m.ratio")
    return cut(best if most is None else best.where(F.col("distance") <= most))


def within_reach(at: DataFrame, parts: DataFrame, box: tuple[float, float, float], same: tuple[str, ...] = (), most_passed: int = PASSED_MOST) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]] | None:
    """The points ``at`` (x, y, r, level, more) by the cells that their circles touch, and what pairs such rows with the segments passing these cells, of equal ``same`` only; null without points.

    All segments within r of a point are among its pairs, each at least once. Segments pass ``most_passed`` cells or so at their finest level.
    """
    x0, y0, side = box
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    used = sorted(r.level for r in at.select("level").distinct().collect())  # levels, few
    if not used:
        return None
    longer = F.greatest(F.abs(bx - ax), F.abs(by - ay), F.lit(side * float(grid.FINER) ** (1 - grid.LEVELS)))
    finest = F.least(F.lit(grid.LEVELS - 1), F.greatest(F.lit(0), F.floor(F.log(F.lit(side * most_passed) / longer) / math.log(grid.FINER)).cast("int")))
    own_levels = F.filter(F.array(*[F.lit(k) for k in used]), lambda k: k <= F.col("finest"))
    dealt = parts.withColumn("finest", finest).withColumn("level", F.explode(F.array_union(own_levels, F.when(F.col("finest") < used[-1], F.array("finest")).otherwise(F.array().cast("array<int>")))))
    dealt = cut(passed(dealt, F.lit(side) / F.pow(F.lit(float(grid.FINER)), F.col("level")), 0.0, x0, y0))
    kinds = sorted(r.finest for r in dealt.select("finest").distinct().collect())  # levels, few
    levels = F.array_union(F.array("level"), F.filter(F.array(*[F.lit(k) for k in kinds]), lambda k: k < F.col("level")))
    asked = at.select(*[c for c in at.columns if c != "level"], F.col("level").alias("mine"), F.explode(levels).alias("level"))
    reached = lambda v, low: F.sequence(grid.cell_at(v - F.col("r"), low, side, F.col("level")), grid.cell_at(v + F.col("r"), low, side, F.col("level")))
    asked = asked.withColumn("cx", F.explode(reached(x, x0))).withColumn("cy", F.explode(reached(y, y0)))
    return asked, lambda rows: rows.join(shuffled(dealt), [*same, "level", "cx", "cy"]).where("mine = level or finest = level")


def level_within(r: Column, side: float) -> Column:
    """The finest level whose cells are as wide as ``r``, above 0."""
    return F.least(F.lit(grid.LEVELS - 1), F.greatest(F.lit(0), F.floor(F.log(F.lit(side) / r) / math.log(grid.FINER)).cast("int")))


def _with_reach(points: DataFrame, parts: DataFrame, box: tuple[float, float, float], most: float | None) -> DataFrame:
    """(id, x, y, r, level): how far each point has to look, as some vertex is no farther, and the finest level whose cells are as wide."""
    x0, y0, side = box
    vertices = parts.select(F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("v")).select("v.*").distinct()
    levels = F.explode(F.sequence(F.lit(0), F.lit(grid.LEVELS - 1)))
    in_cell = lambda rows: rows.withColumn("level", levels).withColumns({c: grid.cell_at(F.col(v), low, side, F.col("level")) for c, v, low in (("cx", "x", x0), ("cy", "y", y0))})
    some = in_cell(vertices).groupBy("level", "cx", "cy").agg(F.max("x").alias("vx"), F.max("y").alias("vy"), F.min("x").alias("wx"), F.min("y").alias("wy"))
    # some vertex of the cell lies in the rectangle of all of them, so none of its corners is nearer than the nearest and none of its points farther than the farthest corner
    far = F.hypot(F.greatest(F.col("vx") - F.col("x"), F.col("x") - F.col("wx")), F.greatest(F.col("vy") - F.col("y"), F.col("y") - F.col("wy")))
    found = in_cell(points.select("id", "x", "y")).join(shuffled(some), ["level", "cx", "cy"])
    found = found.groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min(far).alias("r"))
    r = F.col("r") if most is None else F.least("r", F.lit(float(most)))
    found = found.withColumn("r", r * (1 + 1e-9) + side * 1e-12)
    return found.withColumn("level", level_within(F.col("r"), side))


def extent(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x_min, y_min, x_max, y_max) of vertices (by..., x, y)."""
    return lines.groupBy(*by).agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def centroids(vertices: DataFrame, key: str) -> DataFrame:
    """(key, x, y) of polygons given by closed rings (key, part, ring, k, x, y): the middle of their area, rings after a part's first being holes whatever way they turn. Polygons without area have none."""
    order = Window.partitionBy(key, "part", "ring").orderBy("k")
    x, y, nx, ny = F.col("x"), F.col("y"), F.lead("x").over(order), F.lead("y").over(order)
    sides = vertices.select(key, "part", "ring", (x * ny - nx * y).alias("c"), ((x + nx) * (x * ny - nx * y)).alias("sx"), ((y + ny) * (x * ny - nx * y)).alias("sy")).where("c is not null")
    rings = sides.groupBy(key, "part", "ring").agg(F.sum("c").alias("c"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    way = F.signum("c") * F.when(F.col("ring") == 0, 1).otherwise(-1)
    whole = rings.groupBy(key).agg(*[F.sum(F.col(n) * way).alias(n) for n in ("c", "sx", "sy")]).where("c > 0")
    return whole.select(key, (F.col("sx") / (3 * F.col("c"))).alias("x"), (F.col("sy") / (3 * F.col("c"))).alias("y"))


def lakes_to_edges(vertices: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, edge, distance, ratio): the line nearest to the centroid of each lake (id, part, ring, k, x, y), however far."""
    return nearest_edge(centroids(vertices, "id"), lines)
