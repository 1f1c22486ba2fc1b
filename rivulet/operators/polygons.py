"""Zones of a raster as polygons: boundary sides, rings in order, holes and their outlines.

The cell (i, j) lies between the corners (i, j) and (i + 1, j + 1). A zone's sides run with the zone to their right (rows
grow downwards), so outlines and holes turn in opposite ways and their areas have opposite signs. Cells that only share a
corner are not connected: a ring that comes to such a corner stays with its cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import network
from rivulet.operators.lineage import cut

#: The sides of a cell clockwise from the top: where each begins, and its direction (0 right, 1 down, 2 left, 3 up).
_STARTS = ((0, 0), (0, 1), (1, 1), (1, 0))
_STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def _by_direction(values: tuple[int, ...], d: str = "d") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(d) + 1)


def sides(cells: DataFrame) -> DataFrame:
    """(label, id, i, j, d): the directed sides of zones (label, i, j) that no cell of the zone lies beyond; ``id`` numbers corner and direction.

    A side between two cells of a zone comes up once from each, so counting tells the boundary. A cell has one label;
    cells with a null take no part.
    """
    rows = cells.select("label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("label is not null and i is not null and j is not null").distinct()
    each = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), F.lit(d).alias("d")) for d, (a, b) in enumerate(_STARTS)])
    found = rows.select("label", F.explode(each).alias("s")).select("label", "s.*")
    # a horizontal or vertical place, whatever the direction
    place = [F.when(F.col("d") == 2, F.col("j") - 1).otherwise(F.col("j")).alias("pj"), F.when(F.col("d") == 3, F.col("i") - 1).otherwise(F.col("i")).alias("pi"), (F.col("d") % 2).alias("upright")]
    alone = found.groupBy("label", *place).agg(F.count("*").alias("n"), F.first("i").alias("i"), F.first("j").alias("j"), F.first("d").alias("d")).where("n = 1")
    return alone.select("label", side_id("i", "j", "d").alias("id"), "i", "j", "d")


def side_id(i: str, j: str, d: str) -> Column:
    return F.shiftleft(F.col(i), 33) + F.shiftleft(F.col(j), 2) + F.col(d)


def _linked(found: DataFrame) -> DataFrame:
    """``found`` with the side that follows each: at a corner of two zones' cells the one that turns right."""
    ends = found.withColumns({"ei": F.col("i") + _by_direction(tuple(a for a, _ in _STEPS)), "ej": F.col("j") + _by_direction(tuple(b for _, b in _STEPS))})
    after = found.select("label", F.col("i").alias("ei"), F.col("j").alias("ej"), F.col("d").alias("d2"), F.col("id").alias("id2"))
    turn = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(9), F.lit(2)), F.pmod(F.col("d2") - F.col("d"), F.lit(4)) + 1)
    nearest = ends.join(after, ["label", "ei", "ej"]).groupBy("label", "id", "i", "j", "d").agg(F.min(F.struct(turn.alias("turn"), "id2", "d2")).alias("m"))
    return nearest.select("label", "id", "i", "j", "d", F.col("m.id2").alias("next"))


def rings(cells: DataFrame) -> DataFrame:
    """(label, ring, k, i, j) of the corners at which the rings of zones (label, i, j) turn, k from 0; a ring is named by its smallest side.

    Sides find the smallest of their ring by doubling the reach of their links, and their places by list ranking, so the
    number of joins is the logarithm of the longest ring.
    """
    found = cut(_linked(sides(cells)))
    at = found.select("id", F.col("next").alias("to"), F.least("id", "next").alias("ring"))
    while True:
        beyond = at.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("ring").alias("more"))
        moved = cut(at.join(beyond, "to").select("id", F.col("far").alias("to"), F.least("ring", "more").alias("ring"), F.col("ring").alias("before")))
        at = moved.select("id", "to", "ring")
        if moved.where("ring != before").isEmpty():
            break
    named = cut(found.join(at.select("id", "ring"), "id"))
    back = network.levels(named.select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("parent")))
    sizes = named.groupBy("ring").agg(F.count("*").alias("n"))
    before = found.select(F.col("next").alias("id"), F.col("d").alias("came"))
    placed = named.join(back, "id").join(sizes, "ring").join(before, "id").where("d != came")
    corner = placed.select("label", "ring", (F.col("n") - 1 - F.col("level")).alias("place"), "i", "j")
    order = Window.partitionBy("ring").orderBy("place")
    return corner.select("label", "ring", (F.row_number().over(order) - 1).alias("k"), "i", "j")


def ring_areas(corners: DataFrame) -> DataFrame:
    """(label, ring, n, area, hole): corners of each ring, what it encloses in cells (negative for holes)."""
    order = Window.partitionBy("ring").orderBy("k")
    first = F.struct(F.first("i").over(order).alias("i"), F.first("j").over(order).alias("j"))
    after = F.coalesce(F.lead(F.struct("i", "j")).over(order), first)
    parts = corners.select("label", "ring", (F.col("j") * after["i"] - after["j"] * F.col("i")).alias("twice"))
    found = parts.groupBy("label", "ring").agg(F.count("*").alias("n"), (F.sum("twice") / 2).alias("area"))
    return found.withColumn("hole", F.col("area") < 0)


def polygons(cells: DataFrame, corners: DataFrame) -> DataFrame:
    """(label, ring, polygon, area, hole): each ring with the outline that it belongs to.

    To the left of a hole's first corner lies a run of the zone's cells; the upright side where the run begins is the
    outline's or that of another hole of the same polygon, and pointers lead on from there.
    """
    areas = cut(ring_areas(corners))
    named = _upright(corners)
    # the hole's upper side at its smallest corner: the run of cells left of it ends there
    starts = corners.join(areas.where("hole").select("ring"), "ring", "left_semi").groupBy("label", "ring").agg(F.min(F.struct("i", "j")).alias("m"))
    asked = starts.select("label", "ring", "m.i", "m.j", F.lit(True).alias("asks"))
    rows = named.select("label", "ring", "i", "j", F.lit(False).alias("asks")).unionByName(asked)
    left = Window.partitionBy("label", "i").orderBy("j", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("to", F.last(F.when(~F.col("asks"), F.col("ring")), ignorenulls=True).over(left)).where("asks")
    forest = areas.join(seen.select("ring", "to"), "ring", "left").select(F.col("ring").alias("id"), F.col("to").alias("parent"), (~F.col("hole")).alias("outline"))
    found = network.first_marked(forest, "outline")
    return areas.join(found.select(F.col("id").alias("ring"), F.col("mark").alias("polygon")), "ring").select("label", "ring", "polygon", "area", "hole")


def _upright(corners: DataFrame) -> DataFrame:
    """(label, ring, i, j): the rings' upright sides, one for each row of cells that they pass."""
    order = Window.partitionBy("ring").orderBy("k")
    after = F.coalesce(F.lead(F.struct("i", "j")).over(order), F.struct(F.first("i").over(order).alias("i"), F.first("j").over(order).alias("j")))
    lines = corners.select("label", "ring", "j", F.col("i").alias("a"), after["i"].alias("b"), after["j"].alias("bj")).where("j = bj and a != b")
    return lines.select("label", "ring", F.explode(F.sequence(F.least("a", "b"), F.greatest("a", "b") - 1)).alias("i"), "j")


def outlines(cells: DataFrame, xll: float, yll: float, cellsize: float, n_rows: int) -> DataFrame:
    """(label, k, x, y): the closed outline of each zone's largest polygon (holes taken off; ties go to the smaller ring), in the raster's coordinates."""
    corners = cut(rings(cells))
    found = polygons(cells, corners)
    best = found.groupBy("label", "polygon").agg(F.sum("area").alias("area")).groupBy("label").agg(F.max_by("polygon", F.struct("area", -F.col("polygon"))).alias("ring"))
    kept = corners.join(best.select("ring"), "ring", "left_semi")
    n = kept.groupBy("ring").agg(F.count("*").alias("n"))
    closed = kept.join(n, "ring").withColumn("k", F.explode(F.when(F.col("k") == 0, F.array(F.lit(0), F.col("n").cast("int"))).otherwise(F.array(F.col("k").cast("int")))))
    return closed.select("label", "k", (F.col("j") * cellsize + xll).alias("x"), ((n_rows - F.col("i")) * cellsize + yll).alias("y"))
