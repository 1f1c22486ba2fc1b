"""Channels of a raster as lines: reaches between sources, confluences and ends, and their smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators import attach, grid, network, simplify
from rivulet.operators.lineage import cut


def reach_cells(flows: DataFrame, acc: DataFrame, threshold: int) -> DataFrame:
    """(reach, k, i, j, z, acc) of the cells of each reach, k from 0 downstream.

    A reach begins at a channel cell (acc of ``threshold`` or more) that none or several channel cells drain to, that lies
    on the border of the raster or that drains to no channel cell; its last cell is the first of the next reach. A reach
    is named by its first cell; one of a single cell is none. Other cells have one channel cell above, so pointers up
    the channels find their reach, and ``acc``, which grows downstream, their order.
    """
    cells = grid.streams(flows.join(acc, ["i", "j"]), threshold)
    cells = cells.select("i", "j", "z", "acc", grid.cell_id().alias("id"), grid.cell_id("down_i", "down_j").alias("down"))
    box = flows.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))  # one row
    above = cells.groupBy(F.col("down").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("up"))
    below = cells.select(F.col("id").alias("down"), F.lit(True).alias("goes_on"))
    known = cells.join(above, "id", "left").join(below, "down", "left").join(F.broadcast(box))
    border = F.col("i").isin(F.col("i0"), F.col("i1")) | F.col("j").isin(F.col("j0"), F.col("j1"))
    first = (F.coalesce("n", F.lit(0)) != 1) | F.col("goes_on").isNull() | border
    known = cut(known.select("i", "j", "z", "acc", "id", F.when(F.col("goes_on"), F.col("down")).alias("down"), "up", first.alias("first")))
    reaches = network.first_marked(known.select("id", F.when(~F.col("first"), F.col("up")).alias("parent"), "first"), "first").withColumnRenamed("mark", "reach")
    named = cut(known.join(reaches, "id"))
    last = named.select("reach", F.col("down").alias("id")).join(known.where("first").select("id", "i", "j", "z", "acc"), "id").select("reach", "i", "j", "z", "acc")
    whole = named.select("reach", "i", "j", "z", "acc").unionByName(last)
    mine = Window.partitionBy("reach")
    placed = whole.withColumn("k", F.row_number().over(mine.orderBy("acc")) - 1).withColumn("_n", F.count("*").over(mine))
    return placed.where("_n > 1").select("reach", "k", "i", "j", "z", "acc")


def reaches(cells: DataFrame) -> DataFrame:
    """(reach, n_cells, length, z_mean, acc, below) of each reach's cells: steps in cells, what its last cell drains, and the reach that begins there (null if none)."""
    ahead = Window.partitionBy("reach").orderBy("k")
    step = F.hypot(F.lead("i").over(ahead) - F.col("i"), F.lead("j").over(ahead) - F.col("j"))
    each = cells.withColumn("_step", step).groupBy("reach").agg(
        F.count("*").alias("n_cells"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"), F.avg("z").alias("z_mean"), F.max("acc").alias("acc"), F.max_by(grid.cell_id(), "k").alias("_end")
    )
    starts = each.select(F.col("reach").alias("_end"), F.col("reach").alias("below"))
    return each.join(starts, "_end", "left").select("reach", "n_cells", "length", "z_mean", "acc", "below")


def reach_lines(cells: DataFrame, xll: float, yll: float, cellsize: float, n_rows: int, tolerance: float = 0.0, rounds: int = 0, least_length: float = 0.0) -> DataFrame:
    """(reach, k, x, y) of the lines through the middles of each reach's cells, in the raster's coordinates.

    Reaches of more than four cells are simplified to ``tolerance``, lines of three vertices at least have their corners cut in
    ``rounds``, and lines shorter than ``least_length`` go.
    """
    at = cells.select(F.col("reach").alias("edge"), F.col("k").cast("long").alias("k"), ((F.col("j") + 0.5) * cellsize + xll).alias("x"), ((n_rows - F.col("i") - 0.5) * cellsize + yll).alias("y"))
    if tolerance > 0:
        n = at.groupBy("edge").agg(F.count("*").alias("_n"))
        sized = cut(at.join(n, "edge"))
        long = simplify.simplify(sized.where("_n > 4"), tolerance)
        at = simplify.renumbered(sized.where("_n <= 4").drop("_n").unionByName(long))
    if rounds:
        at = smooth(at, rounds)
    if least_length > 0:
        total = attach.segments(at).groupBy("edge").agg(F.sum("length").alias("_l")).where(F.col("_l") >= least_length)
        at = at.join(total, "edge", "left_semi")
    return at.select(F.col("edge").alias("reach"), "k", "x", "y")


def reach_orders(found: DataFrame) -> DataFrame:
    """(reach, stream_order): 1 at sources; one more than the reaches above if these are all equal, else the largest of theirs."""
    return network.orders(found.select(F.col("reach").alias("id"), F.col("below").alias("parent")), strict=False).withColumnRenamed("id", "reach")


def smooth(lines: DataFrame, rounds: int = 2) -> DataFrame:
    """``lines`` (edge, k, x, y) with their corners cut: each side keeps its points at a quarter and at three quarters. Ends stay, and so do lines of two points."""
    for _ in range(rounds):
        order = Window.partitionBy("edge").orderBy("k")
        seen = lines.select("edge", "k", "x", "y", F.lead("x").over(order).alias("bx"), F.lead("y").over(order).alias("by"), F.lag("k").over(order).isNull().alias("first"), F.count("*").over(Window.partitionBy("edge")).alias("n"))
        point = lambda k, x, y: F.struct(F.lit(k).alias("part"), x.alias("x"), y.alias("y"))
        between = lambda share: ((F.col(c) * (1 - share) + F.col(f"b{c}") * share) for c in "xy")
        own = point(0, F.col("x"), F.col("y"))
        sides = F.array(point(1, *between(0.25)), point(2, *between(0.75)))
        made = F.when((F.col("n") < 3) | F.col("bx").isNull(), F.array(own)).when(F.col("first"), F.concat(F.array(own), sides)).otherwise(sides)
        parts = seen.select("edge", "k", F.explode(made).alias("p"))
        lines = parts.select("edge", (F.row_number().over(Window.partitionBy("edge").orderBy("k", "p.part")) - 1).alias("k"), "p.x", "p.y")
    return lines
