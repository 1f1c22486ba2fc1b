"""Fewer vertices: lines within a tolerance, outlines within a number of points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.operators.lineage import cut

#: Stretches of at most so many inner vertices are settled by one task each.
AT_ONCE = 100_000
#: So many tables are united at most before they are written as one.
UNITED = 16


def simplify(lines: DataFrame, tolerance: float, at_once: int = AT_ONCE) -> DataFrame:
    """(edge, k, x, y): the vertices that Douglas and Peucker's rule keeps, with their old k.

    The ends stay. In every open stretch between kept vertices the vertex farthest from the chord is kept if it lies
    farther than ``tolerance`` (ties: the smaller k), which makes two stretches; else the stretch is done. All stretches
    with more than ``at_once`` vertices between their ends take a step at once, and the farthest are found by combining
    maxima, so a long line is no task's. The others are settled where they lie, so only splits of long stretches take
    rounds. Lines of one vertex stay; vertices with a null are none.
    """
    rows = lines.select("edge", "k", "x", "y").where("k is not null and x is not null and y is not null")
    vertex = F.struct("k", "x", "y")
    ends = cut(rows.groupBy("edge").agg(F.min_by(vertex, "k").alias("a"), F.max_by(vertex, "k").alias("b"), F.count("*").alias("n")))
    kept = [ends.select("edge", F.explode(F.array_distinct(F.array("a", "b"))).alias("v")).select("edge", "v.*")]
    within = lambda found: rows.join(found.drop("n"), "edge").where("k > a.k and k < b.k")
    long = F.col("n") > at_once + 2
    short, left = [within(ends.where(~long))], ends.where(long)
    left = None if left.isEmpty() else cut(within(left))
    bounds, long = ["edge", "low", "high"], F.col("n") > at_once
    while left is not None and not left.isEmpty():
        left = left.withColumns({"low": F.col("a.k"), "high": F.col("b.k")})
        far = left.groupBy(*bounds).agg(F.count("*").alias("n"), F.max(F.struct(_away().alias("d"), (-F.col("k")).alias("less"), "x", "y")).alias("m"))
        far = cut(far.select(*bounds, "n", F.col("m.d").alias("d"), F.struct((-F.col("m.less")).alias("k"), "m.x", "m.y").alias("m")).where(~long | (F.col("d") > tolerance)))
        kept.append(far.where(long).select("edge", "m.k", "m.x", "m.y"))
        joined = cut(left.join(far, bounds))
        short.append(joined.where(~long).select("edge", "k", "x", "y", "a", "b"))
        before = F.col("k") < F.col("m.k")
        left = joined.where(long & (F.col("k") != F.col("m.k"))).select("edge", "k", "x", "y", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b"))
        kept, short = ([cut(_united(parts))] if len(parts) == UNITED else parts for parts in (kept, short))
    return _united(kept).unionByName(_settled(_united(short), tolerance))


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _away():
    """How far a vertex (x, y) lies from the chord from a to b."""
    rx, ry, px, py = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    u = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(px * rx + py * ry, rx * rx + ry * ry))), F.lit(0.0))
    dx, dy = px - u * rx, py - u * ry
    return F.sqrt(dx * dx + dy * dy)


def _away_of(x: np.ndarray, y: np.ndarray, ax: float, ay: float, bx: float, by: float) -> np.ndarray:
    """``_away`` of many vertices, to the last bit."""
    rx, ry, px, py = bx - ax, by - ay, x - ax, y - ay
    length = rx * rx + ry * ry
    u = np.fmin(1.0, np.maximum(0.0, (px * rx + py * ry) / length)) if length != 0 else 0.0
    dx, dy = px - u * rx, py - u * ry
    return np.sqrt(dx * dx + dy * dy)


def _settled(short: DataFrame, tolerance: float) -> DataFrame:
    """(edge, k, x, y): the vertices kept of stretches that ``short`` (edge, k, x, y, a, b) has the inner vertices of. Tasks read them in order and hold one stretch and a batch at a time."""
    names = ["edge", "k", "x", "y"]
    number = F.row_number().over(Window.partitionBy("edge", "low").orderBy("k", F.desc("x"), F.desc("y")))
    flat = short.select(*names, F.col("a.k").alias("low"), *[F.col(f"{end}.{c}").cast("double").alias(f"{end}{c}") for end in "ab" for c in "xy"])
    flat = flat.select(*names, "ax", "ay", "bx", "by", (number == 1).alias("first"))

    def kept(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        keep = np.zeros(len(rows), bool)
        k = rows["k"].to_numpy()
        x, y, *chord = (rows[c].cast(pa.float64()).to_numpy() for c in ("x", "y", "ax", "ay", "bx", "by"))
        open_ = [(i, j, *(c[i] for c in chord)) for i, j in zip(starts, [*starts[1:], len(rows)], strict=True)]
        with np.errstate(all="ignore"):
            while open_:
                i, j, ax, ay, bx, by = open_.pop()
                away = _away_of(x[i:j], y[i:j], ax, ay, bx, by)
                at = i + int(away.argmax())
                if away[at - i] <= tolerance:
                    continue
                keep[at] = True
                low, high = at, at + 1
                while low > i and k[low - 1] == k[at]:
                    low -= 1
                while high < j and k[high] == k[at]:
                    high += 1
                if i < low:
                    open_.append((i, low, ax, ay, x[at], y[at]))
                if high < j:
                    open_.append((high, j, x[at], y[at], bx, by))
        return rows.select(names).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            starts = np.flatnonzero(rows["first"].to_numpy())
            held = rows.slice(starts[-1]) if len(starts) else None
            if len(starts) > 1:
                yield from kept(rows.slice(0, starts[-1]), starts[:-1]).to_batches()
        if held is not None:
            yield from kept(held, np.array([0])).to_batches()

    return flat.mapInArrow(run, short.select(names).schema)


def renumbered(lines: DataFrame) -> DataFrame:
    """``lines`` with k from 0 without gaps."""
    return lines.withColumn("k", F.row_number().over(Window.partitionBy("edge").orderBy("k")) - 1)


def thin_outlines(outlines: DataFrame, tolerance: float, most: int = 40) -> DataFrame:
    """Closed outlines (edge, k, x, y; the last vertex is the first) simplified and, if more than ``most`` vertices are left, thinned by a stride; still closed."""
    found = renumbered(simplify(outlines, tolerance))
    n = found.groupBy("edge").agg(F.count("*").alias("n"))
    stride = F.when(F.col("n") > most, F.ceil((F.col("n") - 1) / (most - 1))).otherwise(1)
    return renumbered(found.join(n, "edge").where((F.col("k") % stride == 0) | (F.col("k") == F.col("n") - 1)).select("edge", "k", "x", "y"))
