"""Uniform grids over the plane: what lies within a radius is found by equi-joins of cells.

A shape (a segment, or a polygon's edges) is rasterised into the cells that it comes within the
radius of, a point is in one cell, and both meet by (scope, level, cell). The cover is a superset
by construction, so callers measure exactly what meets. A shape that is long beside the radius is
covered at a coarser level, so it has a bounded number of cells; points are looked up at the levels
that occur, a few tens at most. No shape is met twice by a point: it has one level, the point one
cell of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motioncheck.functions.columns import distance
from motioncheck.sources.stored import stored

#: A shape is about so many cells across, at most; coordinates beyond EDGE share the outermost cells.
ACROSS, EDGE = 16, 1e15
#: Rows of a cover that is broadcast, at most: about 100 bytes each.
BROADCAST_ROWS = 100_000
CELL = ("level", "cx", "cy")


def finite(*columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(found, F.lit(False))


def index(x: Column, size: Column) -> Column:
    """The number of the cell that x is in. Clipping keeps what is near together."""
    return F.floor(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), x)) / size)


def level_of(extent: Column, size: float) -> Column:
    """The level at which something of this extent is ACROSS cells across or less; cells of level n are size * 2 ** n wide."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(size)) / (ACROSS * size)))).cast("int")


def width(size: float) -> Column:
    return F.lit(size) * F.pow(F.lit(2.0), F.col("level"))


def with_level(segments: DataFrame, radius: float, size: float) -> DataFrame:
    extent = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) + 2 * radius
    return segments.where(finite("ax", "ay", "bx", "by")).withColumn("level", level_of(extent, size))


def cover(segments: DataFrame, radius: float, size: float) -> DataFrame:
    """segments (ax, ay, bx, by, level) in each cell that they come within the radius of, row by row of cells."""
    s = width(size)
    # rounding of cuts grows with the coordinates
    pad = F.lit(radius) + 1e-9 * F.greatest(F.lit(radius), *(F.abs(c) for c in ("ax", "ay", "bx", "by")))
    rows = segments.withColumn("cy", F.explode(F.sequence(index(F.least("ay", "by") - pad, s), index(F.greatest("ay", "by") + pad, s))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    part = lambda y: F.when(dy == 0, None).otherwise((y - F.col("ay")) / F.nullif(dy, F.lit(0.0)))
    low, high = part(F.col("cy") * s - pad), part((F.col("cy") + 1) * s + pad)
    # what of the segment is beside this row; all of it where it runs along the row, or where the row is an outermost one
    whole = (dy == 0) | (F.abs(F.col("cy") * s) >= EDGE / 2)
    a = F.when(whole, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(low, high))))
    b = F.when(whole, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(low, high))))
    xs = (F.col("ax") + a * dx, F.col("ax") + b * dx)
    return rows.withColumn("cx", F.explode(F.sequence(index(F.least(*xs) - pad, s), index(F.greatest(*xs) + pad, s))))


def meet(points: DataFrame, covered: DataFrame, scope: tuple[str, ...], size: float) -> DataFrame:
    """points (x_m, y_m) with the rows of a cover in whose cells they are.

    A cover that all scenarios share is counted, and broadcast up to BROADCAST_ROWS; any other
    meets the points by a shuffle of both on the cell, which adaptive execution splits where a cell is hot.
    """
    levels = covered.agg(F.collect_set("level").alias("levels"))  # one row
    placed = points.where(finite("x_m", "y_m")).join(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels")
    placed = placed.withColumn("cx", index(F.col("x_m"), width(size))).withColumn("cy", index(F.col("y_m"), width(size)))
    return placed.join(sized(covered, scope), [*scope, *CELL]).drop(*CELL)


def sized(shapes: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """shapes with the hint of how to join them: broadcast if they are shared and BROADCAST_ROWS or fewer, by a shuffle if not."""
    small = not scope and shapes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return shapes.hint("broadcast" if small else "merge")


def near_segments(points: DataFrame, segments: DataFrame, scope: tuple[str, ...], radius: float) -> DataFrame:
    """points with all segments (and perhaps others) within the radius."""
    size = max(2 * radius, 1.0)
    return meet(points, cover(with_level(segments, radius, size), radius, size), scope, size)


def polygon_cells(edges: DataFrame, own: tuple[str, ...], radius: float, size: float, inside: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """(own, level, cx, cy, within) of closed polygons' cells: border cells, which an edge comes within the radius of, and cells inside, where no edge does.

    All points of a cell without an edge are on the same side as its centre; inside(points, keys) tells it: of
    rows (keys, x_m, y_m, edge) it makes (keys, inside).
    """
    box = edges.where(finite("ax", "ay", "bx", "by")).groupBy(*own).agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"))
    box = box.withColumn("level", level_of(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * radius, size))
    edges = edges.join(box.select(*own, "level"), list(own))
    border = cover(edges.where(finite("ax", "ay", "bx", "by")), radius, size).select(*own, *CELL).distinct()
    s = width(size)
    every = box.withColumn("cx", F.explode(F.sequence(index(F.col("x0"), s), index(F.col("x1"), s)))).withColumn("cy", F.explode(F.sequence(index(F.col("y0"), s), index(F.col("y1"), s))))
    rest = every.select(*own, *CELL).join(border, [*own, *CELL], "left_anti")
    centres = rest.withColumn("x_m", (F.col("cx") + 0.5) * s).withColumn("y_m", (F.col("cy") + 0.5) * s)
    held = inside(centres.join(edges.drop("level"), list(own)), (*own, *CELL)).where("inside").select(*own, *CELL)
    return border.withColumn("within", F.lit(False)).union(held.withColumn("within", F.lit(True)))


#: Cells are wider than the radius by more than rounding, so that a neighbour is never two cells away.
WIDER = 1 + 1e-6


def around(points: DataFrame, radius: float) -> DataFrame:
    """points (x_m, y_m) in their cell (cx, cy), as wide as the radius, and in the eight beside it."""
    here = lambda c: index(F.col(c), F.lit(radius * WIDER))
    at = lambda c: F.explode(F.sequence(here(c) - 1, here(c) + 1))
    return points.where(finite("x_m", "y_m")).withColumn("cx", at("x_m")).withColumn("cy", at("y_m"))


def neighbours(points: DataFrame, others: DataFrame, on: tuple[str, ...], radius: float) -> DataFrame:
    """Pairs of points (x_m, y_m) and others (ox, oy) of equal `on` within the radius, with separation_m: an epsilon-grid join.

    Only what is in neighbouring cells meets; each pair meets once.
    """
    here = lambda c: index(F.col(c), F.lit(radius * WIDER))
    placed = others.where(finite("ox", "oy")).withColumn("cx", here("ox")).withColumn("cy", here("oy"))
    both = around(points, radius).join(placed, [*on, "cx", "cy"]).drop("cx", "cy")
    return both.withColumn("separation_m", distance(F.col("x_m"), F.col("y_m"), F.col("ox"), F.col("oy"))).where(F.col("separation_m") <= radius)


#: Where so many or fewer are at an instant, all of them are met; the first radius where there are more, and its growth.
FEW, FIRST_RADIUS, GROWTH = 64, 4.0, 4.0


def least_separation(points: DataFrame, others: DataFrame, on: tuple[str, ...], key: tuple[str, ...], differ: Column, few: int = FEW) -> DataFrame:
    """(key, separation_m): the least separation of a key's points from any of the others at the same `on` for which `differ` holds.

    Crowded instants are searched by a radius that grows until a key has a partner within it: that is its
    nearest then. So pairs follow the density within the radius, not the square of the crowd. Keys without any partner have no row.
    """
    held = others.groupBy(*on).agg(F.count("*").alias("n"))
    crowded = held.where(F.col("n") > few).select(*on)
    apart = distance(F.col("x_m"), F.col("y_m"), F.col("ox"), F.col("oy"))
    least = lambda pairs: pairs.where(differ).groupBy(*key).agg(F.min("separation_m").alias("separation_m"))
    some = bool(crowded.take(1))
    sparse = others.join(crowded, list(on), "left_anti") if some else others
    found = least(points.join(sparse, list(on)).withColumn("separation_m", apart))
    if not some:
        return found
    # beyond this radius all are met
    ends = others.where(finite("ox", "oy")).agg(F.max("ox") - F.min("ox"), F.max("oy") - F.min("oy")).first()
    mine = points.where(finite("x_m", "y_m")).agg(F.max(F.abs("x_m")), F.max(F.abs("y_m"))).first()
    theirs = others.where(finite("ox", "oy")).agg(F.max(F.abs("ox")), F.max(F.abs("oy"))).first()
    far = sum(x or 0.0 for x in (*ends, *mine, *theirs)) + FIRST_RADIUS
    dense = stored(others.join(crowded, list(on), "left_semi"))
    done = stored(found)
    rest, radius, parts = points.join(crowded, list(on), "left_semi"), FIRST_RADIUS, [done]
    # what has a partner elsewhere that is nearer than the radius needs no more search
    while True:
        near = stored(least(neighbours(rest, dense, on, radius)))
        parts.append(near)
        settled = near.select(*key).union(done.where(F.col("separation_m") <= radius).select(*key)).distinct()
        rest = stored(rest.join(settled, list(key), "left_anti"))
        if radius > far or not rest.take(1):
            break
        radius *= GROWTH
    # points or others without a finite place meet as before: what is left is theirs, or has no partner
    odd = dense.where(~finite("ox", "oy")), rest.where(~finite("x_m", "y_m"))
    parts += [least(rest.join(odd[0], list(on)).withColumn("separation_m", apart)), least(odd[1].join(dense, list(on)).withColumn("separation_m", apart))]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return every.groupBy(*key).agg(F.min("separation_m").alias("separation_m"))
