"""Masks over cells: quotable zones, valley edges, dilation and erosion, half planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodspark import fixed, grid


def near_l1(cells: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """The rows of ``cells`` within ``radius`` cross-shaped steps of a seed cell, with the steps ``l1``.

    Two passes whatever the radius: down the columns that hold a seed, each row the grid has gets its steps to the
    nearest seed; along the rows the running minimum of those steps plus the columns between is the distance.  Gaps in
    either table do not matter.
    """
    marks = seeds.select(*grid.CELL).distinct()
    rows = cells.select("run_id", "r").distinct().join(marks.select("run_id", "c").distinct(), "run_id")
    lanes = rows.select(*grid.CELL, F.lit(None).cast("int").alias("s")).unionByName(marks.withColumn("s", F.col("r")))
    w = Window.partitionBy("run_id", "c").orderBy("r")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    above = F.last("s", True).over(w.rangeBetween(start, 0))
    below = F.first("s", True).over(w.rangeBetween(0, end))
    lanes = lanes.withColumn("d", F.least(F.col("r") - above, below - F.col("r"))).where("s IS NULL").where(F.col("d") <= radius)
    here = cells.select(*grid.CELL, F.lit(None).cast("int").alias("d"))
    here = here.join(lanes.select("run_id", "r").distinct(), ["run_id", "r"], "left_semi")
    both = here.withColumn("cell", F.lit(True)).unionByName(lanes.select(*grid.CELL, "d").withColumn("cell", F.lit(False)))
    w = Window.partitionBy("run_id", "r").orderBy("c")
    west = F.min(F.col("d") - F.col("c")).over(w.rangeBetween(start, 0)) + F.col("c")
    east = F.min(F.col("d") + F.col("c")).over(w.rangeBetween(0, end)) - F.col("c")
    return both.withColumn("l1", F.least(west, east)).where(F.col("cell") & (F.col("l1") <= radius)).select(*grid.CELL, "l1")


def dilate(mask_cells: DataFrame, radius: int, cells: DataFrame) -> DataFrame:
    """Those of ``cells`` within ``radius`` cross-shaped steps of a mask cell."""
    return near_l1(cells, mask_cells, radius).select(*grid.CELL)


def erode(mask_cells: DataFrame, radius: int) -> DataFrame:
    """Mask cells whose whole diamond lies in the mask; the outside counts as empty.

    The nearest empty cell of any mask cell lies beside the mask, so only those are seeds.
    """
    mask = mask_cells.select(*grid.CELL)
    sides = grid.neighbours4(mask.withColumn("in_", F.lit(True)), "in_")
    steps = (("w_", 0, -1), ("e_", 0, 1), ("n_", -1, 0), ("s_", 1, 0))
    gaps = F.array(*[F.when(F.col(k).isNull(), F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")))
                     for k, dr, dc in steps])
    empty = sides.select("run_id", F.explode(F.array_compact(gaps)).alias("g")).select("run_id", "g.r", "g.c")
    return mask.join(near_l1(mask, empty, radius), grid.CELL, "left_anti")


def reportable(cells: DataFrame, sizes: DataFrame, seeds: DataFrame, dx: float,
               open_edges=("i0", "imax", "j0", "jmax"), edge_cells: int = fixed.OPEN_EDGE_CELLS,
               near_field_m: float | None = None) -> DataFrame:
    """Adds ``reportable``: clear of open edges and of the near field of the source."""
    d = edge_cells
    edge = F.lit(False)
    zones = {"j0": F.col("r") < d, "jmax": F.col("r") >= F.col("ny") - d,
             "i0": F.col("c") < d, "imax": F.col("c") >= F.col("nx") - d}
    for name in open_edges:
        edge = edge | zones[name]
    out = cells.join(sizes, "run_id").withColumn("_edge", edge).drop("ny", "nx")
    if near_field_m:
        near = dilate(seeds, max(1, round(near_field_m / dx)), cells).withColumn("_near", F.lit(True))
        out = out.join(near, grid.CELL, "left")
    else:
        out = out.withColumn("_near", F.lit(None).cast("boolean"))
    return (out.withColumn("reportable", ~(F.col("_edge") | F.coalesce("_near", F.lit(False))))
               .drop("_edge", "_near"))


def report_masks(cells: DataFrame) -> DataFrame:
    ok = F.coalesce("reportable", F.lit(True))
    return (cells.withColumn("report", F.col("flood") & ok)
                 .withColumn("excluded", F.col("flood") & ~ok))


def mask_is_safe(hand_cells: DataFrame, wet_cells: DataFrame, max_hand: float, margin: int = 2) -> DataFrame:
    """Wet cells within ``margin`` of the edge of the valley mask, per run."""
    valley = hand_cells.where(F.col("hand") <= max_hand).select(*grid.CELL)
    band = valley.join(erode(valley, max(1, margin)), grid.CELL, "left_anti")
    n = band.join(wet_cells.select(*grid.CELL), grid.CELL, "left_semi").groupBy("run_id").agg(
        F.count("*").alias("touching"))
    return hand_cells.select("run_id").distinct().join(n, "run_id", "left").select(
        "run_id", F.coalesce("touching", F.lit(0)).alias("touching"),
        F.col("touching").isNull().alias("safe"))


def signed_distance(x, y, line):
    """Perpendicular distance to a directed line, positive on its left."""
    (x1, y1), (x2, y2) = line
    dx, dy = x2 - x1, y2 - y1
    length = (dx * dx + dy * dy) ** 0.5
    return (dx * (y - y1) - dy * (x - x1)) / length


def reservoir(cells: DataFrame, line, level: float, dry_centre, dry_radius: float) -> DataFrame:
    """Adds ``lake``: behind the dam line, below the level, valid, outside the dry disc."""
    x, y = F.col("x"), F.col("y")
    away = (x - dry_centre[0]) ** 2 + (y - dry_centre[1]) ** 2 > dry_radius * dry_radius
    lake = (signed_distance(x, y, line) > 0.001) & F.col("valid") & (F.col("z") < level) & away
    return cells.withColumn("lake", lake)


def points_wet_at_start(points: DataFrame, cells: DataFrame, mask: str = "lake") -> DataFrame:
    """Per run the points, those that stand in water from the start, and those outside the grid."""
    at = points.join(cells.select(*grid.CELL, F.col(mask).alias("_wet")), grid.CELL, "left")
    return at.groupBy("run_id").agg(F.count("*").alias("points"), F.count_if(F.coalesce("_wet", F.lit(False))).alias("wet"),
                                    F.count_if(F.col("_wet").isNull()).alias("outside"))


def extent_agreement(cells: DataFrame, a: str, b: str) -> DataFrame:
    both, any_ = F.col(a) & F.col(b), F.col(a) | F.col(b)
    return cells.groupBy("run_id").agg(
        F.count_if(both).alias("both"), F.count_if(any_).alias("either"),
        F.when(F.count_if(any_) > 0, F.count_if(both) / F.count_if(any_)).alias("iou"))
