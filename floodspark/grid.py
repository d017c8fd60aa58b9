"""Cell grids as tables: keys, tiles, neighbours and halos.

A grid is a table with one row per cell, keyed by ``run_id, r, c`` (row, column).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark import fixed

CELL = ["run_id", "r", "c"]
RING8 = list(zip(fixed.D8_DR, fixed.D8_DC))
DEFAULT_TILE = 256


def tile_of(col, size: int) -> Column:
    return F.floor(F.col(col) / size).cast("int") if isinstance(col, str) \
        else F.floor(col / size).cast("int")


def with_tile(df: DataFrame, size: int = DEFAULT_TILE) -> DataFrame:
    return df.withColumn("tr", tile_of("r", size)).withColumn("tc", tile_of("c", size))


def with_halo(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Copy every cell to each tile whose ``halo``-wide surround contains it.

    Adds ``tr, tc`` (tile) and ``core`` (the tile owns the cell).  About
    ``1 + 4*halo/size`` copies per cell, so one exchange moves hardly more than
    the grid itself.
    """
    def span(name):
        v = F.col(name)
        return F.explode(F.sequence(tile_of(v - halo, size), tile_of(v + halo, size)))

    out = df.withColumn("tr", span("r")).withColumn("tc", span("c"))
    return out.withColumn(
        "core", (F.col("tr") == tile_of("r", size)) & (F.col("tc") == tile_of("c", size)))


def disc(radius_cells: float) -> list[tuple[int, int]]:
    k = range(-int(math.floor(radius_cells)), int(math.floor(radius_cells)) + 1)
    return [(dr, dc) for dr in k for dc in k if dr * dr + dc * dc <= radius_cells * radius_cells]


def offsets_column(offsets: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"))
                     for i, (dr, dc) in enumerate(offsets)])


def spread(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Send every row to the cells at the given offsets (sparse grids welcome).

    Adds ``dr, dc, k``; ``r, c`` become the receiving cell, so the sender sits at
    ``(r - dr, c - dc)``.
    """
    return (df.withColumn("_o", F.explode(offsets_column(offsets)))
              .withColumn("r", F.col("r") + F.col("_o.dr"))
              .withColumn("c", F.col("c") + F.col("_o.dc"))
              .withColumn("k", F.col("_o.k"))
              .withColumn("dr", F.col("_o.dr"))
              .withColumn("dc", F.col("_o.dc"))
              .drop("_o"))


def spread_box(df: DataFrame, radius: int, diamond: bool = False) -> DataFrame:
    """Send every row to the cells of a square, or of an L1 ball, around it."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    out = df.withColumn("dr", F.explode(step))
    if diamond:
        side = F.lit(radius) - F.abs("dr")
        step = F.sequence(-side, side)
    out = out.withColumn("dc", F.explode(step))
    return (out.withColumn("r", F.col("r") + F.col("dr")).withColumn("c", F.col("c") + F.col("dc"))
               .drop("dr", "dc"))


def lattice(sizes: DataFrame) -> DataFrame:
    """Every cell of every run, from one ``ny, nx`` row per run; rows spread before columns."""
    rows = sizes.select("run_id", "nx", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("r"))
    return rows.repartition("run_id", "r").select(
        "run_id", "r", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("c"))


def beside(value, window, step: int, axis: str) -> Column:
    """Value of the cell ``step`` places along ``axis``, NULL across a gap."""
    value = F.col(value) if isinstance(value, str) else value
    at = F.lead(F.col(axis), step) if step > 0 else F.lag(F.col(axis), -step)
    got = F.lead(value, step) if step > 0 else F.lag(value, -step)
    return F.when(at.over(window) == F.col(axis) + step, got.over(window))


def row_window():
    """Along one grid row of one run; its size is the grid width, never the table."""
    return Window.partitionBy("run_id", "r").orderBy("c")


def col_window():
    return Window.partitionBy("run_id", "c").orderBy("r")


def neighbours4(df: DataFrame, value: str) -> DataFrame:
    """Adds ``w_, e_, n_, s_`` with the neighbouring values (two sorts, no join)."""
    rw, cw = row_window(), col_window()
    return (df.withColumn("w_", beside(value, rw, -1, "c"))
              .withColumn("e_", beside(value, rw, 1, "c"))
              .withColumn("n_", beside(value, cw, -1, "r"))
              .withColumn("s_", beside(value, cw, 1, "r")))


def neighbours8(df: DataFrame, value: str) -> DataFrame:
    """Adds ``nb``: the eight neighbouring values in E SE S SW W NW N NE order.

    Two window passes for grids without gaps: the row pass gathers west and east,
    the column pass carries those triples north and south.  Two exchanges of one
    copy per cell, against nine copies for an exploded self-join.
    """
    rw, cw = row_window(), col_window()
    trio = (df.withColumn("_w", beside(value, rw, -1, "c"))
              .withColumn("_e", beside(value, rw, 1, "c"))
              .withColumn("_t", F.struct(F.col("_w").alias("w"), F.col(value).alias("v"),
                                         F.col("_e").alias("e"))))
    trio = (trio.withColumn("_n", beside("_t", cw, -1, "r"))
                .withColumn("_s", beside("_t", cw, 1, "r")))
    return (trio.withColumn("nb", F.array(
                F.col("_e"), F.col("_s.e"), F.col("_s.v"), F.col("_s.w"),
                F.col("_w"), F.col("_n.w"), F.col("_n.v"), F.col("_n.e")))
            .drop("_w", "_e", "_t", "_n", "_s"))


def grid_sizes(cells: DataFrame) -> DataFrame:
    """One row per run: ``ny, nx`` from the largest row and column present."""
    return cells.groupBy("run_id").agg((F.max("r") + 1).alias("ny"), (F.max("c") + 1).alias("nx"))


def unmatched_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shape check of a cell-aligned join: cells present on one side only, per run."""
    a = left.select(*CELL).withColumn("in_left", F.lit(1))
    b = right.select(*CELL).withColumn("in_right", F.lit(1))
    both = a.join(b, CELL, "full_outer")
    return both.groupBy("run_id").agg(
        F.count_if(F.col("in_right").isNull()).alias("left_only"),
        F.count_if(F.col("in_left").isNull()).alias("right_only"))
