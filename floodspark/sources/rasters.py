"""Mosaics and windows over tiled raster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import fixed, grid


def mosaic(pixels: DataFrame, value: str, usable: Column, order: str = "tile_no") -> DataFrame:
    """Overlapping tiles pasted in order: the last tile with a usable pixel wins."""
    return pixels.where(usable).groupBy(*grid.CELL).agg(F.max_by(value, order).alias(value))


def elevation_mosaic(pixels: DataFrame, lattice: DataFrame) -> DataFrame:
    """Full lattice of elevations; unusable, missing and very low cells become voids."""
    m = mosaic(pixels, "z", F.col("z").isNotNull() & ~F.isnan("z"))
    z = F.when(F.col("z") >= fixed.VOID_BELOW_M, F.col("z"))
    return _refuse_empty(lattice.join(m, grid.CELL, "left").withColumn("z", z), F.col("z").isNotNull())


def landcover_mosaic(pixels: DataFrame, lattice: DataFrame) -> DataFrame:
    """Full lattice of classes; 0 where no tile is classified."""
    m = mosaic(pixels, "cls", F.col("cls") > 0)
    return _refuse_empty(lattice.join(m, grid.CELL, "left").withColumn("cls", F.coalesce("cls", F.lit(0))),
                         F.col("cls") > 0)


def _refuse_empty(full: DataFrame, good: Column) -> DataFrame:
    """A run without one good cell is an error, raised when its rows are read."""
    n = full.groupBy("run_id").agg(F.count_if(good).alias("_n"))
    bad = F.when(F.col("_n") == 0, F.raise_error(F.lit("every cell is void")).cast("long")).otherwise(F.col("_n"))
    return full.join(n.withColumn("_n", bad), "run_id").where(F.col("_n") > 0).drop("_n")


def window(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], pad: int = 20) -> DataFrame:
    """Padded read window of a count raster: pushed to the scan, gaps and negatives are 0.

    A run whose raster lies all outside the window is an error, raised when its rows are read.
    """
    inside = (F.col("sr").between(rows[0] - pad, rows[1] + pad) & F.col("sc").between(cols[0] - pad, cols[1] + pad))
    cnt = F.greatest(F.coalesce("cnt", F.lit(0.0)), F.lit(0.0))
    kept = pixels.where(inside).withColumn("cnt", cnt)
    missed = pixels.groupBy("run_id").agg(F.max(inside).alias("hit")).where(~F.col("hit"))
    why = F.raise_error(F.concat(F.lit("the window does not overlap the raster of run "), F.col("run_id").cast("string")))
    refused = missed.select(*[(why if c == "cnt" else F.lit(None)).cast(t).alias(c) if c != "run_id" else F.col(c)
                              for c, t in pixels.dtypes])
    return kept.unionByName(refused)
