"""Flood extent observed by radar: composites, change, masks, blobs, area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.operators import components as comp
from floodspark.operators import terrain


def select_scenes(px: DataFrame, start: Column, end: Column, polarisation: str = "VV", mode: str = "IW",
                  orbit: str | None = None) -> DataFrame:
    """Scenes of one mode and polarisation with ``start <= date < end``; all pushed to the scan."""
    keep = px.where((F.col("acq_date") >= start) & (F.col("acq_date") < end) & (F.col("mode") == mode)
                    & F.array_contains("pol", polarisation))
    return keep if orbit is None else keep.where(F.col("orbit") == orbit)


def median_composite(px: DataFrame) -> DataFrame:
    """Temporal median per pixel: one value per pass, so groups stay small."""
    return px.groupBy(*grid.CELL).agg(F.median("db").alias("db"))


def change_ratio(pre: Column, post: Column, ratio: str = "post_over_pre") -> Column:
    """Newly dark pixels give a ratio above one; backscatter is negative decibels."""
    return post / pre if ratio == "post_over_pre" else pre / post


def changed_cells(pre: DataFrame, post: DataFrame, smooth_cells: float, threshold: float, ratio: str = "post_over_pre",
                  tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Cells whose smoothed composites differ by more than the threshold."""
    a = terrain.focal_median(pre, "db", smooth_cells, tile).select(*grid.CELL, F.col("focal").alias("pre"))
    b = terrain.focal_median(post, "db", smooth_cells, tile).select(*grid.CELL, F.col("focal").alias("post"))
    return a.join(b, grid.CELL).where(change_ratio(F.col("pre"), F.col("post"), ratio) > threshold)


def flood_pixels(pre: DataFrame, post: DataFrame, occurrence: DataFrame, slope: DataFrame,
                 smooth_cells: float, threshold: float = fixed.SAR_RATIO,
                 max_occurrence: float = fixed.SAR_MAX_OCCURRENCE, max_slope: float = fixed.SAR_MAX_SLOPE_DEG,
                 min_blob: int = fixed.SAR_MIN_BLOB_PX, ratio: str = "post_over_pre",
                 tile: int = grid.DEFAULT_TILE) -> DataFrame:
    changed = changed_cells(pre, post, smooth_cells, threshold, ratio, tile)
    refined = refine(changed, occurrence, slope, max_occurrence, max_slope)
    lab = comp.components(refined.withColumn("hit", F.lit(True)), "hit", True, tile)
    return comp.drop_small(lab, min_blob).select(*grid.CELL)


def refine(changed: DataFrame, occurrence: DataFrame, slope: DataFrame,
           max_occurrence: float = fixed.SAR_MAX_OCCURRENCE,
           max_slope: float = fixed.SAR_MAX_SLOPE_DEG) -> DataFrame:
    """Drop permanent water (never seen = 0 %) and slopes that hold no water."""
    return (changed.join(occurrence.select(*grid.CELL, "occurrence"), grid.CELL, "left")
                   .where(F.coalesce("occurrence", F.lit(0)) < max_occurrence)
                   .join(slope.where(F.col("slope_deg") <= max_slope).select(*grid.CELL), grid.CELL, "left_semi"))


def observed_area(flood: DataFrame, pixel_area: Column) -> DataFrame:
    return flood.agg((F.coalesce(F.sum(pixel_area), F.lit(0.0)) / 1e6).alias("km2"))
