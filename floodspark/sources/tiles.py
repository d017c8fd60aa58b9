"""Names of the raster tiles a request needs, and the boxes that decide it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import fixed


def _corner(name_lat: Column, name_lon: Column, middle: str) -> Column:
    ns = F.when(name_lat >= 0, "N").otherwise("S")
    ew = F.when(name_lon >= 0, "E").otherwise("W")
    return F.concat(ns, F.lpad(F.abs(name_lat).cast("string"), 2, "0"), F.lit(middle), ew,
                    F.lpad(F.abs(name_lon).cast("string"), 3, "0"))


def elevation_tiles(boxes: DataFrame, arcsec: int = 10) -> DataFrame:
    """One-degree tiles named by their south-west corner; a whole-degree upper edge is exclusive."""
    lat = F.sequence(F.floor("south"), F.ceil("north") - 1)
    lon = F.sequence(F.floor("west"), F.ceil("east") - 1)
    t = boxes.withColumn("lat", F.explode(lat)).withColumn("lon", F.explode(lon))
    name = F.concat(F.lit(f"Copernicus_DSM_COG_{arcsec}_"), _corner(F.col("lat"), F.col("lon"), "_00_"),
                    F.lit("_00_DEM"))
    return t.select("box_id", F.col("lat").cast("int").alias("lat"), F.col("lon").cast("int").alias("lon"),
                    name.alias("tile"))


def landcover_tiles(boxes: DataFrame) -> DataFrame:
    d = fixed.LANDCOVER_TILE_DEG
    def span(lo, hi):
        return F.explode(F.sequence((F.floor(F.col(lo) / d) * d).cast("int"),
                                    (F.floor((F.col(hi) - 1e-9) / d) * d).cast("int"), F.lit(d)))
    t = boxes.withColumn("lat", span("south", "north")).withColumn("lon", span("west", "east"))
    name = F.concat(F.lit("ESA_WorldCover_10m_2021_v200_"), _corner(F.col("lat"), F.col("lon"), ""), F.lit("_Map"))
    return t.select("box_id", "lat", "lon", name.alias("tile"))


def box_around(points: DataFrame, margin_km: float) -> DataFrame:
    """Longitude-latitude box around each group of points, with a margin."""
    b = points.groupBy("box_id").agg(*[f(c).alias(n) for f, c, n in (
        (F.min, "lat", "s"), (F.max, "lat", "n"), (F.min, "lon", "w"), (F.max, "lon", "e"))])
    dlat = margin_km / fixed.KM_PER_DEG
    mid = F.cos(F.radians((F.col("s") + F.col("n")) * 0.5))
    dlon = margin_km / (fixed.KM_PER_DEG * F.greatest(F.lit(0.2), mid))
    return b.select("box_id", (F.col("w") - dlon).alias("west"), (F.col("s") - dlat).alias("south"),
                    (F.col("e") + dlon).alias("east"), (F.col("n") + dlat).alias("north"))


def metric_extent(points: DataFrame, dx: float, margin_km: float) -> DataFrame:
    """Metric box around ``x, y`` snapped outwards to whole cells."""
    m = margin_km * 1000.0
    lo = lambda c: (F.floor((F.min(c) - m) / dx) * dx).cast("double")
    hi = lambda c: (F.ceil((F.max(c) + m) / dx) * dx).cast("double")
    return points.groupBy("box_id").agg(lo("x").alias("xmin"), lo("y").alias("ymin"),
                                        hi("x").alias("xmax"), hi("y").alias("ymax"))


def contains(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Whether each point lies in its own box."""
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return points.join(boxes, "box_id").withColumn("inside", inside)
