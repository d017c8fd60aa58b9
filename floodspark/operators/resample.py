"""Rasters onto other grids: area-overlap averages, modes, bilinear reprojection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.functions import geodesy


def subpoints(targets: DataFrame, k: int) -> DataFrame:
    """``k*k`` evenly spaced points per cell as fractional offsets ``fr, fc``."""
    part = F.array(*[F.lit((i + 0.5) / k) for i in range(k)])
    return targets.withColumn("fr", F.explode(part)).withColumn("fc", F.explode(part))


def overlap(targets: DataFrame, to_source, k: int = 4) -> DataFrame:
    """Target cells with the source cell under each sub-point (``sr, sc``).

    ``to_source(r, c)`` maps fractional target row and column to ``STRUCT<r, c>`` of
    fractional source indices; how often a pair appears is its area weight.
    """
    p = subpoints(targets, k)
    s = to_source(F.col("r") + F.col("fr"), F.col("c") + F.col("fc"))
    return (p.withColumn("_s", s).withColumn("sr", F.floor("_s.r").cast("int"))
             .withColumn("sc", F.floor("_s.c").cast("int")).drop("_s", "fr", "fc"))


@dataclass(frozen=True)
class GeographicRaster:
    """Pixels of ``res`` degrees whose first has its north-west corner at ``lon0, lat0``."""
    lon0: float
    lat0: float
    res: float

    def pixel(self, lat: Column, lon: Column) -> Column:
        """Fractional row and column of a point."""
        return F.struct(((self.lat0 - lat) / self.res).alias("r"), ((lon - self.lon0) / self.res).alias("c"))

    def point(self, r: Column, c: Column) -> tuple[Column, Column]:
        """Latitude and longitude of a fractional row and column."""
        return self.lat0 - r * self.res, self.lon0 + c * self.res

    def area(self, row: Column) -> Column:
        """Ground area of the pixels of a row, m^2."""
        return geodesy.spherical_cell_area(self.lat0 - (row + 0.5) * self.res, self.res, self.res)


@dataclass(frozen=True)
class UtmGrid:
    """Cells of ``dx`` metres in a zone; the first has its north-west corner at ``x0, y0``."""
    x0: float
    y0: float
    dx: float
    zone: int
    north: bool = True

    def cell(self, p: Column) -> Column:
        return F.struct(((self.y0 - p["y"]) / self.dx).alias("r"), ((p["x"] - self.x0) / self.dx).alias("c"))

    def to_pixels(self, raster: GeographicRaster):
        """From fractional rows and columns of this grid to those of the raster."""
        def convert(r: Column, c: Column) -> Column:
            g = geodesy.utm_inverse(self.x0 + c * self.dx, self.y0 - r * self.dx, F.lit(self.zone), F.lit(self.north))
            return raster.pixel(g["lat"], g["lon"])
        return convert

    def from_pixels(self, raster: GeographicRaster):
        """From fractional rows and columns of the raster to those of this grid."""
        def convert(r: Column, c: Column) -> Column:
            return self.cell(geodesy.utm_forward(*raster.point(r, c), F.lit(self.zone)))
        return convert


def people_across(source: DataFrame, raster: GeographicRaster, targets: DataFrame, target: UtmGrid, k: int = 4) -> DataFrame:
    """People per cell of a UTM grid from counts on a longitude-latitude raster.

    Counts become densities by each row's own ground area; a cell takes the mean density under its ``k * k``
    sub-points, found by the inverse projection.
    """
    return resample_population(source, targets, target.to_pixels(raster), target.dx, raster.area(F.col("sr")), k)


def resample_population(source: DataFrame, targets: DataFrame, to_source, target_dx: float,
                        cell_area: Column, k: int = 4) -> DataFrame:
    """People per target cell: counts to density, area average, back to counts.

    ``source`` is ``(run_id, sr, sc, cnt)``; negative and missing counts are nobody.
    """
    cnt = F.greatest(F.coalesce("cnt", F.lit(0.0)), F.lit(0.0))
    dens = source.select("run_id", "sr", "sc", (cnt / cell_area).alias("dens"))
    # sub-points over the same pixel are counted before the join, which would sort every one of them
    pairs = overlap(targets.select(*grid.CELL), to_source, k).groupBy(*grid.CELL, "sr", "sc").agg(F.count("*").alias("w"))
    pairs = pairs.join(dens, ["run_id", "sr", "sc"], "left")
    return pairs.groupBy(*grid.CELL).agg(F.sum(F.col("dens") * F.col("w")).alias("s"),
                                         F.sum(F.when(F.col("dens").isNotNull(), F.col("w"))).alias("n")).select(
        *grid.CELL, F.when(F.col("n") > 0, F.col("s") / F.col("n") * target_dx * target_dx)
        .otherwise(0.0).alias("pop"))


def conservation(source: DataFrame, result: DataFrame, to_target, sizes: DataFrame, k: int = 4,
                 tolerance: float = 0.02) -> DataFrame:
    """Resampled total against the source total inside the target footprint."""
    cnt = F.greatest(F.coalesce("cnt", F.lit(0.0)), F.lit(0.0))
    src = source.select("run_id", F.col("sr").alias("r"), F.col("sc").alias("c"), cnt.alias("cnt"))
    p = subpoints(src, k)
    t = to_target(F.col("r") + F.col("fr"), F.col("c") + F.col("fc"))
    p = p.withColumn("_t", t).join(sizes, "run_id")
    inside = ((F.col("_t.r") >= 0) & (F.col("_t.r") < F.col("ny"))
              & (F.col("_t.c") >= 0) & (F.col("_t.c") < F.col("nx")))
    foot = p.groupBy("run_id").agg((F.sum(F.when(inside, F.col("cnt"))) / (k * k)).alias("source_total"),
                                   (F.sum("cnt") / (k * k)).alias("raw_total"))
    got = result.groupBy("run_id").agg(F.sum("pop").alias("resampled_total"))
    res = F.when(F.coalesce("source_total", F.lit(0.0)) == 0, 0.0).otherwise(
        (F.col("resampled_total") - F.col("source_total")) / F.col("source_total"))
    return foot.join(got, "run_id").withColumn("residual", res).withColumn(
        "conserved", F.abs("residual") <= tolerance).withColumn("subpoints", F.lit(k))


def landcover_dimension(spark, channel_n: float | None = None) -> DataFrame:
    """``cls, name, n, n_low, n_high`` over the fixed legend (11 rows)."""
    rows = [(code, name, n, lo, hi) if code != 80 or channel_n is None
            else (code, name, channel_n, min(lo, channel_n), max(hi, channel_n))
            for code, name, n, lo, hi in fixed.LANDCOVER_CLASSES]
    return spark.createDataFrame(rows, "cls int, name string, n double, n_low double, n_high double")


def with_roughness(pixels: DataFrame, channel_n: float | None = None, fallback: float = fixed.FALLBACK_N) -> DataFrame:
    """Look up every pixel's class; unknown classes take the fallback."""
    dim = F.broadcast(landcover_dimension(pixels.sparkSession, channel_n))
    j = pixels.join(dim, "cls", "left")
    for c in ("n", "n_low", "n_high"):
        j = j.withColumn(c, F.coalesce(c, F.lit(fallback)))
    return j


def composite_roughness(pixels: DataFrame, targets: DataFrame, factor: int, debris_flow: bool = False,
                        channel_n: float | None = None, fallback: float = fixed.FALLBACK_N) -> DataFrame:
    """Mean n, low and high over each target cell (nested grids), with a fallback flag."""
    k = fixed.DEBRIS_FLOW_N_FACTOR if debris_flow else 1.0
    px = with_roughness(pixels, channel_n, fallback)
    avg = px.groupBy("run_id", F.floor(F.col("fr") / factor).cast("int").alias("r"),
                     F.floor(F.col("fc") / factor).cast("int").alias("c")).agg(
        *[F.avg(x).alias(x) for x in ("n", "n_low", "n_high")])
    j = targets.select(*grid.CELL).join(avg, grid.CELL, "left").withColumn("fallback", F.col("n").isNull())
    for c in ("n", "n_low", "n_high"):
        j = j.withColumn(c, F.coalesce(c, F.lit(fallback)) * k)
    return j


def roughness_or_uniform(cells: DataFrame, uniform: float = fixed.FALLBACK_N, debris_flow: bool = False,
                         strict: bool = False) -> DataFrame:
    """Fill a missing roughness with one constant and say so; ``strict`` refuses."""
    value = uniform * (fixed.DEBRIS_FLOW_N_FACTOR if debris_flow else 1.0)
    missing = F.raise_error(F.lit("land cover missing")).cast("double") if strict else F.lit(value)
    note = F.when(F.col("n").isNull(), F.lit(
        f"land cover unavailable: uniform n = {value:g}, not derived from land cover"))
    return cells.withColumn("note", note).withColumn(
        "n", F.when(F.col("n").isNull(), missing).otherwise(F.col("n")))


def dominant_class(pixels: DataFrame, factor: int) -> DataFrame:
    """Most frequent class per coarse cell, unclassified ignored, smaller code on a tie."""
    n = pixels.where("cls <> 0").groupBy(
        "run_id", F.floor(F.col("fr") / factor).cast("int").alias("r"),
        F.floor(F.col("fc") / factor).cast("int").alias("c"), "cls").agg(F.count("*").alias("n"))
    return n.groupBy(*grid.CELL).agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("cls"))


def cover_fractions(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("run_id", "cls").agg(F.count("*").alias("n"))
    tot = n.groupBy("run_id").agg(F.sum("n").alias("total"))
    return n.join(tot, "run_id").select("run_id", "cls", (F.col("n") / F.col("total")).alias("fraction"))


def roughness_summary(cells: DataFrame) -> DataFrame:
    lo = F.avg("n_low")
    return cells.groupBy("run_id").agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.avg("n").alias("n_mean"),
        F.when(lo > 0, F.avg("n_high") / lo).otherwise(1.0).alias("sensitivity_ratio"))


def bilinear(source: DataFrame, targets: DataFrame, to_source) -> DataFrame:
    """Value ``z`` at each target centre from four source centres, weights renormalised.

    A NULL source value, or none, drops out of the weights.
    """
    t = targets.select(*grid.CELL).withColumn("_s", to_source(F.col("r") + 0.5, F.col("c") + 0.5))
    fr, fc = F.col("_s.r") - 0.5, F.col("_s.c") - 0.5
    t = t.select(*grid.CELL, F.floor(fr).cast("int").alias("r0"), F.floor(fc).cast("int").alias("c0"),
                 (fr - F.floor(fr)).alias("a"), (fc - F.floor(fc)).alias("b"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                                 for i in (0, 1) for j in (0, 1)]))
    t = t.withColumn("q", corner).select(
        *grid.CELL, (F.col("r0") + F.col("q.i")).alias("sr"), (F.col("c0") + F.col("q.j")).alias("sc"),
        (F.when(F.col("q.i") == 1, F.col("a")).otherwise(1 - F.col("a"))
         * F.when(F.col("q.j") == 1, F.col("b")).otherwise(1 - F.col("b"))).alias("w"))
    s = source.where(F.col("z").isNotNull()).select("run_id", F.col("r").alias("sr"), F.col("c").alias("sc"), "z")
    g = t.join(s, ["run_id", "sr", "sc"], "left").groupBy(*grid.CELL).agg(
        F.sum(F.when(F.col("z").isNotNull(), F.col("w") * F.col("z"))).alias("wz"),
        F.sum(F.when(F.col("z").isNotNull(), F.col("w"))).alias("w"))
    return g.select(*grid.CELL, F.when(F.col("w") > 0, F.col("wz") / F.col("w")).alias("z"))


def geographic_cover(extents: DataFrame, zone: Column, north: Column, pad_deg: float = 0.01,
                     steps: int = 64) -> DataFrame:
    """Longitude-latitude box around a metric extent, sampled along its edges."""
    f = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    side = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    e = extents.withColumn("f", f).withColumn("f", F.col("f") / steps).withColumn("side", side)
    x = F.when(F.col("side").isin(0, 1), F.col("xmin") + (F.col("xmax") - F.col("xmin")) * F.col("f")).when(
        F.col("side") == 2, F.col("xmin")).otherwise(F.col("xmax"))
    y = F.when(F.col("side").isin(2, 3), F.col("ymin") + (F.col("ymax") - F.col("ymin")) * F.col("f")).when(
        F.col("side") == 0, F.col("ymin")).otherwise(F.col("ymax"))
    g = e.withColumn("g", geodesy.utm_inverse(x, y, zone, north))
    return g.groupBy("extent_id").agg(
        (F.min("g.lon") - pad_deg).alias("west"), (F.min("g.lat") - pad_deg).alias("south"),
        (F.max("g.lon") + pad_deg).alias("east"), (F.max("g.lat") + pad_deg).alias("north"))
