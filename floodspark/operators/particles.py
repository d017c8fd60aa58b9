"""Reductions over particle snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME = ["run_id", "t_s"]


def gauge_flux(p: DataFrame, gauge_x: float, dp: float) -> DataFrame:
    near = F.col("fluid") & (F.abs(F.col("x") - gauge_x) < dp)
    flux = F.sum(F.when(near, F.col("m") / F.col("rho") * F.col("u")))
    return p.groupBy(*TIME).agg((F.coalesce(flux, F.lit(0.0)) / (2.0 * dp)).alias("q"))


def free_surface(p: DataFrame, tank: float, bin_m: float) -> DataFrame:
    """Highest fluid particle per bin, zero rows kept for empty bins."""
    nb = int(-(-tank // bin_m))
    b = F.least(F.greatest(F.floor(F.col("x") / bin_m), F.lit(0)), F.lit(nb - 1)).cast("int")
    top = p.where("fluid").groupBy(*TIME, b.alias("bin")).agg(F.max("z").alias("h"))
    every = p.select(*TIME).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    return every.join(top, [*TIME, "bin"], "left").select(
        *TIME, "bin", ((F.col("bin") + 0.5) * bin_m).alias("x_mid"),
        F.greatest(F.coalesce("h", F.lit(0.0)), F.lit(0.0)).alias("h"))


def front_and_volume(p: DataFrame, dp: float) -> DataFrame:
    bed = F.col("fluid") & (F.col("z") < 2.0 * dp)
    return p.groupBy(*TIME).agg(
        F.coalesce(F.max(F.when(bed, F.col("x"))), F.max(F.when(F.col("fluid"), F.col("x")))).alias("front"),
        F.coalesce(F.sum(F.when(F.col("fluid"), F.col("m") / F.col("rho"))), F.lit(0.0)).alias("volume"))


def profile_front(profile: DataFrame, threshold: float, fallback: float) -> DataFrame:
    return profile.groupBy("run_id").agg(F.coalesce(
        F.max(F.when(F.col("h") > threshold, F.col("x"))), F.lit(fallback)).alias("front"))
