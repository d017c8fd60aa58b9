"""Study areas, sources of figures, and request validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark import fixed


def lookup(areas: DataFrame, key: str) -> DataFrame:
    """One study area; an unknown key is an error that says how many are known."""
    hit = areas.where(F.col("key") == key)
    if hit.isEmpty():
        raise KeyError(f"unknown study area {key!r}; {areas.count()} are known")
    return hit


def unverified(sources: DataFrame, prefix: str | None = None) -> DataFrame:
    out = sources.where(~F.col("verified"))
    if prefix is not None:
        out = out.where(F.col("key").startswith(prefix))
    return out.orderBy("key")


def unverified_specs(specs: DataFrame, sources: DataFrame) -> DataFrame:
    """Specification fields whose source is unverified, by the dotted key."""
    s = specs.withColumn("key", F.concat_ws(".", "area", "owner", "field"))
    return s.join(sources.where(~F.col("verified")).select("key", "citation"), "key").select(
        "area", F.concat(F.initcap("owner"), F.lit("."), F.col("field"), F.lit(": "), F.col("citation")).alias("text"))


def study_info(areas: DataFrame) -> DataFrame:
    """Flat description of an area from its dam, else its blockage; specs as JSON."""
    def feature(name):
        return F.coalesce(F.col(f"dam.{name}"), F.col(f"blockage.{name}")).alias(name)
    return areas.select("key", "title", feature("river"), feature("lat"), feature("lon"),
                        F.to_json("dam").alias("dam"), F.to_json("blockage").alias("blockage"))


def validate_requests(requests: DataFrame, areas: DataFrame) -> DataFrame:
    """Every request with its effective ``dx`` and the first reason to refuse it."""
    j = requests.join(areas.select(F.col("key").alias("area"), "dx_default"), "area", "left")
    dx = F.coalesce("dx", "dx_default")
    why = (F.when(F.col("dx_default").isNull(), F.concat(F.lit("unknown study area "), F.col("area")))
            .when(~F.col("hours").between(fixed.MIN_HOURS, fixed.MAX_HOURS), "duration out of range")
            .when(~dx.between(fixed.MIN_DX_M, fixed.MAX_DX_M), "dx out of range"))
    return j.withColumn("dx", dx).withColumn("reason", why).drop("dx_default")


def provenance(areas: DataFrame, sources: DataFrame) -> DataFrame:
    """Domain size, cells at each resolution and the pending sources of every area."""
    s = sources.where(~F.col("verified")).withColumn("area", F.substring_index("key", ".", 1))
    p = s.groupBy(F.col("area").alias("key")).agg(F.count("*").alias("pending"),
                                                  F.concat_ws("; ", F.array_sort(F.collect_list("key"))).alias("keys"))
    def cells(dx):
        return (F.bround(F.col("width_m") / dx, 0) * F.bround(F.col("height_m") / dx, 0)).cast("long")
    return areas.join(p, "key", "left").select(
        "key", (F.col("width_m") / 1000).alias("width_km"), (F.col("height_m") / 1000).alias("height_km"),
        cells(F.col("dx_fast")).alias("cells_fast"), cells(F.col("dx_fine")).alias("cells_fine"),
        F.coalesce("pending", F.lit(0)).alias("pending"),
        F.coalesce("keys", F.lit("all registered quantities verified")).alias("keys"))
