"""Hazard columns: debris factor, Defra rating and class, AIDR class, flood masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import fixed


def _pick(values, index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def is_dry(depth: Column, threshold: float = fixed.WET_THRESHOLD_M) -> Column:
    return F.coalesce(depth < threshold, F.lit(True))


def debris_factor(depth: Column, speed: Column, landcover="urban") -> Column:
    """``landcover`` is a class name, or a column of class indices checked at run time."""
    if isinstance(landcover, str):
        if landcover not in fixed.DEBRIS_LANDCOVER:
            raise ValueError(f"landcover must be one of {fixed.DEBRIS_LANDCOVER}, got {landcover!r}")
        code = F.lit(fixed.DEBRIS_LANDCOVER.index(landcover))
    else:
        code = F.when(landcover.between(0, len(fixed.DEBRIS_LANDCOVER) - 1), landcover).otherwise(
            F.raise_error(F.concat(F.lit("landcover index out of range: "),
                                   landcover.cast("string"))).cast("int"))
    deep = (depth >= fixed.DEBRIS_DEEP_DEPTH) | (speed > fixed.DEBRIS_DEEP_SPEED)
    return (F.when(deep, _pick(fixed.DEBRIS_DEEP, code))
             .when(depth >= fixed.DEBRIS_MEDIUM_DEPTH, _pick(fixed.DEBRIS_MEDIUM, code))
             .otherwise(_pick(fixed.DEBRIS_SHALLOW, code)))


def hazard_rating(depth: Column, speed: Column, dv: Column | None = None,
                  landcover="urban") -> Column:
    """``d(v + 0.5) + DF``, with the running maximum of d*v when it is known."""
    speed = F.coalesce(speed, F.lit(0.0))
    product = depth * speed if dv is None else F.coalesce(dv, depth * speed)
    return product + fixed.VELOCITY_OFFSET * depth + debris_factor(depth, speed, landcover)


def hazard_class(rating: Column, dry: Column) -> Column:
    low, mid, high = fixed.HAZARD_BANDS
    return (F.when(dry, -1).when(rating < low, 0).when(rating < mid, 1)
             .when(rating < high, 2).otherwise(3)).cast("int")


def aidr_class(depth: Column, speed: Column, dry: Column, dv: Column | None = None) -> Column:
    """First class whose three limits all hold; beyond them H6."""
    speed = F.coalesce(speed, F.lit(0.0))
    product = depth * speed if dv is None else F.coalesce(dv, depth * speed)
    out = F.when(dry, -1)
    for i, (_, dv_max, d_max, v_max, _) in enumerate(fixed.AIDR_LIMITS):
        out = out.when((product <= dv_max) & (depth <= d_max) & (speed <= v_max), i)
    return out.otherwise(len(fixed.AIDR_LIMITS)).cast("int")


def classify(cells: DataFrame, landcover="urban",
             threshold: float = fixed.WET_THRESHOLD_M) -> DataFrame:
    """Adds ``dry, rating, defra_class, aidr_class`` to an accumulator table."""
    d, v, dv = F.col("max_depth"), F.col("max_speed"), F.col("max_dv")
    return (cells.withColumn("dry", is_dry(d, threshold))
                 .withColumn("rating", F.when(F.col("dry"), 0.0)
                             .otherwise(hazard_rating(d, v, dv, landcover)))
                 .withColumn("defra_class", hazard_class(F.col("rating"), F.col("dry")))
                 .withColumn("aidr_class", aidr_class(d, v, F.col("dry"), dv)))


def flood_masks(cells: DataFrame) -> DataFrame:
    """Adds ``flood, new_flood, ever_flooded, newly_flooded`` (needs ``dry, arrival_s``)."""
    already = F.coalesce(F.col("initially_wet"), F.lit(False))
    return (cells.withColumn("flood", ~F.col("dry"))
                 .withColumn("new_flood", ~F.col("dry") & ~already)
                 .withColumn("ever_flooded", F.col("arrival_s").isNotNull())
                 .withColumn("newly_flooded", F.col("arrival_s").isNotNull() & ~already))
