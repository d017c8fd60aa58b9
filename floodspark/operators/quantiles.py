"""Exact quantiles of large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodspark.session import cut

BUCKETS = 1024
#: Different values that are put in order within one task.
SMALL = 100_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], small: int = SMALL,
                    buckets: int = BUCKETS) -> DataFrame:
    """``keys, q, value`` with linear interpolation between order statistics.

    Equal values are merged first.  Each wanted rank lies in a range of values, at first the whole group's.  While a
    range holds more than ``small`` different values it is cut into ``buckets`` bins, and the bin that holds the rank,
    from its least to its largest value, is the next range: far outliers lose their hold after one round.  Ranges that
    are small are put in order.
    """
    merged = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n")), "values")
    span = merged.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"),
                                     F.count("*").alias("m"))
    at = F.col("q") * (F.col("total") - 1)
    wanted = span.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("at", at)
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    wanted = cut(wanted.select(*keys, "q", "at", "rank", "lo", "hi", F.lit(0).cast("long").alias("before"), "m"), "ranges")
    area = ["lo", "hi", "before"]
    while not (wide := wanted.where((F.col("m") > small) & (F.col("lo") < F.col("hi")))).isEmpty():
        ranges = wide.select(*keys, *area).distinct()
        inside = merged.join(ranges, keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
        # halves first: the width of the whole range of doubles is not a double
        place = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets
        bins = inside.groupBy(*keys, *area, F.least(F.lit(buckets - 1), F.floor(place)).alias("bin")).agg(
            F.sum("n").alias("bn"), F.count("*").alias("bm"), F.min("v").alias("blo"), F.max("v").alias("bhi"))
        w = Window.partitionBy(*keys, *area).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("start", F.col("before") + F.coalesce(F.sum("bn").over(w), F.lit(0)))
        next_ = wide.join(bins, [*keys, *area]).where(
            (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("bn"))).select(
            *keys, "q", "at", "rank", F.col("blo").alias("lo"), F.col("bhi").alias("hi"), F.col("start").alias("before"),
            F.col("bm").alias("m"))
        done = wanted.where((F.col("m") <= small) | (F.col("lo") == F.col("hi")))
        wanted = cut(done.unionByName(next_), "ranges")
    inner = merged.join(wanted.select(*keys, *area).distinct(), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    wi = Window.partitionBy(*keys, *area).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(wi), F.lit(0)))
    got = wanted.join(inner, [*keys, *area]).where(
        (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
    got = got.groupBy(*keys, "q", "at").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("z"))
    return got.select(*keys, "q", (F.col("a") + (F.col("z") - F.col("a")) * (F.col("at") - F.floor("at")))
                      .alias("value"))
