"""Time series: trapezoid integrals, interpolation joins, hydrograph summaries.

A series is keyed by ``run_id, label`` and ordered by ``t_s``.  Windows run inside
time buckets and the buckets are linked through their last points, so a single long
series spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["run_id", "label"]


def with_previous(points: DataFrame, bucket_s: float, value: str = "q") -> DataFrame:
    """Adds ``t_prev, v_prev``: the point before, across bucket borders too."""
    b = points.withColumn("_b", F.floor(F.col("t_s") / bucket_s).cast("long"))
    inside = Window.partitionBy(*SERIES, "_b").orderBy("t_s")
    b = b.withColumn("_p", F.lag(F.struct("t_s", F.col(value).alias("v"))).over(inside))
    ends = b.groupBy(*SERIES, "_b").agg(F.max(F.struct("t_s", F.col(value).alias("v"))).alias("_e"))
    link = ends.select(*SERIES, "_b", F.lag("_e").over(
        Window.partitionBy(*SERIES).orderBy("_b")).alias("_q"))
    j = b.join(link, [*SERIES, "_b"])
    p = F.coalesce(F.col("_p"), F.col("_q"))
    return j.withColumn("t_prev", p["t_s"]).withColumn("v_prev", p["v"]).drop("_b", "_p", "_q")


def trapezoid(points: DataFrame, bucket_s: float = 86_400.0, value: str = "q") -> DataFrame:
    part = (F.col(value) + F.col("v_prev")) / 2.0 * (F.col("t_s") - F.col("t_prev"))
    return with_previous(points, bucket_s, value).groupBy(*SERIES).agg(
        F.coalesce(F.sum(part), F.lit(0.0)).alias("volume"))


def interpolate(points: DataFrame, probes: DataFrame, bucket_s: float = 86_400.0,
                value: str = "q") -> DataFrame:
    """Linear value of each series at each probe time, clamped at both ends.

    Probes and points share buckets; a bucket also gets the last point before it and the first after it, as rows at its
    ends, so no window spans a whole series.  Both neighbours of a probe come from one sort.
    """
    b = lambda df: df.withColumn("_b", F.floor(F.col("t_s") / bucket_s).cast("long"))
    key, pt = [*SERIES, "_b"], F.struct("t_s", F.col(value).alias("v"))
    pts = b(points).select(*key, F.lit(0).alias("_side"), "t_s", F.lit(0).alias("_probe"), pt.alias("_pt"))
    none = F.lit(None).cast(pts.schema["_pt"].dataType).alias("_pt")
    prb = b(probes).select(*key, F.lit(0).alias("_side"), "t_s", F.lit(1).alias("_probe"), none)
    # plain minima, not of structs, so that a bucket is summed up by hash and its rows need no sort
    t, v = F.col("_pt.t_s"), F.col("_pt.v")
    ends = pts.unionByName(prb).groupBy(*key).agg(F.min(t).alias("a"), F.min_by(v, t).alias("va"), F.max(t).alias("z"), F.max_by(v, t).alias("vz"))
    some = lambda at, val: F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("t_s"), F.col(val).alias("v")))
    run = Window.unboundedPreceding
    up = Window.partitionBy(*SERIES).orderBy("_b").rowsBetween(run, -1)
    dn = Window.partitionBy(*SERIES).orderBy(F.col("_b").desc()).rowsBetween(run, -1)
    ends = ends.select(*key, F.last(some("z", "vz"), True).over(up).alias("before"), F.last(some("a", "va"), True).over(dn).alias("after"))
    ends = ends.select(*key, F.explode(F.array(*[F.struct(F.lit(side).alias("_side"), F.col(name).alias("_pt"))
                                                 for side, name in ((-1, "before"), (1, "after"))])).alias("e"))
    ends = ends.select(*key, "e._side", F.lit(None).cast(pts.schema["t_s"].dataType).alias("t_s"), F.lit(0).alias("_probe"), "e._pt")
    order = ["_side", "t_s", "_probe"]
    nxt = F.expr(f"lead(_pt) IGNORE NULLS OVER (PARTITION BY {', '.join(key)} ORDER BY {', '.join(order)})")
    m = pts.unionByName(prb).unionByName(ends.where("_pt IS NOT NULL")).select(
        *key, "t_s", "_probe", F.last("_pt", True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(run, 0)).alias("lo"), nxt.alias("hi"))
    j = m.where("_probe = 1")
    frac = (F.col("t_s") - F.col("lo.t_s")) / (F.col("hi.t_s") - F.col("lo.t_s"))
    out = (F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v"))
            .when(F.col("t_s") == F.col("lo.t_s"), F.col("lo.v"))
            .otherwise(F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * frac))
    return j.select(*SERIES, "t_s", out.alias(value))


def even_probes(points: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced times over each series."""
    span = points.groupBy(*SERIES).agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return span.withColumn("k", k).select(
        *SERIES, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("k") / (n - 1))).alias("t_s"))


def summarise(points: DataFrame, bucket_s: float = 86_400.0) -> DataFrame:
    """Peak, time of (first) peak and released volume of each hydrograph.

    With ``velocity`` and ``ks`` (the submergence factor) at the points, also the peak velocity and the least factor;
    ``drowned`` says that the weir was not free all the time.
    """
    more = []
    if "velocity" in points.columns:
        more.append(F.max("velocity").alias("peak_velocity"))
    if "ks" in points.columns:
        more += [F.min("ks").alias("min_submergence"), (F.min("ks") < 1.0).alias("drowned")]
    head = points.groupBy(*SERIES).agg(
        *more, F.max("q").alias("peak_q"), F.min(F.struct((-F.col("q")).alias("nq"), "t_s")).alias("_p"),
        F.min("t_s").alias("t_first"), F.max("t_s").alias("t_last"))
    return (head.join(trapezoid(points, bucket_s), SERIES)
                .select(*SERIES, "peak_q", F.col("_p.t_s").alias("t_peak"), "t_first", "t_last",
                        F.col("volume").alias("released"), *[c for c in ("peak_velocity", "min_submergence", "drowned") if c in head.columns]))


def mass_balance(summary: DataFrame, storage: DataFrame) -> DataFrame:
    """Released volume against the storage drop and inflow of each run."""
    j = summary.join(storage, "run_id")
    expected = F.col("storage_drop") + F.col("inflow") * F.col("t_last")
    return j.withColumn("mass_balance_rel", F.when(
        expected > 0, F.abs(F.col("released") - expected) / expected).otherwise(0.0)).withColumn(
        "released_fraction", F.col("released") / F.col("gross_storage"))


def peak_band(summary: DataFrame) -> DataFrame:
    """Smallest and largest peak over an ensemble of one scenario's hydrographs."""
    return summary.groupBy("run_id").agg(F.min("peak_q").alias("low"), F.max("peak_q").alias("high"),
                                         F.count("*").alias("members"))


def inflow_weights(cells: DataFrame) -> DataFrame:
    """Normalised weights per inflow; negative weights or a zero sum are errors."""
    tot = cells.groupBy(*SERIES).agg(F.sum("weight").alias("tot"), F.min("weight").alias("least"))
    j = cells.join(tot, SERIES)
    bad = (F.col("least") < 0) | (F.col("tot") <= 0)
    return j.withColumn("weight", F.when(bad, F.raise_error(F.lit("inflow weights must be non-negative "
                        "and sum to more than zero")).cast("double")).otherwise(
                        F.col("weight") / F.col("tot"))).drop("tot", "least")
