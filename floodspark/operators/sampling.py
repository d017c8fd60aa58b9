"""Points against cells: equi-joins on the cell, disc joins, window joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.functions import geodesy, text


def locate(points: DataFrame, transform: list[float], ny, nx, clip: bool = False) -> DataFrame:
    """Adds ``r, c, outside`` for points with ``x, y``; outside points keep no cell unless clipped."""
    cell = geodesy.affine_cell(F.array(*[F.lit(float(t)) for t in transform]), F.col("x"), F.col("y"))
    out = points.withColumn("_p", cell)
    outside = ~(F.col("_p.r").between(0, ny - 1) & F.col("_p.c").between(0, nx - 1))
    if clip:
        r = F.least(F.greatest(F.col("_p.r"), F.lit(0)), F.lit(ny - 1))
        c = F.least(F.greatest(F.col("_p.c"), F.lit(0)), F.lit(nx - 1))
    else:
        r, c = F.when(~outside, F.col("_p.r")), F.when(~outside, F.col("_p.c"))
    return out.withColumn("outside", outside).withColumn("r", r).withColumn("c", c).drop("_p")


def at_cells(points: DataFrame, cells: DataFrame, *columns: str) -> DataFrame:
    """Gather cell columns at each point; a point without a cell keeps NULLs."""
    return points.join(cells.select(*grid.CELL, *columns), grid.CELL, "left")


def settlements_at_risk(located: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per settlement, reached or not, with the sentinels a planner expects."""
    j = at_cells(located, cells, "arrival_min", "new_flood", "max_depth", "max_speed", "defra_class", "band")
    hit = F.coalesce("new_flood", F.lit(False))
    return j.select(
        "run_id", "poi_id", text.settlement_name(F.col("name"), F.col("poi_id")).alias("name"),
        F.when(hit & F.col("arrival_min").isNotNull(), F.bround("arrival_min", 1)).otherwise(-1.0).alias("arr_min"),
        hit.alias("flooded"),
        F.when(hit, F.bround("max_depth", 2)).otherwise(0.0).alias("depth_m"),
        F.when(hit, F.bround("max_speed", 2)).otherwise(0.0).alias("speed_ms"),
        F.when(hit, F.col("defra_class")).otherwise(-1).alias("haz_class"),
        F.when(hit, F.col("band")).otherwise(-1).alias("band"),
        F.col("population").alias("pop"), "outside")


def by_urgency(settlements: DataFrame) -> DataFrame:
    return settlements.orderBy(F.when(F.col("arr_min") < 0, F.lit(float("inf"))).otherwise(F.col("arr_min")),
                               "run_id", "name")


def resort(settlements: DataFrame, by: str = "arrival", ascending: bool = True) -> DataFrame:
    """Order of the display table; 'not reached' counts as 99999 minutes."""
    key = {"arrival": F.when(F.col("arr_min") == -1, 99999.0).otherwise(F.col("arr_min")),
           "depth": F.col("depth_m"), "name": F.col("name")}[by]
    return settlements.orderBy(key.asc() if ascending else key.desc(), "run_id", "poi_id")


def time_slices(settlements: DataFrame, minutes: int, step: int) -> DataFrame:
    """Settlements wetted at each minute mark of the scrubber."""
    marks = F.explode(F.sequence(F.lit(0), F.lit(minutes), F.lit(step)))
    return settlements.withColumn("minute", marks).where(
        (F.col("arr_min") != -1) & (F.col("minute") >= F.col("arr_min")))


def by_label(points: DataFrame, value: str, labels: tuple[str, ...], suffix: str = "") -> DataFrame:
    """A row per run with the ``value`` of each label in a column of its own, NULL where there is none."""
    wide = points.groupBy("run_id").pivot("label", list(labels)).agg(F.max(value))
    return wide.select("run_id", *[F.col(c).alias(f"{c.lower()}{suffix}") for c in labels])


def wetted_by(cells: DataFrame, minutes: int, step: int) -> DataFrame:
    """Cells of each run reached at each minute mark: ``run_id, minute, wetted`` (running sums over the marks)."""
    arrival = F.col("arrival_s") / 60.0
    first = (F.ceil(F.greatest(arrival, F.lit(0.0)) / step) * step).cast("int")
    fresh = cells.where(arrival <= minutes).groupBy("run_id", first.alias("minute")).agg(F.count("*").alias("n"))
    marks = cells.select("run_id").distinct().withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(minutes), F.lit(step))))
    w = Window.partitionBy("run_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return marks.join(fresh, ["run_id", "minute"], "left").select(
        "run_id", "minute", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("wetted"))


def disc_join(points: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float,
              max_radius: float) -> DataFrame:
    """Cells whose centre lies within each point's ``radius_m`` (at most ``max_radius``).

    Offsets around the nearest cell turn the range condition into an equi-join; the
    exact distance is checked afterwards.
    """
    k = int(-(-max_radius // dx))
    base = (points.withColumn("r", F.bround((F.col("y") - y0) / dx, 0).cast("int"))
                  .withColumn("c", F.bround((F.col("x") - x0) / dx, 0).cast("int")))
    near = grid.spread_box(base, k).hint("merge").join(cells, grid.CELL)  # many times the points: never broadcast
    ex, ey = x0 + dx * F.col("c") - F.col("x"), y0 + dx * F.col("r") - F.col("y")
    return near.where(ex * ex + ey * ey <= F.col("radius_m") * F.col("radius_m"))


def sample_observations(obs: DataFrame, cells: DataFrame, x0: float, y0: float, dx: float,
                        bank_radius: float = 30.0, channel_radius: float = 0.0,
                        threshold: float = fixed.WET_THRESHOLD_M) -> DataFrame:
    """Modelled water level and arrival at every observation; dry points stay, with NULLs."""
    radius = F.greatest(F.when(F.col("kind") == "gauge", channel_radius).otherwise(bank_radius),
                        F.lit(dx * 0.5))
    near = disc_join(obs.withColumn("radius_m", radius),
                     cells.select(*grid.CELL, "z", "max_depth", "arrival_s"), x0, y0, dx,
                     max(bank_radius, channel_radius, dx * 0.5))
    got = near.groupBy("run_id", "name").agg(
        F.max(F.when(F.col("max_depth") > threshold, F.col("z") + F.col("max_depth"))).alias("mod_ws"),
        F.min("arrival_s").alias("mod_at"))
    return obs.join(got, ["run_id", "name"], "left").withColumn(
        "mod_ws", F.when(F.col("ws_obs_m").isNotNull(), F.col("mod_ws"))).withColumn(
        "mod_at", F.when(F.col("at_obs_s").isNotNull(), F.col("mod_at"))).withColumn(
        "ws_err", F.col("mod_ws") - F.col("ws_obs_m")).withColumn(
        "at_err", F.col("mod_at") - F.col("at_obs_s"))


def window_join(points: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """Cells in the square of half-width ``radius`` around each point's own cell."""
    base = points.withColumnRenamed("r", "pr").withColumnRenamed("c", "pc")
    base = base.withColumn("r", F.col("pr")).withColumn("c", F.col("pc"))
    return grid.spread_box(base, radius).hint("merge").join(cells, grid.CELL)


def error_norms(errors: DataFrame, keys: list[str], err: str) -> DataFrame:
    e = F.col(err)
    return errors.groupBy(*keys).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("l1"), F.sqrt(F.avg(e * e)).alias("l2"),
        F.max(F.abs(e)).alias("linf"), F.avg(e).alias("bias"))


def validation_score(sampled: DataFrame) -> DataFrame:
    """Water-level and arrival errors per run, dry points, transformer times against A."""
    gauge = F.when(F.col("kind") == "gauge", F.col("at_err"))
    ws = F.col("ws_err")
    def tf(name):
        return F.max(F.when((F.col("kind") == "transformer") & (F.col("label") == name), F.col("mod_at")))
    out = sampled.groupBy("run_id").agg(
        F.count(ws).alias("ws_n"), F.avg(F.abs(ws)).alias("ws_l1"), F.sqrt(F.avg(ws * ws)).alias("ws_l2"),
        F.max(F.abs(ws)).alias("ws_linf"), F.avg(ws).alias("ws_bias"),
        F.count(gauge).alias("at_n"), F.avg(F.abs(gauge)).alias("at_l1"),
        F.count("*").alias("points"),
        F.count_if(F.col("ws_obs_m").isNotNull() & F.col("mod_ws").isNull()).alias("dry_in_model"),
        tf("A").alias("_a"), *[tf(k).alias(f"_{k.lower()}") for k in fixed.TRANSFORMER_REL_S])
    for k, rel in fixed.TRANSFORMER_REL_S.items():
        out = out.withColumn(f"rel_err_{k.lower()}_s", F.col(f"_{k.lower()}") - F.col("_a") - rel)
    return out.drop("_a", *[f"_{k.lower()}" for k in fixed.TRANSFORMER_REL_S])
