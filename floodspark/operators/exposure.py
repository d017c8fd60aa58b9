"""Area, population and damage tables over classes and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import fixed
from floodspark.functions import arrival, damage, hazard
from floodspark.operators.quantiles import exact_quantiles


def _complete(sums: DataFrame, value: str, zero, *dims: tuple[str, list[str]]) -> DataFrame:
    """Every run with every class, missing combinations at ``zero``.

    The few sums of a run become one map, and the fixed classes are exploded against
    it: the cells behind ``sums`` are read once, where a left join from a distinct
    list of runs would read them twice.
    """
    names = [d for d, _ in dims]
    key = F.concat_ws("/", *[F.col(n).cast("string") for n in names])
    per_run = sums.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct(key, F.col(value)))).alias("_m"))
    for name, labels in dims:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(labels)])
        per_run = per_run.withColumn("_x", F.explode(pairs)).withColumn(name, F.col("_x.i")).withColumn(
            f"{name}_label", F.col("_x.t")).drop("_x")
    return per_run.withColumn(value, F.coalesce(F.try_element_at("_m", key), F.lit(zero))).drop("_m")


def area_by_class(cells: DataFrame, column: str, names, dx: float) -> DataFrame:
    n = cells.groupBy("run_id", F.col(column).alias("idx")).agg(F.count("*").alias("n"))
    return _complete(n, "n", 0, ("idx", names)).select(
        "run_id", "idx", F.col("idx_label").alias("label"), (F.col("n") * (dx * dx / 1e6)).alias("km2"))


def population_by_class(cells: DataFrame, column: str, names) -> DataFrame:
    """Sentinels are not in ``names``, so they are never summed."""
    p = cells.groupBy("run_id", F.col(column).alias("idx")).agg(F.sum("pop").alias("people"))
    return _complete(p, "people", 0.0, ("idx", names)).select(
        "run_id", "idx", F.col("idx_label").alias("label"), "people")


def exposed(cells: DataFrame) -> DataFrame:
    """One mask for every table: hazard-wet, arrival-wet and not water before."""
    wet = F.col("new_flood") & F.col("newly_flooded")
    return (cells.withColumn("disagree", F.col("new_flood") != F.col("newly_flooded"))
                 .withColumn("exposed", wet)
                 .withColumn("people", F.when(wet, F.coalesce("pop", F.lit(0.0))).otherwise(0.0))
                 .withColumn("h", F.when(wet, F.col("defra_class")).otherwise(-1))
                 .withColumn("b", F.when(wet, F.col("band")).otherwise(-1)))


def cross_tab(cells: DataFrame) -> DataFrame:
    """People by run, hazard class and arrival band, every combination present."""
    sums = exposed(cells).groupBy("run_id", "h", "b").agg(F.sum("people").alias("people"))
    return _complete(sums, "people", 0.0, ("h", fixed.HAZARD_NAMES), ("b", arrival.band_labels())).select(
        "run_id", "h", "b", F.col("h_label").alias("hazard"), F.col("b_label").alias("arrival_band"), "people")


def cross_tab_matrix(cells: DataFrame) -> DataFrame:
    """The same table with one column per arrival band."""
    t = cross_tab(cells)
    return t.groupBy("run_id", "hazard").pivot("arrival_band", arrival.band_labels()).agg(F.first("people"))


def exposure_cube(cells: DataFrame) -> DataFrame:
    """Total, both margins and the cross-tab from one pass (``level`` tells which).

    The cells are summed per class pair first; the cube then runs over at most a few
    dozen rows per run.
    """
    sums = exposed(cells).groupBy("run_id", "h", "b").agg(F.sum("people").alias("p"))
    c = sums.groupingSets([["run_id", "h", "b"], ["run_id", "h"], ["run_id", "b"], ["run_id"]],
                          "run_id", "h", "b").agg(F.sum("p").alias("people"),
                                                  F.grouping_id().cast("int").alias("g"))
    level = (F.when(F.col("g") == 0, "cross_tab").when(F.col("g") == 1, "by_hazard")
              .when(F.col("g") == 2, "by_band").otherwise("total"))
    return c.withColumn("level", level).drop("g")


def exposure_totals(cells: DataFrame) -> DataFrame:
    """Per run: exposed people, disagreeing cells, and proof that all margins agree.

    The total sums every cell, the margins only named classes.  A mismatch raises: it
    can only be a defect of the tabulation.
    """
    pair = exposed(cells).groupBy("run_id", "h", "b").agg(
        F.sum("people").alias("p"), F.count_if("disagree").alias("d"), F.count_if("exposed").alias("e"))
    hz, bd = F.col("h") >= 0, F.col("b") >= 0
    part = lambda m: F.coalesce(F.sum(F.when(m, F.col("p"))), F.lit(0.0))
    t = pair.groupBy("run_id").agg(F.sum("p").alias("total"), part(hz).alias("by_hazard"), part(bd).alias("by_band"),
                                   part(hz & bd).alias("cross_tab"), F.sum("d").alias("disagreeing_cells"),
                                   F.sum("e").alias("exposed_cells"))
    tol = F.greatest(F.lit(1e-6), 1e-9 * F.greatest(F.col("total"), F.lit(1.0)))
    off = F.greatest(*[F.abs(F.col(k) - F.col("total")) for k in ("by_hazard", "by_band", "cross_tab")])
    checked = F.when(off > tol, F.raise_error(F.lit("exposure tables disagree")).cast("double"))
    return t.withColumn("total", F.coalesce(checked, F.col("total")))


# --- damage ---------------------------------------------------------------------------------

def _range(central: Column) -> list[Column]:
    r = damage.around(central)
    return [r["central"].alias("central"), r["low"].alias("low"), r["high"].alias("high"),
            r["unit"].alias("unit")]


def _exact_sum(fraction: Column) -> Column:
    """Sum of fractions to twelve decimals each, the same in whatever order the rows come."""
    return F.sum(fraction.cast("decimal(18,12)")).cast("double")


def building_damage(at: DataFrame) -> DataFrame:
    """Per run and curve, from buildings already joined to the depth of their own cell."""
    value = {"residential": "residential_building", "commercial": "commercial_building",
             "industrial": "industrial_building"}
    price = F.create_map(*[F.lit(x) for k, v in value.items() for x in (k, fixed.ASSET_VALUE_INR[v])])
    frac = damage.damage_fraction_of(F.coalesce("max_depth", F.lit(0.0)), F.col("curve"))
    s = at.groupBy("run_id", F.col("curve").alias("category")).agg(_exact_sum(frac).alias("f"))
    return s.select("run_id", "category", *_range(F.col("f") * F.try_element_at(price, F.col("category"))))


def land_damage(cells: DataFrame, dx: float, mask: Column | None = None) -> DataFrame:
    """Agricultural loss over new flooding (the default mask), integrated cell by cell."""
    mask = F.col("new_flood") if mask is None else mask
    frac = F.when(mask, damage.damage_fraction(F.col("max_depth"), "agriculture")).otherwise(0.0)
    hectares, price = dx * dx / 10_000.0, fixed.ASSET_VALUE_INR["agriculture_hectare"]
    return (cells.groupBy("run_id").agg(_exact_sum(frac).alias("f"))
                 .select("run_id", F.lit("agriculture / land").alias("category"), *_range(F.col("f") * hectares * price)))


def road_damage(lengths: DataFrame) -> DataFrame:
    k = fixed.ASSET_VALUE_INR["road_km"] * fixed.ROAD_FRACTION
    return lengths.select("run_id", F.lit("roads").alias("category"), *_range(F.col("km") * k))


def total_damage(categories: DataFrame) -> DataFrame:
    """Component-wise sums; mixing units is refused."""
    one = F.when(F.count_distinct("unit") > 1,
                 F.raise_error(F.lit("damage categories have different units"))).otherwise(F.max("unit"))
    return categories.groupBy("run_id").agg(F.sum("central").alias("central"), F.sum("low").alias("low"),
                                            F.sum("high").alias("high"), one.alias("unit"))


def structural_failure(cells: DataFrame, buildings: DataFrame) -> DataFrame:
    """Cells, people and buildings in AIDR H5 and H6, each counted as what it is."""
    bad = F.col("aidr_class") >= fixed.STRUCTURAL_AIDR_CLASS
    c = cells.groupBy("run_id").agg(
        F.count_if(bad).alias("cells"),
        F.coalesce(F.sum(F.when(bad, F.col("pop"))), F.lit(0.0)).alias("people"))
    b = buildings.groupBy("run_id").agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("buildings"))
    return c.join(b, "run_id", "left").withColumn("buildings", F.coalesce("buildings", F.lit(0)))


# --- headline numbers ---------------------------------------------------------------------------

def run_figures(cells: DataFrame, dx: float) -> DataFrame:
    """Areas, arrivals, peaks and interpolated share of every run in one aggregation.

    Needs the masks plus ``reportable`` (NULL = everything) and ``valid``.
    """
    km2 = dx * dx / 1e6
    ok = F.coalesce("reportable", F.lit(True))
    quote, near = F.col("flood") & ok, F.col("flood") & ~ok
    new_min = F.when(F.col("newly_flooded"), F.col("arrival_min"))
    voids = F.count_if(F.col("flood") & ~F.coalesce("valid", F.lit(True)))

    def peak(mask, col):
        return F.coalesce(F.max(F.when(mask, F.col(col))), F.lit(0.0))

    return cells.groupBy("run_id").agg(
        F.count_if("flood").alias("flooded_cells"),
        (F.count_if("flood") * km2).alias("wetted_km2"),
        (F.count_if("new_flood") * km2).alias("new_km2"),
        F.min(new_min).alias("first_arrival_min"), F.max(new_min).alias("last_arrival_min"),
        peak(quote, "max_depth").alias("peak_depth_m"), peak(quote, "max_speed").alias("peak_speed_ms"),
        peak(near, "max_depth").alias("near_depth_m"), peak(near, "max_speed").alias("near_speed_ms"),
        voids.alias("interpolated_cells"),
        (100.0 * voids / F.greatest(F.lit(1), F.count_if("flood"))).alias("interpolated_pct"),
        F.count_if(F.col("arrival_s").isNull()).alias("never_cells"))


def near_field(cells: DataFrame, radii: tuple[int, ...], dx: float, value: str = "max_depth") -> DataFrame:
    """Per run and radius (in cells from the source, ``d2`` squared): the peak beyond it, and what it excludes."""
    r = F.explode(F.array(*[F.lit(v) for v in radii]))
    far = F.col("d2") > F.col("radius") * F.col("radius")
    return cells.withColumn("radius", r).groupBy("run_id", "radius").agg(
        F.coalesce(F.max(F.when(far, F.col(value))), F.lit(0.0)).alias("peak_beyond"),
        F.count_if(~far).alias("excluded"), (F.count_if(~far) * dx * dx / 1e6).alias("excluded_km2"))


def far_field(cells: DataFrame, radius: int, value: str = "max_depth") -> DataFrame:
    """Cells, median, 95th percentile and peak of each run beyond ``radius`` cells from the source."""
    far = cells.where(F.col("d2") > radius * radius)
    q = exact_quantiles(far, ["run_id"], value, [0.5, 0.95]).groupBy("run_id").agg(
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    return far.groupBy("run_id").agg(F.count("*").alias("cells"), F.max(value).alias("peak")).join(q, "run_id")


def enrich(cells: DataFrame, population: DataFrame | None = None, landcover="urban") -> DataFrame:
    out = hazard.flood_masks(arrival.add_arrival(hazard.classify(cells, landcover)))
    if population is not None:
        keys = [k for k in ("run_id", "r", "c") if k in population.columns]
        out = out.join(population, keys, "left").withColumn("pop", F.coalesce("pop", F.lit(0.0)))
    return out
