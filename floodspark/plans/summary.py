"""The summary record of a run: headline, tables, caveats and the release gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark import fixed
from floodspark.functions import arrival, damage, text


def stage_caveats(figures: DataFrame, dx: float, threshold: float = fixed.WET_THRESHOLD_M,
                  vintage: int = 2020, year: int = 2026) -> DataFrame:
    """Standing caveats of every stage and those a run's own figures call for.

    ``run_id, stage, pos, text``; a text without cause is NULL and is dropped.
    """
    fixed_texts = [
        (0, 0, f"Hazard is an average over {dx:.0f} m cells ({dx * dx / 1e4:.2f} ha), not over single buildings."),
        (0, 1, f"Water shallower than {threshold:.2f} m is reported as dry."),
        (1, 0, f"Arrival is the first moment depth reaches {threshold:.2f} m in a {dx:.0f} m cell."),
        (1, 1, "Arrival time is not warning time."),
        (1, 2, "Arrival is reported in bands; its uncertainty exceeds single minutes."),
        (2, 0, f"Population is a modelled surface of {vintage}, {year - vintage} years old, not a count."),
        (2, 1, "Populations are reported to two significant figures."),
        (2, 2, "Population is where people sleep, not where they work or travel."),
        (3, 0, "Damage is an order-of-magnitude range, not an assessment."),
        (3, 1, "Depth-damage curves ignore velocity; structural failure is counted separately."),
    ]
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(p).alias("pos"), F.lit(t).alias("text")) for s, p, t in fixed_texts]
    own = [
        (1, 3, F.when(F.col("never_cells") > 0, F.format_string(
            "%d cells had not flooded by the end of the run; near the outlet that may mean not yet.",
            F.col("never_cells")))),
        (4, 0, F.when(F.col("interpolated_cells") > 0, F.concat(
            F.col("interpolated_cells").cast("string"), F.lit(" flooded cells ("), text.digits(F.col("interpolated_pct"), 1),
            F.lit("%) lie on terrain interpolated across voids.")))),
    ]
    rows += [F.struct(F.lit(s).alias("stage"), F.lit(p).alias("pos"), t.alias("text")) for s, p, t in own]
    return figures.select("run_id", F.explode(F.array(*rows)).alias("x")).select("run_id", "x.*").where(
        F.col("text").isNotNull())


def run_caveats(runs: DataFrame, dx: float) -> DataFrame:
    """Caveats that a run's boundary, mass balance, breach and pool call for: ``run_id, stage, pos, text``.

    ``runs`` has ``volume_error, open_edges, edge_cells`` and, NULL where a run has none, ``min_submergence,
    released_fraction, pool_km2, published_km2, pool_at_edge``.
    """
    error, left = F.col("volume_error"), F.col("open_edges")
    away = text.scientific(error, 2, plus=True)
    texts = [
        (1, 4, F.when(left, F.concat(
            F.lit("Cells within "), F.col("edge_cells").cast("string"), F.lit(" of an open edge ("),
            text.digits(F.col("edge_cells") * dx / 1000.0, 1), F.lit(" km) follow the outflow condition and are not quotable.")))),
        (4, 1, F.when((error < -1e-6) & left, F.concat(
            text.digits(-error * 100.0, 1), F.lit("% of the water left through the open edge (relative change "), away,
            F.lit("): outflow, not a conservation error.")))
         .when(F.abs(error) > 1e-6, F.concat(F.lit("Relative mass error "), away,
                                             F.lit("; above 1e-6 it needs looking into before the result is used.")))),
        (5, 0, F.when(F.col("min_submergence") < 1.0, F.concat(
            F.lit("The weir was drowned (least factor "), text.digits(F.col("min_submergence"), 3),
            F.lit("): outflow was not free throughout.")))),
        (5, 1, F.when(F.col("released_fraction") > 1.02, F.concat(
            F.lit("The breach released "), text.digits(F.col("released_fraction"), 2),
            F.lit(" times the storage: the storage model does not hold.")))),
        (6, 0, F.when(F.col("pool_km2") > 1.05 * F.col("published_km2"), F.concat(
            F.lit("The pool covers "), text.digits(F.col("pool_km2"), 2), F.lit(" km2, the published reservoir "),
            text.digits(F.col("published_km2"), 2), F.lit(" km2.")))),
        (6, 1, F.when(F.col("pool_at_edge"), "The pool reaches the edge of the grid and may be cut off.")),
    ]
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(k).alias("pos"), t.alias("text")) for s, k, t in texts]
    return runs.select("run_id", F.explode(F.array(*rows)).alias("x")).select("run_id", "x.*").where(F.col("text").isNotNull())


def ordered_distinct(caveats: DataFrame) -> DataFrame:
    """Each text once per run, in order of first appearance."""
    first = caveats.groupBy("run_id", "text").agg(F.min(F.struct("stage", "pos")).alias("at"))
    return first.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("limitations"))


def release_gate(runs: DataFrame) -> DataFrame:
    """Reasons not to present a run as fact; none means it may be.

    Needs ``unverified_n, has_damage, volume_error, open_edges, residual, conserved``.
    """
    e = F.col("volume_error")
    reasons = F.array_compact(F.array(
        F.when(F.col("unverified_n") > 0, F.format_string("%d unverified citation(s)", F.col("unverified_n"))),
        F.when(F.col("has_damage"), "damage is order-of-magnitude only"),
        F.when(e > 1e-6, "mass conservation: spurious gain")
         .when((e < -1e-6) & ~F.col("open_edges"), "mass conservation: loss on a walled domain"),
        F.when(~F.coalesce("conserved", F.lit(True)), "population resampling did not conserve totals")))
    return runs.withColumn("reasons", reasons).withColumn("presentable", F.size("reasons") == 0)


def scenario_summary(figures: DataFrame, totals: DataFrame, hazard_area: DataFrame, band_area: DataFrame,
                     caveats: DataFrame, gate: DataFrame) -> DataFrame:
    """One nested row per run, built from aggregates that already have one row per run."""
    def as_map(t, name):
        pair = F.array_sort(F.collect_list(F.struct("idx", F.struct("label", "km2").alias("kv"))))
        return t.groupBy("run_id").agg(F.map_from_entries(F.transform(pair, lambda x: x["kv"])).alias(name))
    j = (figures.join(totals.select("run_id", "total"), "run_id", "left")
                .join(as_map(hazard_area, "area_by_hazard_km2"), "run_id", "left")
                .join(as_map(band_area, "area_by_band_km2"), "run_id", "left")
                .join(ordered_distinct(caveats), "run_id", "left")
                .join(gate.select("run_id", "presentable", "reasons"), "run_id", "left"))
    people = text.two_figures(F.coalesce("total", F.lit(0.0)))
    return j.select(
        "run_id",
        text.headline(F.lit("dam break"), F.concat(F.lit("run "), F.col("run_id").cast("string")),
                      F.col("new_km2"), F.col("first_arrival_min"), people).alias("headline"),
        F.struct(F.col("new_km2").alias("flooded_area_km2"), F.col("wetted_km2").alias("total_wetted_area_km2"),
                 "peak_depth_m", "peak_speed_ms", "near_depth_m", "near_speed_ms", "first_arrival_min",
                 "last_arrival_min", "area_by_hazard_km2", "area_by_band_km2", "interpolated_cells",
                 F.col("total").alias("total_population"), people.alias("reported_population")).alias("results"),
        F.struct(F.col("presentable").alias("presentable_as_fact"), F.col("reasons").alias("blocking_reasons"),
                 "limitations").alias("honesty"))


def full_record(summary: DataFrame, grids: DataFrame, runs: DataFrame, terrain: DataFrame, breach: DataFrame,
                exposure: DataFrame, damage_: DataFrame) -> DataFrame:
    """The whole record of a run: the summary with ``grid, run, provenance`` and, in its results, exposure and damage.

    Each part has a row per run, or none: its struct is then NULL.  ``grids`` has ``ny, nx, dx_m, crs, transform``,
    ``runs`` ``duration_s, steps, wall_time_s, volume_error, solver``; the other parts are taken as they are.
    """
    def nested(df, name):
        return df.select("run_id", F.struct(*[c for c in df.columns if c != "run_id"]).alias(name))

    shape = grids.select("run_id", F.array("ny", "nx").alias("shape"), "dx_m", "crs", "transform")
    j = summary
    for df, name in ((shape, "grid"), (runs, "run"), (terrain, "_terrain"), (breach, "_breach"), (exposure, "_exposure"),
                     (damage_, "_damage")):
        j = j.join(nested(df, name), "run_id", "left")
    return j.select("run_id", "headline", "grid", "run",
                    F.struct("results.*", F.col("_exposure").alias("exposure"), F.col("_damage").alias("damage")).alias("results"),
                    F.struct(F.col("_terrain").alias("terrain"), F.col("_breach").alias("breach")).alias("provenance"), "honesty")


def run_rows(record: DataFrame) -> DataFrame:
    """The run table of the report: ``run_id, pos, quantity, value``, in the order of ``pos``."""
    def figure(c, unit="", digits=2):
        return F.concat(F.format_number(F.col(c), digits), F.lit(unit))

    def minutes(c):
        return F.coalesce(F.concat(F.format_number(F.bround(c, 0), 0), F.lit(" min")), F.lit("not reached"))

    rows = [
        ("Newly inundated area", figure("results.flooded_area_km2", " km²")),
        ("Total wetted area (incl. reservoir)", figure("results.total_wetted_area_km2", " km²")),
        ("Peak depth", figure("results.peak_depth_m", " m")),
        ("Peak speed", figure("results.peak_speed_ms", " m/s")),
        ("First arrival outside pre-existing water", minutes("results.first_arrival_min")),
        ("Last arrival", minutes("results.last_arrival_min")),
        ("Grid", F.format_string("%d × %d cells at %s m", F.col("grid.shape")[1], F.col("grid.shape")[0], text.compact(F.col("grid.dx_m")))),
        ("Simulated duration", F.concat(text.digits(F.col("run.duration_s") / 3600.0, 2), F.lit(" h ("), F.format_number("run.steps", 0), F.lit(" steps)"))),
        ("Wall-clock time", F.concat(text.digits(F.col("run.wall_time_s"), 1), F.lit(" s"))),
        ("Mass conservation error", F.concat(text.scientific(F.col("run.volume_error"), 2, plus=True), F.lit(" (relative)"))),
        ("Flooded cells over interpolated DEM voids", F.format_number("results.interpolated_cells", 0)),
    ]
    listed = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(q).alias("quantity"), v.alias("value")) for k, (q, v) in enumerate(rows)])
    return record.select("run_id", F.explode(listed).alias("x")).select("run_id", "x.*")


def infrastructure_rows(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Features and lengths in the flood, ``run_id, feature, n`` and ``run_id, feature, km``, as report rows."""
    def named(c):
        return F.translate(c, "_", " ").alias("feature")
    return counts.select("run_id", named("feature"), F.format_number("n", 0).alias("value")).unionByName(
        lengths.select("run_id", named("feature"), F.format_number("km", 1).alias("value")))


def run_scalars(summary: DataFrame) -> DataFrame:
    """What a run list shows of each summary."""
    p = F.col("results.reported_population")
    return summary.select("run_id", "headline", F.col("honesty.presentable_as_fact").alias("presentable"),
                          text.finite(F.col("results.peak_depth_m")).alias("peak_depth_m"),
                          text.finite(F.col("results.flooded_area_km2")).alias("flooded_area_km2"),
                          text.finite(F.col("results.first_arrival_min")).alias("first_arrival_min"),
                          F.coalesce(F.when(p != 0, p.cast("double")), F.col("results.total_population"))
                          .alias("exposed_people"))


def arrival_rows(areas: DataFrame, people: DataFrame) -> DataFrame:
    """Band table of the report; empty bands keep their row."""
    p = people.select("run_id", "idx", "people")
    return areas.join(p, ["run_id", "idx"], "left").select(
        "run_id", "idx", F.col("label").alias("band"), F.format_number("km2", 2).alias("area"),
        F.coalesce(F.format_number(text.two_figures(F.col("people")), 0), F.lit("—")).alias("people"),
        arrival.evacuation_action(F.col("idx")).alias("action"))


def hazard_rows(people: DataFrame) -> DataFrame:
    meaning = F.array(*[F.lit(t) for t in fixed.HAZARD_MEANING])
    return people.select("run_id", "idx", F.col("label").alias("hazard"),
                         F.format_number(text.two_figures(F.col("people")), 0).alias("people"),
                         F.try_element_at(meaning, F.col("idx") + 1).alias("meaning"))


def with_total(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Append the TOTAL row of each run."""
    t = people.groupBy("run_id").agg(F.sum("people").alias("p"))
    return rows.unionByName(t.select("run_id", F.lit(99).alias("idx"), F.lit("Total").alias("band"),
                                     F.lit("—").alias("area"), F.format_number(text.two_figures(F.col("p")), 0).alias("people"),
                                     F.lit("—").alias("action")))


def damage_rows(categories: DataFrame, totals: DataFrame) -> DataFrame:
    both = categories.select("run_id", "category", "low", "central", "high").unionByName(
        totals.select("run_id", F.lit("TOTAL").alias("category"), "low", "central", "high"))
    def cr(c):
        return F.concat(F.lit("₹"), F.format_number(damage.in_crore(F.col(c)), 1), F.lit(" cr")).alias(c)
    return both.select("run_id", "category", cr("low"), cr("central"), cr("high"))
