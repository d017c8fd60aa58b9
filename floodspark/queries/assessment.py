"""Field maxima, hazard, arrival, exposure, damage and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.functions import arrival as fa
from floodspark.functions import damage as fd
from floodspark.functions import hazard as fh
from floodspark.functions import text as ft
from floodspark.operators import accumulate, exposure, masks, resample, sampling, series, terrain, vectors
from floodspark.plans import summary as ps
from floodspark.queries.base import DERIVED, cells, enriched, query, rounded
from floodspark.queries.series import _breached
from floodspark.queries.terrain import FINE, FOOTPRINT, POOL_SQL, _dams, _people, _POP, _sizes, _terraced, _to_target
from floodspark.sinks import bands
from floodspark.session import cut, scratch_path
from floodspark.sources.tables import DX, NX, NY, TRANSFORM, view

KM2 = "0.0081"


@query("agg1_field_accumulator", "AGG1 FN8", """
    SELECT run_id, r, c, max_depth, round(max_speed, 6) AS max_speed, round(max_dv, 6) AS max_dv, arrival_s
    FROM cells""", ("cells",))
def _(s, d):
    return rounded(accumulate.field_accumulator(view(s, d, "frames")))


@query("hazard_and_arrival_classes", "FN1 FN2 FN3 FN4 FN5 PRJ1", """
    SELECT run_id, r, c, dry, round(rating, 6) AS rating, defra_class, aidr_class, round(arrival_min, 6) AS arrival_min,
           band, flood, new_flood, newly_flooded FROM cells_h""", ("cells_h",))
def _(s, d):
    return rounded(enriched(s, d).select("run_id", "r", "c", "dry", "rating", "defra_class", "aidr_class",
                                         "arrival_min", "band", "flood", "new_flood", "newly_flooded"))


@query("fn1_debris_factor_by_landcover", "FN1", """
    SELECT r, c, run_id, lc, CASE WHEN max_depth >= 0.75 OR max_speed > 2 THEN [0.5, 1.0, 1.0][lc + 1]
           WHEN max_depth >= 0.25 THEN [0.0, 0.5, 1.0][lc + 1] ELSE 0.0 END AS df
    FROM (SELECT *, CAST((r + c) % 3 AS INT) AS lc FROM cells)""", ("cells",))
def _(s, d):
    x = cells(s, d).withColumn("lc", ((F.col("r") + F.col("c")) % 3).cast("int"))
    return x.select("r", "c", "run_id", "lc",
                    fh.debris_factor(F.col("max_depth"), F.col("max_speed"), F.col("lc")).alias("df"))


@query("people_by_hazard_and_arrival", "AGG6 AGG7 JN1 SET3 SET4", """
    SELECT run.run_id, hz.idx AS h, bd.idx AS b, hz.label AS hazard, bd.label AS arrival_band,
           round(coalesce(p, 0.0), 4) AS people
    FROM runs run CROSS JOIN hz CROSS JOIN bd LEFT JOIN (
      SELECT run_id, defra_class, band, sum(pop) AS p FROM cells_h WHERE new_flood AND newly_flooded GROUP BY ALL) x
      ON x.run_id = run.run_id AND x.defra_class = hz.idx AND x.band = bd.idx""", ("cells_h", "runs", "hz", "bd"))
def _(s, d):
    return rounded(exposure.cross_tab(enriched(s, d)), 4)


_MATRIX = ", ".join(f"round(coalesce(sum(CASE WHEN x.band = {i} THEN x.pop END), 0), 4) AS \"{t}\"" for i, t in enumerate(fa.band_labels()))


@query("agg6_cross_tab_matrix", "AGG6", f"""
    SELECT runs.run_id, label AS hazard, {_MATRIX} FROM runs CROSS JOIN hz LEFT JOIN cells_h x
      ON x.run_id = runs.run_id AND x.defra_class = hz.idx AND x.new_flood AND x.newly_flooded
    GROUP BY runs.run_id, label""", ("cells_h", "runs", "hz"))
def _(s, d):
    return rounded(exposure.cross_tab_matrix(enriched(s, d)), 4)


@query("agg7_exposure_cube", "AGG7", """
    SELECT run_id, h, b, round(sum(p), 4) AS people,
           CASE grouping(h) * 2 + grouping(b) WHEN 0 THEN 'cross_tab' WHEN 1 THEN 'by_hazard' WHEN 2 THEN 'by_band'
           ELSE 'total' END AS level
    FROM (SELECT run_id, CASE WHEN e THEN defra_class ELSE -1 END AS h, CASE WHEN e THEN band ELSE -1 END AS b,
                 CASE WHEN e THEN pop ELSE 0 END AS p
          FROM (SELECT *, new_flood AND newly_flooded AS e FROM cells_h))
    GROUP BY GROUPING SETS ((run_id, h, b), (run_id, h), (run_id, b), (run_id))""", ("cells_h",))
def _(s, d):
    return rounded(exposure.exposure_cube(enriched(s, d)), 4)


@query("agg7_exposure_totals_checked", "AGG7 SET3", """
    SELECT run_id, round(sum(CASE WHEN e THEN pop ELSE 0 END), 4) AS total,
           count(*) FILTER (WHERE new_flood <> newly_flooded) AS disagreeing_cells, count(*) FILTER (WHERE e) AS exposed_cells
    FROM (SELECT *, new_flood AND newly_flooded AS e FROM cells_h) GROUP BY run_id""", ("cells_h",))
def _(s, d):
    return rounded(exposure.exposure_totals(enriched(s, d)).select(
        "run_id", "total", "disagreeing_cells", "exposed_cells"), 4)


def _area(col, dim):
    return f"""SELECT runs.run_id, {dim}.idx, {dim}.label, round(count(x.run_id) * {KM2}, 6) AS km2
        FROM runs CROSS JOIN {dim} LEFT JOIN cells_h x ON x.run_id = runs.run_id AND x.{col} = {dim}.idx
        GROUP BY 1, 2, 3"""


@query("agg2_area_by_hazard", "AGG2", _area("defra_class", "hz"), ("cells_h", "runs", "hz"))
def _(s, d):
    return rounded(exposure.area_by_class(enriched(s, d), "defra_class", fixed.HAZARD_NAMES, DX))


@query("agg2_area_by_aidr", "AGG2", _area("aidr_class", "aidr"), ("cells_h", "runs", "aidr"))
def _(s, d):
    return rounded(exposure.area_by_class(enriched(s, d), "aidr_class", fixed.AIDR_NAMES, DX))


@query("agg2_area_by_band", "AGG2", _area("band", "bd"), ("cells_h", "runs", "bd"))
def _(s, d):
    return rounded(exposure.area_by_class(enriched(s, d), "band", fa.band_labels(), DX))


@query("agg5_population_by_hazard", "AGG5", """
    SELECT runs.run_id, hz.idx, hz.label, round(coalesce(sum(x.pop), 0), 4) AS people
    FROM runs CROSS JOIN hz LEFT JOIN cells_h x ON x.run_id = runs.run_id AND x.defra_class = hz.idx
    GROUP BY 1, 2, 3""", ("cells_h", "runs", "hz"))
def _(s, d):
    return rounded(exposure.population_by_class(enriched(s, d), "defra_class", fixed.HAZARD_NAMES), 4)


FIGURES_SQL = """
    SELECT run_id, count(*) FILTER (WHERE flood) AS flooded_cells, round(count(*) FILTER (WHERE flood) * 0.0081, 6) AS wetted_km2,
           round(count(*) FILTER (WHERE new_flood) * 0.0081, 6) AS new_km2,
           round(min(arrival_min) FILTER (WHERE newly_flooded), 6) AS first_arrival_min,
           round(max(arrival_min) FILTER (WHERE newly_flooded), 6) AS last_arrival_min,
           coalesce(max(max_depth) FILTER (WHERE flood AND rep), 0) AS peak_depth_m,
           round(coalesce(max(max_speed) FILTER (WHERE flood AND rep), 0), 6) AS peak_speed_ms,
           coalesce(max(max_depth) FILTER (WHERE flood AND NOT rep), 0) AS near_depth_m,
           round(coalesce(max(max_speed) FILTER (WHERE flood AND NOT rep), 0), 6) AS near_speed_ms,
           count(*) FILTER (WHERE flood AND NOT coalesce(dv, true)) AS interpolated_cells,
           round(100.0 * count(*) FILTER (WHERE flood AND NOT coalesce(dv, true))
                 / greatest(1, count(*) FILTER (WHERE flood)), 6) AS interpolated_pct,
           count(*) FILTER (WHERE arrival_s IS NULL) AS never_cells
    FROM (SELECT x.*, NOT (x.r < 10 OR x.r >= 54 OR x.c < 10 OR x.c >= 54
             OR EXISTS (SELECT 1 FROM seeds z WHERE z.run_id = x.run_id AND abs(z.r - x.r) + abs(z.c - x.c) <= 3)) AS rep,
             v.valid AS dv
          FROM cells_h x LEFT JOIN (SELECT r, c, bool_and(valid) AS valid FROM dem GROUP BY r, c) v USING (r, c)) GROUP BY run_id"""
DERIVED["seeds"] = (("poi_c",), "SELECT DISTINCT run_id, r, c FROM poi_c WHERE NOT outside")


def _located(s, d):
    return sampling.locate(view(s, d, "poi"), TRANSFORM, NY, NX)


def _seeds(s, d):
    return _located(s, d).where(~F.col("outside")).select(*grid.CELL).distinct()


def _masked(s, d, e=None):
    e = cut(enriched(s, d), "cells") if e is None else e  # read for the sizes, the near field and the figures
    sizes = e.select("run_id").distinct().withColumn("ny", F.lit(NY)).withColumn("nx", F.lit(NX))
    out = masks.reportable(e, sizes, _seeds(s, d), DX, near_field_m=270.0)
    dem = view(s, d, "dem").groupBy("r", "c").agg(F.bool_and("valid").alias("valid"))
    return out.join(dem, ["r", "c"], "left")


@query("agg3_run_figures", "AGG3 AGG4 AGG8 AGG9 AGG41 PRJ2 PRJ3", FIGURES_SQL, ("cells_h", "dem", "seeds"))
def _(s, d):
    return rounded(exposure.run_figures(_masked(s, d), DX))


@query("prj2_reportable_mask", "PRJ2 GEO6", """
    SELECT run_id, r, c, NOT (r < 10 OR r >= 54 OR c < 10 OR c >= 54
           OR EXISTS (SELECT 1 FROM seeds z WHERE z.run_id = x.run_id AND abs(z.r - x.r) + abs(z.c - x.c) <= 3)) AS reportable
    FROM cells_h x""", ("cells_h", "seeds"))
def _(s, d):
    return _masked(s, d).select(*grid.CELL, "reportable")


@query("prj3_report_masks", "PRJ3 SET5", """
    SELECT run_id, count(*) FILTER (WHERE flood AND rep) AS report, count(*) FILTER (WHERE flood AND NOT rep) AS excluded,
           count(*) FILTER (WHERE new_flood) AS new_only
    FROM (SELECT *, NOT (r < 10 OR r >= 54 OR c < 10 OR c >= 54
           OR EXISTS (SELECT 1 FROM seeds z WHERE z.run_id = x.run_id AND abs(z.r - x.r) + abs(z.c - x.c) <= 3)) AS rep
          FROM cells_h x) GROUP BY run_id""", ("cells_h", "seeds"))
def _(s, d):
    return masks.report_masks(_masked(s, d)).groupBy("run_id").agg(
        F.count_if("report").alias("report"), F.count_if("excluded").alias("excluded"),
        F.count_if("new_flood").alias("new_only"))


@query("set5_new_flood_difference", "SET5", """
    SELECT run_id, r, c FROM cells_h WHERE flood EXCEPT SELECT run_id, r, c FROM cells_h WHERE initially_wet""", ("cells_h",))
def _(s, d):
    e = enriched(s, d)
    return e.where("flood").select(*grid.CELL).exceptAll(e.where("initially_wet").select(*grid.CELL))


@query("set4_mask_intersection", "SET4", """
    SELECT run_id, r, c FROM cells_h WHERE new_flood INTERSECT SELECT run_id, r, c FROM cells_h WHERE newly_flooded""",
       ("cells_h",))
def _(s, d):
    e = enriched(s, d)
    return e.where("new_flood").select(*grid.CELL).intersect(e.where("newly_flooded").select(*grid.CELL))


@query("set7_extent_agreement", "SET7", """
    SELECT run_id, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a OR b) AS either,
           round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b), 6) AS iou
    FROM (SELECT run_id, max_depth >= 1.0 AS a, coalesce(arrival_min < 60, false) AS b FROM cells_h) GROUP BY run_id""",
       ("cells_h",))
def _(s, d):
    e = enriched(s, d).withColumn("a", F.col("max_depth") >= 1.0).withColumn(
        "b", F.coalesce(F.col("arrival_min") < 60, F.lit(False)))
    return rounded(masks.extent_agreement(e, "a", "b"))


# --- damage ---------------------------------------------------------------------------

def _case(curve):
    pts = list(zip(fixed.CURVE_DEPTHS, fixed.DAMAGE_CURVES[curve]))
    w = f"WHEN x <= 0 THEN {pts[0][1]}"
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        w += f" WHEN x < {x1} THEN {y0} + (x - {x0}) * ({y1 - y0:.10f} / {x1 - x0})"
    return f"CASE {w} ELSE {pts[-1][1]} END"


_BUILD = f"""
    SELECT run_id, category, round(f * v, 2) AS central, round(f * v * 0.5, 2) AS low, round(f * v * 2, 2) AS high, 'INR' AS unit
    FROM (SELECT run_id, curve AS category, sum(CASE curve WHEN 'residential' THEN {_case('residential')}
                 WHEN 'commercial' THEN {_case('commercial')} ELSE {_case('industrial')} END) AS f,
                 max(CASE curve WHEN 'residential' THEN 1200000.0 WHEN 'commercial' THEN 4000000.0 ELSE 12000000.0 END) AS v
          FROM (SELECT b.*, coalesce(max_depth, 0.0) AS x FROM buildings b LEFT JOIN cells_h USING (run_id, r, c))
          GROUP BY run_id, curve)"""


@query("agg14_building_damage", "AGG14 JN4 JN12 FN6", _BUILD, ("cells_h", "buildings"))
def _(s, d):
    at = sampling.at_cells(view(s, d, "buildings"), enriched(s, d), "max_depth")
    return rounded(exposure.building_damage(at), 2)


_LAND = f"""SELECT run_id, 'agriculture / land' AS category, round(f, 2) AS central, round(f * 0.5, 2) AS low,
        round(f * 2, 2) AS high, 'INR' AS unit FROM (
        SELECT run_id, sum(CASE WHEN new_flood THEN {_case('agriculture')} ELSE 0 END) * 0.81 * 250000.0 AS f
        FROM (SELECT *, max_depth AS x FROM cells_h) GROUP BY run_id)"""


@query("agg14_land_damage", "AGG14", _LAND, ("cells_h",))
def _(s, d):
    return rounded(exposure.land_damage(enriched(s, d), DX), 2)


_KM = """
    SELECT q.run_id, coalesce(sum(greatest(0, least(xhi, (c + 1) * 90.0) - greatest(xlo, c * 90.0))) FILTER (WHERE x.c IS NOT NULL), 0.0) / 1000.0 AS km
    FROM (SELECT run_id, least(xa, xb) AS xlo, greatest(xa, xb) AS xhi, CAST(floor((5760 - ya) / 90.0) AS INT) AS rr FROM roads) q
    LEFT JOIN cells_h x ON x.run_id = q.run_id AND x.new_flood AND x.r = q.rr AND x.c * 90.0 < xhi AND (x.c + 1) * 90.0 > xlo
    GROUP BY q.run_id"""
_ROADS = f"""SELECT run_id, 'roads' AS category, round(km * 8750000.0, 2) AS central, round(km * 8750000.0 * 0.5, 2) AS low,
        round(km * 8750000.0 * 2, 2) AS high, 'INR' AS unit FROM ({_KM})"""
_DAMAGE = f"SELECT * FROM ({_BUILD}) UNION ALL SELECT * FROM ({_LAND}) UNION ALL SELECT * FROM ({_ROADS})".replace(", 2) AS", ", 8) AS")


def _flooded_km(s, d, e):
    return vectors.flooded_length(vectors.segments_to_cells(view(s, d, "roads"), DX, 0.0, NY * DX), e.where("new_flood"))


@query("agg14_road_damage", "AGG14", _ROADS, ("roads", "cells_h"))
def _(s, d):
    return rounded(exposure.road_damage(_flooded_km(s, d, enriched(s, d))), 2)


def _categories(s, d, e=None):
    names = (*grid.CELL, "max_depth", "new_flood")
    e = cut(enriched(s, d).select(*names), "enriched") if e is None else e.select(*names)
    at = sampling.at_cells(view(s, d, "buildings"), e, "max_depth")
    return exposure.building_damage(at).unionByName(exposure.land_damage(e, DX)).unionByName(
        exposure.road_damage(_flooded_km(s, d, e)))


@query("agg14_total_damage", "AGG14", f"""
    SELECT run_id, round(sum(central), 1) AS central, round(sum(low), 1) AS low, round(sum(high), 1) AS high, max(unit) AS unit
    FROM ({_DAMAGE}) GROUP BY run_id""", ("cells_h", "buildings", "roads"))
def _(s, d):
    return rounded(exposure.total_damage(_categories(s, d)), 1)


@query("jn12_damage_fraction", "JN12", f"""
    SELECT run_id, r, c, round({_case('infrastructure')}, 6) AS fraction FROM (SELECT *, max_depth AS x FROM cells)""", ("cells",))
def _(s, d):
    return rounded(cells(s, d).select(*grid.CELL, fd.damage_fraction(F.col("max_depth"), "infrastructure").alias("fraction")))


_TWO = "CASE WHEN {0} = 0 THEN 0.0 ELSE round_even({0} / pow(10, floor(log10(abs({0}))) - 1), 0) * pow(10, floor(log10(abs({0}))) - 1) END"
_SHOWN = "CASE WHEN {0} = floor({0}) THEN format('{{:,.0f}}', {0}) ELSE regexp_replace(format('{{:,.4f}}', {0}), '0+$', '') END"


@query("fn6_crore_text", "FN6", f"""
    SELECT run_id, CASE WHEN high < 10000000.0 THEN 'under Rs 1 crore (order-of-magnitude estimate)'
      ELSE 'Rs ' || {_SHOWN.format('lo')} || '-' || {_SHOWN.format('hi')} || ' crore (order-of-magnitude estimate)' END AS text
    FROM (SELECT *, {_TWO.format('(low / 10000000.0)')} AS lo, {_TWO.format('(high / 10000000.0)')} AS hi FROM (
      SELECT run_id, sum(low) AS low, sum(high) AS high FROM ({_DAMAGE}) GROUP BY run_id))""", ("cells_h", "buildings", "roads"))
def _(s, d):
    t = exposure.total_damage(_categories(s, d))
    return t.select("run_id", fd.format_crore(F.col("low"), F.col("high")).alias("text"))


@query("agg15_structural_failure", "AGG15", """
    SELECT a.run_id, a.cells, a.people, coalesce(b.buildings, 0) AS buildings FROM (
      SELECT run_id, count(*) FILTER (WHERE aidr_class >= 4) AS cells,
             round(coalesce(sum(pop) FILTER (WHERE aidr_class >= 4), 0), 4) AS people FROM cells_h GROUP BY run_id) a
    LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE aidr_class >= 4) AS buildings
               FROM buildings LEFT JOIN cells_h USING (run_id, r, c) GROUP BY run_id) b USING (run_id)""",
       ("cells_h", "buildings"))
def _(s, d):
    e = enriched(s, d)
    at = sampling.at_cells(view(s, d, "buildings"), e, "aidr_class")
    return rounded(exposure.structural_failure(e, at), 4)


# --- settlements ------------------------------------------------------------------------

@query("jn2_point_to_cell", "JN2 JN20 PRJ18", "SELECT run_id, poi_id, outside, r, c FROM poi_c", ("poi_c",))
def _(s, d):
    return _located(s, d).select("run_id", "poi_id", "outside", "r", "c")


def _risk(s, d):
    return sampling.settlements_at_risk(_located(s, d), enriched(s, d))


@query("jn3_settlements_at_risk", "JN3 STR6 TOP1", "SELECT * FROM risk", ("risk",))
def _(s, d):
    return sampling.by_urgency(_risk(s, d))


@query("top2_resorted_settlements", "TOP2", "SELECT run_id, poi_id, name, depth_m FROM risk", ("risk",))
def _(s, d):
    return sampling.resort(_risk(s, d), "depth", False).select("run_id", "poi_id", "name", "depth_m")


@query("prj13_time_slices", "PRJ13 ST6", """
    SELECT minute, run_id, count(*) AS wetted FROM risk CROSS JOIN (SELECT unnest(range(0, 121, 5)) AS minute)
    WHERE arr_min <> -1 AND minute >= arr_min GROUP BY ALL""", ("risk",))
def _(s, d):
    return sampling.time_slices(_risk(s, d), 120, 5).groupBy("minute", "run_id").agg(F.count("*").alias("wetted"))


@query("jn4_gather_arrivals", "JN4", """
    SELECT building_id, round(arrival_min, 6) AS arrival_min FROM buildings LEFT JOIN cells_h USING (run_id, r, c)""",
       ("buildings", "cells_h"))
def _(s, d):
    return rounded(sampling.at_cells(view(s, d, "buildings"), enriched(s, d), "arrival_min").select(
        "building_id", "arrival_min"))


@query("jn1_shape_check", "JN1", """
    SELECT coalesce(a.run_id, b.run_id) AS run_id, count(*) FILTER (WHERE b.r IS NULL) AS left_only,
           count(*) FILTER (WHERE a.r IS NULL) AS right_only
    FROM cells a FULL JOIN dem b ON a.run_id = b.run_id AND a.r = b.r AND a.c = b.c GROUP BY 1""", ("cells", "dem"))
def _(s, d):
    return grid.unmatched_cells(cells(s, d), view(s, d, "dem"))


@query("top4_deepest_cells", "TOP4 WIN6", """
    SELECT run_id, r, c, max_depth FROM cells ORDER BY max_depth DESC, run_id, r, c LIMIT 12""", ("cells",))
def _(s, d):
    return cells(s, d).select(*grid.CELL, "max_depth").orderBy(F.col("max_depth").desc(), *grid.CELL).limit(12)


# --- report and summary -------------------------------------------------------------------

_FIG = "CASE WHEN p <= 0 THEN 0 ELSE CAST(round_even(p / pow(10, greatest(0, floor(log10(greatest(p, 1))) - 1)), 0) * pow(10, greatest(0, floor(log10(greatest(p, 1))) - 1)) AS BIGINT) END"
_PEOPLE = """SELECT q.run_id, d.idx, d.label, coalesce(sum(x.pop), 0) AS p FROM (SELECT DISTINCT run_id FROM cells_h) q
    CROSS JOIN {dim} d LEFT JOIN cells_h x ON x.run_id = q.run_id AND x.{col} = d.idx AND x.new_flood AND x.newly_flooded GROUP BY ALL"""


def _cases(texts, rest=None):
    return "CASE idx " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + (f" ELSE '{rest}'" if rest else "") + " END"


def _only_exposed(e):
    """All cells, so that a run without exposed people keeps its rows; people only where they are exposed."""
    return e.withColumn("pop", F.when(F.col("new_flood") & F.col("newly_flooded"), F.col("pop")).otherwise(0.0))


@query("snk6_arrival_rows", "SNK6 STR3 FN7 AGG5", f"""
    SELECT run_id, idx, label AS band, format('{{:,.2f}}', area) AS area, format('{{:,}}', {_FIG}) AS people,
           {_cases(fixed.EVACUATION_ACTIONS, fixed.EVACUATION_LATER)} AS action
    FROM ({_PEOPLE.format(dim='bd', col='band')}) JOIN (SELECT runs.run_id, bd.idx, count(x.run_id) * 0.0081 AS area FROM runs CROSS JOIN bd
      LEFT JOIN cells_h x ON x.run_id = runs.run_id AND x.band = bd.idx GROUP BY ALL) USING (run_id, idx)
    UNION ALL SELECT run_id, 99, 'Total', '—', format('{{:,}}', {_FIG}), '—' FROM (SELECT run_id, sum(p) AS p FROM ({_PEOPLE.format(dim='bd', col='band')}) GROUP BY run_id)""",
       ("cells_h", "runs", "bd"))
def _(s, d):
    e = enriched(s, d)
    people = exposure.population_by_class(_only_exposed(e), "band", fa.band_labels())
    rows = ps.arrival_rows(exposure.area_by_class(e, "band", fa.band_labels(), DX), people)
    return ps.with_total(rows, people)


@query("snk6_hazard_rows", "SNK6", f"""
    SELECT run_id, idx, label AS hazard, format('{{:,}}', {_FIG}) AS people, {_cases(fixed.HAZARD_MEANING)} AS meaning
    FROM ({_PEOPLE.format(dim='hz', col='defra_class')})""", ("cells_h", "hz"))
def _(s, d):
    return ps.hazard_rows(exposure.population_by_class(_only_exposed(enriched(s, d)), "defra_class", fixed.HAZARD_NAMES))


_MONEY = "format('₹{{:,.1f}} cr', {0} / 10000000.0) AS {0}"


@query("snk6_damage_rows", "SNK6", f"""
    SELECT run_id, category, {', '.join(_MONEY.format(c) for c in ('low', 'central', 'high'))} FROM (
      SELECT run_id, category, low, central, high FROM ({_DAMAGE})
      UNION ALL SELECT run_id, 'TOTAL', sum(low), sum(central), sum(high) FROM ({_DAMAGE}) GROUP BY run_id)""", ("cells_h", "buildings", "roads"))
def _(s, d):
    c = _categories(s, d)
    return ps.damage_rows(c, exposure.total_damage(c))


#: Share of the people that resampling may lose or add before the gate closes.
RESIDUAL = 0.001


def _gate(s, d, e=None, total=None):
    """The release gate on what was measured: volumes, flooded edges, damage, and the sources of the run's area."""
    e = enriched(s, d) if e is None else e
    rim = F.col("r").isin(0, NY - 1) | F.col("c").isin(0, NX - 1)
    runs = e.groupBy("run_id").agg(F.bool_or(F.col("flood") & rim).alias("open_edges"))
    volumes = accumulate.frame_volumes(view(s, d, "frames"), DX)
    error = accumulate.volume_error(volumes, runs.select("run_id", F.lit(500.0).alias("injected")), False)
    unverified = view(s, d, "sources").where(~F.col("verified")).groupBy(F.split("key", "[.]")[0].alias("area")).agg(
        F.count("*").alias("n"))
    total = exposure.total_damage(_categories(s, d)) if total is None else total
    loss = total.select("run_id", (F.col("central") > 0).alias("has_damage"))
    runs = runs.join(error.select("run_id", F.col("error").alias("volume_error")), "run_id").join(loss, "run_id", "left")
    runs = runs.withColumn("area", F.concat(F.lit("area"), (F.col("run_id") % 7).cast("string"))).join(unverified, "area", "left")
    people = resample.conservation(view(s, d, "counts"), _people(s, d), _to_target, _sizes(s, d), tolerance=RESIDUAL)
    runs = runs.join(people.select("run_id", "conserved"), "run_id", "left")
    return ps.release_gate(runs.withColumn("unverified_n", F.coalesce("n", F.lit(0)))
                               .withColumn("has_damage", F.coalesce("has_damage", F.lit(False))))


_GATE = f"""
    SELECT run_id, list_filter([
             CASE WHEN n > 0 THEN n || ' unverified citation(s)' END,
             CASE WHEN loss > 0 THEN 'damage is order-of-magnitude only' END,
             CASE WHEN error > 0.000001 THEN 'mass conservation: spurious gain'
                  WHEN error < -0.000001 AND NOT open_edges THEN 'mass conservation: loss on a walled domain' END,
             CASE WHEN residual > {RESIDUAL} THEN 'population resampling did not conserve totals' END], lambda x: x IS NOT NULL) AS reasons,
           error, open_edges, residual
    FROM (SELECT run_id, bool_or(flood AND (r IN (0, 63) OR c IN (0, 63))) AS open_edges FROM cells_h GROUP BY run_id)
    JOIN (SELECT run_id, (arg_max(v, t_s) - arg_min(v, t_s) - 500.0) / (arg_min(v, t_s) + 500.0) AS error FROM (
            SELECT run_id, t_s, sum(h) * 8100.0 AS v FROM frames GROUP BY ALL) GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT run_id, sum(central) AS loss FROM ({_DAMAGE}) GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT split_part(key, '.', 1) AS area, count(*) AS n FROM sources WHERE NOT verified GROUP BY 1) ON area = 'area' || (run_id % 7)
    LEFT JOIN (SELECT run_id, abs(t - source_total) / source_total AS residual FROM ({FOOTPRINT}) JOIN (SELECT run_id, sum(pop) AS t FROM ({_POP}) GROUP BY run_id) USING (run_id)) USING (run_id)"""
_GATE_NEEDS = ("cells_h", "frames", "buildings", "roads", "sources", "dem", "counts")


@query("agg35_release_gate", "AGG35", f"SELECT run_id, array_to_string(reasons, '; ') AS reasons FROM ({_GATE})", _GATE_NEEDS)
def _(s, d):
    g = _gate(s, d)
    return g.select("run_id", F.array_join("reasons", "; ").alias("reasons"))


_CAVEATS = f"""
    SELECT run_id, list_filter([
      'Hazard is an average over 90 m cells (0.81 ha), not over single buildings.', 'Water shallower than 0.10 m is reported as dry.',
      'Arrival is the first moment depth reaches 0.10 m in a 90 m cell.', 'Arrival time is not warning time.',
      'Arrival is reported in bands; its uncertainty exceeds single minutes.',
      CASE WHEN never_cells > 0 THEN never_cells || ' cells had not flooded by the end of the run; near the outlet that may mean not yet.' END,
      'Population is a modelled surface of 2020, 6 years old, not a count.', 'Populations are reported to two significant figures.',
      'Population is where people sleep, not where they work or travel.', 'Damage is an order-of-magnitude range, not an assessment.',
      'Depth-damage curves ignore velocity; structural failure is counted separately.',
      CASE WHEN interpolated_cells > 0 THEN interpolated_cells || ' flooded cells (' || format('{{:.1f}}', interpolated_pct)
        || '%) lie on terrain interpolated across voids.' END], lambda x: x IS NOT NULL) AS limitations
    FROM ({FIGURES_SQL})"""


@query("agg34_caveats", "AGG34 AGG41 AGG42 SET6 DT2", f"SELECT run_id, CAST(to_json(limitations) AS VARCHAR) AS limitations FROM ({_CAVEATS})",
       ("cells_h", "dem", "seeds"))
def _(s, d):
    return ps.ordered_distinct(ps.stage_caveats(exposure.run_figures(_masked(s, d), DX), DX)).select("run_id", F.to_json("limitations").alias("limitations"))


def _summary(s, d, e=None, gate=None):
    e = cut(_masked(s, d, e), "enriched")
    f = cut(exposure.run_figures(e, DX), "figures")
    return ps.scenario_summary(f, exposure.exposure_totals(e),
                               exposure.area_by_class(e, "defra_class", fixed.HAZARD_NAMES, DX),
                               exposure.area_by_class(e, "band", fa.band_labels(), DX),
                               ps.stage_caveats(f, DX), _gate(s, d) if gate is None else gate)


def _by_label(col: str, dim: str) -> str:
    return f"""SELECT run_id, string_agg(label || '=' || format('{{:,.4f}}', km2), '|' ORDER BY idx) AS areas FROM ({_area(col, dim)}) GROUP BY run_id"""


_SCENARIO = f"""
    SELECT f.*, t.total, t.people, array_to_string(g.reasons, '; ') AS reasons, len(g.reasons) = 0 AS presentable,
           CAST(to_json(c.limitations) AS VARCHAR) AS limitations, h.areas AS by_hazard, b.areas AS by_band,
           'dam break at run ' || f.run_id || '; floods '
             || CASE WHEN new_km2 >= 10 THEN format('{{:,}}', CAST(round_even(new_km2, 0) AS BIGINT)) ELSE format('{{:.1f}}', new_km2) END || ' km2'
             || coalesce('; first arrival ' || format('{{:.0f}}', first_arrival_min) || ' min after failure', '')
             || CASE WHEN people > 0 THEN '; about ' || format('{{:,}}', people) || ' people exposed' ELSE '' END || '.' AS headline
    FROM ({FIGURES_SQL}) f
    JOIN (SELECT run_id, p AS total, {_FIG} AS people FROM (
            SELECT run_id, sum(CASE WHEN new_flood AND newly_flooded THEN pop ELSE 0.0 END) AS p FROM cells_h GROUP BY run_id)) t USING (run_id)
    JOIN ({_GATE}) g USING (run_id) JOIN ({_CAVEATS}) c USING (run_id)
    JOIN ({_by_label('defra_class', 'hz')}) h USING (run_id) JOIN ({_by_label('band', 'bd')}) b USING (run_id)"""
_SCENARIO_NEEDS = (*_GATE_NEEDS, "seeds", "runs", "hz", "bd")


@query("agg36_scenario_summary", "AGG36 STR4", f"""
    SELECT run_id, headline, new_km2 AS flooded_area_km2, wetted_km2 AS total_wetted_area_km2, peak_depth_m, peak_speed_ms, near_depth_m,
           near_speed_ms, first_arrival_min, last_arrival_min, interpolated_cells, round(total, 4) AS total_population,
           CAST(people AS BIGINT) AS reported_population, presentable AS presentable_as_fact, reasons AS blocking_reasons, limitations,
           by_hazard, by_band FROM ({_SCENARIO})""", _SCENARIO_NEEDS)
def _(s, d):
    def listed(m):
        return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 4))), "|")
    x = _summary(s, d).select("run_id", "headline", "results.*", "honesty.*")
    return rounded(x.select(
        "run_id", "headline", "flooded_area_km2", "total_wetted_area_km2", "peak_depth_m", "peak_speed_ms", "near_depth_m", "near_speed_ms",
        "first_arrival_min", "last_arrival_min", "interpolated_cells", F.round("total_population", 4).alias("total_population"),
        F.col("reported_population").cast("long").alias("reported_population"), "presentable_as_fact",
        F.array_join("blocking_reasons", "; ").alias("blocking_reasons"), F.to_json("limitations").alias("limitations"),
        listed("area_by_hazard_km2").alias("by_hazard"), listed("area_by_band_km2").alias("by_band")))


_BREACH = """
    SELECT run_id, max(q) AS peak_q, sum(released) AS released, min(k) AS least FROM (
      SELECT run_id, q, coalesce((q + lag(q) OVER w) / 2.0 * (t_s - lag(t_s) OVER w), 0) AS released,
             CASE WHEN x <= 0.67 THEN 1 WHEN x >= 1 THEN 0 ELSE pow(1 - pow(x, 1.5), 0.385) END AS k
      FROM (SELECT *, floor(t_s / 3600.0) % 10 / 8.0 AS x FROM hydrographs) WINDOW w AS (PARTITION BY run_id, label ORDER BY t_s)) GROUP BY run_id"""


def _breach(s, d):
    """Per run the largest peak of its hydrographs, all that they release, and the least submergence factor."""
    x = series.summarise(_breached(s, d))
    return x.groupBy("run_id").agg(F.max("peak_q").alias("peak_q"), F.sum("released").alias("released"), F.min("min_submergence").alias("min_submergence"))


def _pools(s, d):
    dem = cut(_terraced(s, d), "dem")
    return terrain.pool_report(terrain.detect_pools(dem, _sizes(s, d), _dams(s, d), DX, tile=FINE), _sizes(s, d), _dams(s, d), DX)


@query("agg42_run_caveats", "AGG34 AGG41 AGG42", f"""
    SELECT run_id, CAST(to_json(list_filter([
      CASE WHEN open_edges THEN 'Cells within 10 of an open edge (0.9 km) follow the outflow condition and are not quotable.' END,
      CASE WHEN error < -0.000001 AND open_edges THEN format('{{:.1f}}', -error * 100.0) || '% of the water left through the open edge (relative change '
             || printf('%+.2e', error) || '): outflow, not a conservation error.'
           WHEN abs(error) > 0.000001 THEN 'Relative mass error ' || printf('%+.2e', error) || '; above 1e-6 it needs looking into before the result is used.' END,
      CASE WHEN least < 1 THEN 'The weir was drowned (least factor ' || printf('%.3f', least) || '): outflow was not free throughout.' END,
      CASE WHEN released / (20000000.0 * (run_id + 1)) > 1.02 THEN 'The breach released ' || printf('%.2f', released / (20000000.0 * (run_id + 1)))
             || ' times the storage: the storage model does not hold.' END,
      CASE WHEN km2 > 0.1 * 1.05 THEN 'The pool covers ' || printf('%.2f', km2) || ' km2, the published reservoir 0.10 km2.' END,
      CASE WHEN edge THEN 'The pool reaches the edge of the grid and may be cut off.' END], lambda x: x IS NOT NULL)) AS VARCHAR) AS limitations
    FROM ({_GATE}) LEFT JOIN ({_BREACH}) USING (run_id)
    LEFT JOIN (SELECT run_id, area_km2 AS km2, touches_j0 OR touches_jmax OR touches_i0 OR touches_imax AS edge FROM ({POOL_SQL})) USING (run_id)""",
       (*_GATE_NEEDS, "hydrographs", "pool_low"))
def _(s, d):
    pools = _pools(s, d).select("run_id", F.col("area_km2").alias("pool_km2"), (F.col("published_m2") / 1e6).alias("published_km2"),
                                (F.col("touches_j0") | F.col("touches_jmax") | F.col("touches_i0") | F.col("touches_imax")).alias("pool_at_edge"))
    runs = _gate(s, d).select("run_id", "volume_error", "open_edges", F.lit(fixed.OPEN_EDGE_CELLS).alias("edge_cells"))
    runs = runs.join(_breach(s, d), "run_id", "left").join(pools, "run_id", "left").withColumn(
        "released_fraction", F.col("released") / (2.0e7 * (F.col("run_id") + 1)))
    own = runs.select("run_id").join(ps.ordered_distinct(ps.run_caveats(runs, DX)), "run_id", "left")
    return own.select("run_id", F.to_json(F.coalesce("limitations", F.array().cast("array<string>"))).alias("limitations"))


def _record(s, d):
    f = view(s, d, "frames")
    # the cells, the damage and the gate are read by several parts: each is worked out once
    e = cut(enriched(s, d), "enriched")
    total = cut(exposure.total_damage(_categories(s, d, e)), "damage")
    gate = cut(_gate(s, d, e, total).select("run_id", "volume_error", "presentable", "reasons"), "gate")
    runs = f.groupBy("run_id").agg(F.max("t_s").alias("duration_s"), F.count_distinct("t_s").alias("steps"), (F.count("*") / 1000.0).alias("wall_time_s"))
    runs = runs.join(gate.select("run_id", "volume_error"), "run_id", "left").withColumn(
        "solver", F.create_map(F.lit("h_min_m"), F.lit(fixed.H_MIN_M), F.lit("wet_m"), F.lit(fixed.WET_THRESHOLD_M)))
    grids = runs.select("run_id", F.lit(NY).alias("ny"), F.lit(NX).alias("nx"), F.lit(DX).alias("dx_m"), F.lit("EPSG:32644").alias("crs"),
                        F.array(*[F.lit(v) for v in TRANSFORM]).alias("transform"))
    loss = total.join(exposure.structural_failure(e, sampling.at_cells(view(s, d, "buildings"), e, "aidr_class")).select("run_id", "buildings"), "run_id").select(
        "run_id", "low", "central", "high", "unit", fd.format_crore(F.col("low"), F.col("high")).alias("formatted"), F.col("buildings").alias("structural_failure_buildings"))
    people = _only_exposed(e)
    by = exposure.population_by_class(people, "defra_class", fixed.HAZARD_NAMES).groupBy("run_id").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label", "people"))), lambda x: F.struct(x["label"], x["people"]))).alias("by_hazard"))
    features = vectors.features_in_flood(view(s, d, "buildings").select("run_id", F.col("building_id").alias("feature_id"), "r", "c"), e.where("new_flood"))
    infra = by.join(features, "run_id", "left").join(_flooded_km(s, d, e), "run_id", "left").select(
        "run_id", "by_hazard", F.coalesce("features", F.lit(0)).alias("buildings"), F.coalesce("km", F.lit(0.0)).alias("road_km"))
    return ps.full_record(_summary(s, d, e, gate), grids, runs, terrain.terrain_summary(view(s, d, "dem"), DX), _breach(s, d), infra, loss)


_RUNS = "SELECT run_id, max(t_s) AS duration_s, count(DISTINCT t_s) AS steps, count(*) / 1000.0 AS wall_time_s FROM frames GROUP BY run_id"


@query("agg36_full_record", "AGG36 GEO1", f"""
    SELECT run_id, '[64,64]' AS shape, 90.0 AS dx_m, 'EPSG:32644' AS crs, 5760.0 AS y0, duration_s, steps, wall_time_s, printf('%+.4e', error) AS volume_error,
           0.001 AS h_min_m, voids, z_max, round(peak_q, 6) AS peak_q, round(released, 1) AS released, round(p0, 4) AS low_hazard_people,
           coalesce(features, 0) AS buildings, round(coalesce(km, 0.0), 6) AS road_km, round(low, 1) AS low, round(central, 1) AS central, round(high, 1) AS high,
           failed AS structural_failure_buildings
    FROM ({_RUNS}) JOIN (SELECT run_id, error FROM ({_GATE})) USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE NOT valid) AS voids, max(z) FILTER (WHERE valid) AS z_max FROM dem GROUP BY run_id) USING (run_id)
    LEFT JOIN ({_BREACH}) USING (run_id)
    JOIN (SELECT run_id, coalesce(sum(pop) FILTER (WHERE defra_class = 0 AND new_flood AND newly_flooded), 0) AS p0 FROM cells_h GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT run_id, count(DISTINCT CASE WHEN new_flood THEN building_id END) AS features FROM buildings LEFT JOIN cells_h USING (run_id, r, c) GROUP BY run_id) USING (run_id)
    LEFT JOIN ({_KM}) USING (run_id)
    LEFT JOIN (SELECT run_id, sum(low) AS low, sum(central) AS central, sum(high) AS high FROM ({_DAMAGE}) GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT c.run_id, coalesce(b.failed, 0) AS failed FROM (SELECT DISTINCT run_id FROM cells_h) c LEFT JOIN (
                 SELECT run_id, count(*) FILTER (WHERE aidr_class >= 4) AS failed FROM buildings LEFT JOIN cells_h USING (run_id, r, c) GROUP BY run_id) b USING (run_id)) USING (run_id)""",
       (*_SCENARIO_NEEDS, "hydrographs"))
def _(s, d):
    x = _record(s, d)
    return x.select(
        "run_id", F.to_json("grid.shape").alias("shape"), "grid.dx_m", "grid.crs", F.get("grid.transform", F.lit(5)).alias("y0"), "run.duration_s", "run.steps",
        "run.wall_time_s", ft.scientific(F.col("run.volume_error"), 4, plus=True).alias("volume_error"), F.col("run.solver")["h_min_m"].alias("h_min_m"),
        "provenance.terrain.voids", "provenance.terrain.z_max", F.round("provenance.breach.peak_q", 6).alias("peak_q"),
        F.round("provenance.breach.released", 1).alias("released"), F.round(F.col("results.exposure.by_hazard")["Low"], 4).alias("low_hazard_people"),
        "results.exposure.buildings", F.round("results.exposure.road_km", 6).alias("road_km"), *[F.round(f"results.damage.{c}", 1).alias(c) for c in ("low", "central", "high")],
        "results.damage.structural_failure_buildings")


@query("snk6_run_rows", "SNK6", f"""
    SELECT run_id, pos, quantity, value FROM (
      SELECT run_id, unnest(range(11)) AS pos, unnest(['Newly inundated area', 'Total wetted area (incl. reservoir)', 'Peak depth', 'Peak speed',
        'First arrival outside pre-existing water', 'Last arrival', 'Grid', 'Simulated duration', 'Wall-clock time', 'Mass conservation error',
        'Flooded cells over interpolated DEM voids']) AS quantity,
        unnest([format('{{:,.2f}}', new_km2) || ' km²', format('{{:,.2f}}', wetted_km2) || ' km²', format('{{:,.2f}}', peak_depth_m) || ' m',
          format('{{:,.2f}}', peak_speed_ms) || ' m/s', coalesce(format('{{:,}}', CAST(round_even(first_arrival_min, 0) AS BIGINT)) || ' min', 'not reached'),
          coalesce(format('{{:,}}', CAST(round_even(last_arrival_min, 0) AS BIGINT)) || ' min', 'not reached'), '64 × 64 cells at 90 m',
          printf('%.2f', duration_s / 3600.0) || ' h (' || format('{{:,}}', steps) || ' steps)', printf('%.1f', wall_time_s) || ' s',
          printf('%+.2e', error) || ' (relative)', format('{{:,}}', interpolated_cells)]) AS value
      FROM ({FIGURES_SQL}) JOIN ({_RUNS}) USING (run_id) JOIN (SELECT run_id, error FROM ({_GATE})) USING (run_id))""", _SCENARIO_NEEDS)
def _(s, d):
    return ps.run_rows(_record(s, d))


@query("snk6_infrastructure_rows", "SNK6", f"""
    SELECT run_id, 'buildings flooded' AS feature, format('{{:,}}', count(DISTINCT CASE WHEN new_flood THEN building_id END)) AS value
    FROM buildings LEFT JOIN cells_h USING (run_id, r, c) GROUP BY run_id
    UNION ALL SELECT run_id, 'road km flooded', format('{{:,.1f}}', km) FROM ({_KM})""", ("buildings", "cells_h", "roads"))
def _(s, d):
    e = cut(enriched(s, d), "enriched")
    b = view(s, d, "buildings").select("run_id", F.col("building_id").alias("feature_id"), "r", "c")
    counts = vectors.features_in_flood(b, e.where("new_flood")).select("run_id", F.lit("buildings_flooded").alias("feature"), F.col("features").alias("n"))
    return ps.infrastructure_rows(counts, _flooded_km(s, d, e).select("run_id", F.lit("road_km_flooded").alias("feature"), "km"))


@query("agg37_run_scalars", "AGG37", f"""
    SELECT run_id, headline, presentable, peak_depth_m, new_km2 AS flooded_area_km2, first_arrival_min,
           round(CASE WHEN people <> 0 THEN people ELSE total END, 6) AS exposed_people FROM ({_SCENARIO})""", _SCENARIO_NEEDS)
def _(s, d):
    return rounded(ps.run_scalars(_summary(s, d)))


@query("snk2_metadata_document", "SNK2 PRJ14", f"""
    SELECT run_id, 1 AS schema_version, headline, presentable, limitations, round(total, 4) AS total_population FROM ({_SCENARIO})""", _SCENARIO_NEEDS)
def _(s, d):
    def read(path):
        return F.get_json_object("value", path)
    return bands.metadata_document(_summary(s, d)).select(
        "run_id", read("$.schema_version").cast("int").alias("schema_version"), read("$.scenario.headline").alias("headline"),
        read("$.honesty.presentable_as_fact").cast("boolean").alias("presentable"), read("$.scenario.honesty.limitations").alias("limitations"),
        F.round(read("$.scenario.results.total_population").cast("double"), 4).alias("total_population"))


@query("fn7_two_figures", "FN7", """
    SELECT run_id, r, c, CASE WHEN pop <= 0 THEN 0 ELSE CAST(round_even(pop / m, 0) * m AS BIGINT) END AS people
    FROM (SELECT *, pow(10, greatest(0, floor(log10(CASE WHEN pop <= 0 THEN 1 ELSE pop END)) - 1)) AS m FROM cells_h)""",
       ("cells_h",))
def _(s, d):
    return enriched(s, d).select(*grid.CELL, ft.two_figures(F.col("pop")).alias("people"))


@query("str5_display_formats", "STR5", """
    SELECT run_id, r, c, CASE WHEN arrival_min IS NULL THEN 'not reached' WHEN arrival_min <= 0 THEN '< 1 min'
             ELSE CAST(CAST(floor(arrival_min + 0.5) AS BIGINT) AS VARCHAR) || ' min' END AS arrival,
           printf('%.1f m', max_depth + 0.03) AS depth, printf('%.1f m/s', max_speed + 0.003) AS speed,
           CASE WHEN (r + 1) * 0.37 >= 10 THEN format('{:,}', CAST(floor((r + 1) * 0.37 + 0.5) AS BIGINT)) ELSE printf('%.1f', (r + 1) * 0.37 + 0.003) END || ' km²' AS area,
           'about ' || format('{:,}', CAST(floor(pop) AS BIGINT)) || ' people' AS people FROM cells_h""", ("cells_h",))
def _(s, d):
    return enriched(s, d).select(*grid.CELL, ft.show_arrival(F.col("arrival_min")).alias("arrival"),
                                 ft.show_depth(F.col("max_depth") + 0.03).alias("depth"),
                                 ft.show_speed(F.col("max_speed") + 0.003).alias("speed"),
                                 ft.show_area((F.col("r") + 1) * 0.37 + F.when((F.col("r") + 1) * 0.37 < 10, 0.003).otherwise(0.0)).alias("area"),
                                 ft.show_population(F.floor("pop")).alias("people"))


@query("snk1_scenario_bands", "SNK1", """
    SELECT run_id, band_name AS band, count(*) AS n, round(sum(value), 3) AS total FROM (
      SELECT run_id, 'arrival_time_min' AS band_name, CASE WHEN initially_wet THEN -9999.0 ELSE coalesce(arrival_min, -9999.0) END AS value FROM cells_h
      UNION ALL SELECT run_id, 'arrival_band', band FROM cells_h UNION ALL SELECT run_id, 'max_depth_m', max_depth FROM cells_h
      UNION ALL SELECT run_id, 'max_speed_ms', max_speed FROM cells_h UNION ALL SELECT run_id, 'max_depth_velocity', max_dv FROM cells_h
      UNION ALL SELECT run_id, 'hazard_rating', CASE WHEN initially_wet THEN -9999.0 ELSE rating END FROM cells_h
      UNION ALL SELECT run_id, 'hazard_class_defra', CASE WHEN initially_wet THEN -1 ELSE defra_class END FROM cells_h
      UNION ALL SELECT run_id, 'hazard_class_aidr', CASE WHEN initially_wet THEN -1 ELSE aidr_class END FROM cells_h
      UNION ALL SELECT run_id, 'dem_valid', CASE WHEN max_depth > 0.5 THEN 1 ELSE 0 END FROM cells_h) GROUP BY ALL""", ("cells_h",))
def _(s, d):
    e = enriched(s, d).withColumn("domain", F.lit(True)).withColumn("valid", (F.col("max_depth") > 0.5).cast("int"))
    path = scratch_path(s, "bands")
    bands.write_bands(e, path)
    back = s.read.parquet(path)
    return rounded(back.groupBy("run_id", "band").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query("snk4_settlement_features", "SNK4", """
    SELECT CAST(json_object('type', 'Feature', 'properties', json_object('name', name, 'flooded', flooded, 'arr_min', arr_min,
                  'depth_m', depth_m, 'speed_ms', speed_ms, 'haz_class', coalesce(hz.label, 'none'), 'band', r.band, 'population', pop), 'geometry', json_object('type', 'Point', 'coordinates', json_array(x, y))) AS VARCHAR) AS value
    FROM risk r JOIN (SELECT run_id, poi_id, x, y FROM poi) USING (run_id, poi_id) LEFT JOIN hz ON hz.idx = r.haz_class""", ("risk", "poi", "hz"))
def _(s, d):
    r = _risk(s, d).join(view(s, d, "poi").select("run_id", "poi_id", "x", "y"), ["run_id", "poi_id"])
    names = F.array(*[F.lit(n) for n in fixed.HAZARD_NAMES])
    r = r.withColumn("haz_class", F.coalesce(F.when(F.col("haz_class") >= 0, F.get(names, F.col("haz_class"))), F.lit("none"))).withColumn(
        "population", F.col("pop"))
    return bands.feature_rows(r, bands.point_geometry(F.col("x"), F.col("y")), "name", "flooded", "arr_min", "depth_m", "speed_ms", "haz_class",
                              "band", "population")


# --- vectors ------------------------------------------------------------------------------

@query("geo4_boundary_edges", "GEO4", """
    SELECT x.run_id, x.band AS cls, count(*) AS edges FROM cells_h x
    CROSS JOIN (VALUES (-1, 0), (0, -1), (1, 0), (0, 1)) AS o(dr, dc)
    LEFT JOIN cells_h y ON y.run_id = x.run_id AND y.r = x.r + o.dr AND y.c = x.c + o.dc AND y.band >= 0
    WHERE x.band >= 0 AND (y.band IS NULL OR y.band <> x.band) GROUP BY ALL""", ("cells_h",))
def _(s, d):
    e = enriched(s, d).where("band >= 0").select(*grid.CELL, F.col("band").alias("cls"))
    return vectors.boundary_edges(e).groupBy("run_id", "cls").agg(F.count("*").alias("edges"))


def _rings(s, d):
    e = enriched(s, d).where("band >= 0").select(*grid.CELL, F.col("band").alias("cls"))
    return vectors.traced_rings(cut(e, "bands"))


@query("geo4_isochrone_area", "GEO4", """
    SELECT run_id, band AS cls, CAST(count(*) AS DOUBLE) AS cells, round(count(*) * 0.0081, 6) AS km2
    FROM cells_h WHERE band >= 0 GROUP BY ALL""", ("cells_h",))
def _(s, d):
    areas = vectors.ring_areas(_rings(s, d))
    return rounded(areas.groupBy("run_id", "cls").agg(F.sum("signed_cells").alias("cells"),
                   (F.sum("signed_cells") * DX * DX / 1e6).alias("km2")))


# each edge walks on as long as it meets none with a smaller number; the one that comes home names the ring
_LINKS = """
    edges AS (
      SELECT x.run_id, x.band AS cls, side, x.r + p AS r0, x.c + q AS c0, x.r + u AS r1, x.c + v AS c1,
             (CAST(x.r + p AS BIGINT) * 2147483648 + x.c + q) * 4 + side AS e
      FROM cells_h x CROSS JOIN (VALUES (0, -1, 0, 0, 1, 0, 0), (1, 0, -1, 0, 0, 1, 0), (2, 1, 0, 1, 0, 1, 1), (3, 0, 1, 1, 1, 0, 1)) AS o(side, dr, dc, p, q, u, v)
      LEFT JOIN cells_h y ON y.run_id = x.run_id AND y.r = x.r + o.dr AND y.c = x.c + o.dc AND y.band >= 0
      WHERE x.band >= 0 AND (y.band IS NULL OR y.band <> x.band)),
    link AS (
      SELECT run_id, cls, e, any_value(side) AS side, any_value(r0) AS r0, any_value(c0) AS c0, any_value(r1) AS r1, any_value(c1) AS c1,
             arg_max(ne, turn) AS ne, arg_max(ns, turn) AS ns
      FROM (SELECT a.*, b.e AS ne, b.side AS ns, (a.r1 - a.r0) * (b.c1 - b.c0) - (a.c1 - a.c0) * (b.r1 - b.r0) AS turn
            FROM edges a JOIN edges b ON b.run_id = a.run_id AND b.cls = a.cls AND b.r0 = a.r1 AND b.c0 = a.c1) GROUP BY run_id, cls, e),
    walk AS (
      SELECT run_id, e AS ring, e, ne, 1 AS place FROM link
      UNION ALL
      SELECT w.run_id, w.ring, l.e, l.ne, w.place + 1 FROM walk w JOIN link l ON l.run_id = w.run_id AND l.e = w.ne WHERE w.ne > w.ring),
    home AS (SELECT run_id, ring FROM walk WHERE ne = ring),
    ringed AS (SELECT l.*, w.ring, CAST(w.place AS BIGINT) AS place, EXISTS (SELECT 1 FROM link k WHERE k.run_id = l.run_id AND k.ne = l.e AND k.side <> l.side) AS corner
               FROM walk w JOIN home USING (run_id, ring) JOIN link l ON l.run_id = w.run_id AND l.e = w.e)"""


@query("geo4_isochrone_rings", "GEO4 SNK4", f"""
    SELECT * FROM (WITH RECURSIVE {_LINKS}
      SELECT run_id, cls, ring, place, c0 * 90.0 AS x, 5760.0 - r0 * 90.0 AS y FROM ringed WHERE corner)""", ("cells_h",))
def _(s, d):
    return vectors.ring_vertices(_rings(s, d), TRANSFORM)


@query("geo4_ring_areas", "GEO4", f"""
    SELECT * FROM (WITH RECURSIVE {_LINKS}
      SELECT run_id, cls, ring, sum(r0 * c1 - r1 * c0) / 2.0 AS signed_cells FROM ringed GROUP BY ALL)""", ("cells_h",))
def _(s, d):
    return vectors.ring_areas(_rings(s, d))


@query("snk4_isochrone_features", "SNK4 GEO4", f"""
    SELECT * FROM (WITH RECURSIVE {_LINKS},
      area AS (SELECT run_id, ring, sum(r0 * c1 - r1 * c0) / 2.0 AS a FROM ringed GROUP BY ALL),
      pts AS (SELECT run_id, cls, ring, list([c0 * 90.0, 5760.0 - r0 * 90.0] ORDER BY place) AS p FROM ringed WHERE corner GROUP BY run_id, cls, ring)
      SELECT CAST(json_object('type', 'Feature', 'properties', json_object('band', cls, 'label', bd.label, 'km2', round(abs(a) * 0.0081, 4), 'hole', a < 0, 'ring', ring, 'part', 0),
               'geometry', json_object('type', 'Polygon', 'coordinates', json_array(to_json(list_append(p, p[1]))))) AS VARCHAR) AS value
      FROM pts JOIN area USING (run_id, ring) JOIN bd ON bd.idx = pts.cls)""", ("cells_h", "bd"))
def _(s, d):
    f = vectors.ring_features(cut(_rings(s, d), "rings"), TRANSFORM, DX * DX / 1e6, per=1 << 20)
    return bands.isochrone_features(f.withColumn("km2", F.round("km2", 4)).withColumn("part", F.col("part").cast("int")), fa.band_label(F.col("cls")))


@query("jn8_buildings_in_flood", "JN8 GEO3", """
    SELECT run_id, count(DISTINCT CASE WHEN new_flood THEN building_id END) AS features FROM buildings LEFT JOIN cells_h USING (run_id, r, c)
    GROUP BY run_id""", ("buildings", "cells_h"))
def _(s, d):
    b = view(s, d, "buildings").select("run_id", F.col("building_id").alias("feature_id"), "r", "c")
    return vectors.features_in_flood(b, enriched(s, d).where("new_flood"))


@query("jn9_flooded_road_km", "JN9 GEO3 AGG14", f"SELECT run_id, round(km, 6) AS km FROM ({_KM})", ("roads", "cells_h"))
def _(s, d):
    return rounded(_flooded_km(s, d, enriched(s, d)))


@query("geo3_polygon_cells", "GEO3", """
    SELECT run_id, feature_id, count(*) AS cells FROM (
      SELECT DISTINCT q.run_id, q.poi_id AS feature_id, rr, cc FROM (
        SELECT run_id, poi_id, (x - 45) / 90.0 AS cx, (5760 - y - 45) / 90.0 AS ry FROM poi) q,
        unnest(range(-1, 4)) AS a(i), unnest(range(-1, 4)) AS b(j),
        LATERAL (SELECT CAST(floor(ry - 0.7) AS INT) + i AS rr, CAST(floor(cx - 1.2) AS INT) + j AS cc)
      WHERE rr < ry + 0.8 AND rr + 1 > ry - 0.7 AND cc < cx + 1.3 AND cc + 1 > cx - 1.2) GROUP BY ALL""", ("poi",))
def _(s, d):
    p = view(s, d, "poi")
    cx, ry = (F.col("x") - 45.0), (F.col("y") + 45.0)
    def v(a, b):
        return F.struct((cx + a * 90.0).alias("x"), (ry - b * 90.0).alias("y"))
    ring = F.array(v(-1.2, -0.7), v(1.3, -0.7), v(1.3, 0.8), v(-1.2, 0.8))
    poly = p.select("run_id", F.col("poi_id").alias("feature_id"), ring.alias("ring"))
    return vectors.polygons_to_cells(poly, DX, 0.0, NY * DX).groupBy("run_id", "feature_id").agg(F.count("*").alias("cells"))


# --- near field and confinement ---------------------------------------------------------------

def _with_seeds(s, d, own):
    """Cells and sources together: a source counts also where no frame was ever written."""
    return own.withColumn("own", F.lit(True)).join(_seeds(s, d).withColumn("seed", F.lit(True)), grid.CELL, "full").withColumn(
        "own", F.coalesce("own", F.lit(False))).withColumn("seed", F.coalesce("seed", F.lit(False)))


@query("geo5_distance_to_source", "GEO5", """
    SELECT x.run_id, x.r, x.c, CAST(min((x.r - z.r) * (x.r - z.r) + (x.c - z.c) * (x.c - z.c)) AS BIGINT) AS d2
    FROM cells x JOIN seeds z USING (run_id) GROUP BY ALL""", ("cells", "seeds"))
def _(s, d):
    c = _with_seeds(s, d, cells(s, d).select(*grid.CELL))
    return terrain.nearest_seed(c, "seed", False).where("own AND d2 IS NOT NULL").select(*grid.CELL, "d2")


@query("agg27_near_field_profile", "AGG27", """
    SELECT run_id, radius, coalesce(max(max_depth) FILTER (WHERE d2 > radius * radius), 0) AS peak_beyond,
           count(*) FILTER (WHERE d2 <= radius * radius) AS excluded, round(count(*) FILTER (WHERE d2 <= radius * radius) * 0.0081, 6) AS excluded_km2
    FROM (SELECT x.run_id, x.r, x.c, any_value(x.max_depth) AS max_depth,
                 min((x.r - z.r) * (x.r - z.r) + (x.c - z.c) * (x.c - z.c)) AS d2
          FROM cells_h x JOIN seeds z USING (run_id)
          WHERE x.flood GROUP BY ALL) CROSS JOIN (VALUES (0), (6), (10), (20), (30), (40)) AS t(radius) GROUP BY ALL""", ("cells_h", "seeds"))
def _(s, d):
    return rounded(exposure.near_field(_far(s, d), (0, 6, 10, 20, 30, 40), DX))


def _far(s, d):
    c = _with_seeds(s, d, enriched(s, d).select(*grid.CELL, "max_depth", "flood"))
    return terrain.nearest_seed(c, "seed", False).where("own AND flood AND d2 IS NOT NULL")


@query("agg27_far_field", "AGG27", """
    SELECT run_id, count(*) AS cells, round(quantile_cont(max_depth, 0.5), 6) AS median, round(quantile_cont(max_depth, 0.95), 6) AS p95, max(max_depth) AS peak
    FROM (SELECT x.run_id, x.r, x.c, any_value(x.max_depth) AS max_depth, min((x.r - z.r) * (x.r - z.r) + (x.c - z.c) * (x.c - z.c)) AS d2
          FROM cells_h x JOIN seeds z USING (run_id) WHERE x.flood GROUP BY ALL) WHERE d2 > 100 GROUP BY run_id""", ("cells_h", "seeds"))
def _(s, d):
    return rounded(exposure.far_field(_far(s, d), 10))


@query("agg27_depth_quantiles", "AGG27", """
    SELECT run_id, 0.5::DOUBLE AS q, round(quantile_cont(max_depth, 0.5), 6) AS value FROM cells_h WHERE flood GROUP BY run_id
    UNION ALL SELECT run_id, 0.95::DOUBLE, round(quantile_cont(max_depth, 0.95), 6) FROM cells_h WHERE flood GROUP BY run_id""", ("cells_h",))
def _(s, d):
    from floodspark.operators.quantiles import exact_quantiles
    return rounded(exact_quantiles(enriched(s, d).where("flood"), ["run_id"], "max_depth", [0.5, 0.95]))


@query("agg28_confined_reaches", "AGG28", """
    SELECT run_id, count(*) FILTER (WHERE conf) AS confined, count(*) FILTER (WHERE NOT conf) AS resolved,
           coalesce(max(max_depth) FILTER (WHERE conf), 0) AS peak_confined, coalesce(max(max_depth) FILTER (WHERE NOT conf), 0) AS peak_resolved
    FROM (SELECT x.*, (SELECT count(*) FROM cells_h y WHERE y.run_id = x.run_id AND y.max_depth > 0.1 AND abs(y.r - x.r) <= 1 AND abs(y.c - x.c) <= 1)
                      < (least(x.r + 1, 63) - greatest(x.r - 1, 0) + 1) * (least(x.c + 1, 63) - greatest(x.c - 1, 0) + 1) AS conf
          FROM cells_h x WHERE x.max_depth > 0.1) GROUP BY run_id""", ("cells_h",))
def _(s, d):
    c = terrain.confined(cells(s, d).where("max_depth > 0.1"), _square(cells(s, d)))
    def peak(m):
        return F.coalesce(F.max(F.when(m, F.col("max_depth"))), F.lit(0.0))
    return c.groupBy("run_id").agg(F.count_if("confined").alias("confined"), F.count_if(~F.col("confined")).alias("resolved"),
                                   peak(F.col("confined")).alias("peak_confined"), peak(~F.col("confined")).alias("peak_resolved"))


def _square(e):
    return e.select("run_id").distinct().withColumn("ny", F.lit(NY)).withColumn("nx", F.lit(NX))


@query("agg28_half_width_bins", "AGG28 GEO5", """
    SELECT run_id, half_width, max(max_depth) AS peak, round(quantile_cont(max_depth, 0.5), 6) AS median, count(*) AS cells, round(count(*) * 0.0081, 6) AS km2
    FROM (SELECT w.run_id, w.r, w.c, any_value(w.max_depth) AS max_depth, sqrt(min((w.r - x.r) * (w.r - x.r) + (w.c - x.c) * (w.c - x.c))) AS away
          FROM cells w JOIN (SELECT q.run_id, a.r, b.c FROM (SELECT DISTINCT run_id FROM cells) q, (SELECT unnest(range(64)) AS r) a, (SELECT unnest(range(64)) AS c) b
                             ANTI JOIN (SELECT run_id, r, c FROM cells WHERE max_depth > 0.1) k ON k.run_id = q.run_id AND k.r = a.r AND k.c = b.c) x ON x.run_id = w.run_id
          WHERE w.max_depth > 0.1 GROUP BY w.run_id, w.r, w.c)
    JOIN (VALUES (0.0), (1.0), (1.5), (2.0), (2.5), (3.0)) AS t(half_width) ON away >= half_width GROUP BY run_id, half_width""", ("cells",))
def _(s, d):
    e = cut(cells(s, d).select(*grid.CELL, "max_depth"), "cells")
    return rounded(terrain.width_bins(e.where("max_depth > 0.1"), _square(e), DX))


@query("win1_front_speed", "WIN1 JN14", """
    SELECT run_id, r, c, round(CASE WHEN t IS NOT NULL AND g > 0 THEN 1.0 / g END, 6) AS front_speed FROM (
      SELECT *, sqrt(gx * gx + gy * gy) AS g FROM (
        SELECT run_id, r, c, t,
          CASE WHEN c = 0 THEN (e - t) / 90.0 WHEN c = 63 THEN (t - w) / 90.0 ELSE (e - w) / 180.0 END AS gx,
          CASE WHEN r = 0 THEN (s - t) / 90.0 WHEN r = 63 THEN (t - n) / 90.0 ELSE (s - n) / 180.0 END AS gy
        FROM (SELECT a.run_id, a.r, a.c, a.arrival_s AS t, e.arrival_s AS e, w.arrival_s AS w, s.arrival_s AS s, n.arrival_s AS n
              FROM cells a LEFT JOIN cells e ON e.run_id = a.run_id AND e.r = a.r AND e.c = a.c + 1
              LEFT JOIN cells w ON w.run_id = a.run_id AND w.r = a.r AND w.c = a.c - 1
              LEFT JOIN cells s ON s.run_id = a.run_id AND s.r = a.r + 1 AND s.c = a.c
              LEFT JOIN cells n ON n.run_id = a.run_id AND n.r = a.r - 1 AND n.c = a.c)))""", ("cells",))
def _(s, d):
    e = cells(s, d).select(*grid.CELL, "arrival_s")
    return rounded(terrain.front_speed(e, _square(e), DX).select(
        *grid.CELL, "front_speed"))
