"""Conditioning, drainage, components, land cover and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.functions import geodesy as geo
from floodspark.operators import components as comp
from floodspark.operators import hydrology as hyd
from floodspark.operators import masks, resample, terrain
from floodspark.operators.sampling import window_join
from floodspark.queries.base import DERIVED, query, rounded
from floodspark.session import cut
from floodspark.sources import rasters
from floodspark.sources.tables import DX, view

TILE = 64


def _dem(s, d):
    return view(s, d, "dem")


def _solid(s, d):
    """The grid with voids filled, ready to route."""
    return terrain.fill_voids(_dem(s, d))


def _flow(s, d):
    return hyd.flow_direction(_dem(s, d), "z", DX)


def _drain(s, d):
    return hyd.with_stream(hyd.flow_accumulation(cut(_flow(s, d), "flow"), TILE), DX, 0.08)


def _routed(s, d):
    return hyd.analyse_flow(cut(_solid(s, d), "solid"), DX, 0.08, TILE)


@query("jn15_void_fill", "JN15", """
    SELECT d.run_id, d.r, d.c, CASE WHEN d.valid THEN d.z ELSE n.z END AS z FROM dem d LEFT JOIN (
      SELECT v.run_id, v.r, v.c, arg_min(x.z, struct_pack(a := (v.r - x.r) * (v.r - x.r) + (v.c - x.c) * (v.c - x.c), b := x.r, c := x.c)) AS z
      FROM dem v JOIN dem x ON x.run_id = v.run_id WHERE NOT v.valid AND x.valid GROUP BY ALL) n USING (run_id, r, c)""", ("dem",))
def _(s, d):
    return _solid(s, d).select(*grid.CELL, "z")


@query("gr2_flow_direction", "GR2 GEO9 JN14", """
    SELECT run_id, r, c, coalesce([1, 2, 4, 8, 16, 32, 64, 128][dir + 1], 0) AS d8, down_r, down_c FROM flow""", ("flow",))
def _(s, d):
    return _flow(s, d).select(*grid.CELL, "d8", "down_r", "down_c")


@query("gr3_flow_accumulation", "GR3 GR5 PRJ16", """
    SELECT run_id, r, c, acc, round(area_km2, 6) AS area_km2, stream FROM drain""", ("drain",))
def _(s, d):
    return rounded(_drain(s, d).select(*grid.CELL, "acc", "area_km2", "stream"))


_HAND = """
    SELECT w.run_id, w.r, w.c, w.z0 - w.z AS hand FROM (
      WITH RECURSIVE walk AS (
        SELECT run_id, r, c, z AS z0, z, down_r, down_c, stream OR down_r IS NULL AS fin FROM drain
        UNION ALL
        SELECT w.run_id, w.r, w.c, w.z0, f.z, f.down_r, f.down_c, f.stream OR f.down_r IS NULL
        FROM walk w JOIN drain f ON f.run_id = w.run_id AND f.r = w.down_r AND f.c = w.down_c WHERE NOT w.fin)
      SELECT * FROM walk WHERE fin) w"""


@query("gr4_height_above_drainage", "GR4", _HAND, ("drain",))
def _(s, d):
    return hyd.height_above_drainage(cut(_drain(s, d), "drain"), TILE).select(*grid.CELL, "hand")


def _hand(s, d):
    return hyd.height_above_drainage(cut(_drain(s, d), "drain"), TILE)


@query("prj4_valley_mask", "PRJ4", f"SELECT run_id, r, c FROM ({_HAND}) WHERE hand <= 40", ("drain",))
def _(s, d):
    return _hand(s, d).where("hand <= 40").select(*grid.CELL)


@query("prj5_mask_is_safe", "PRJ5 GEO6", f"""
    SELECT run_id, count(*) FILTER (WHERE NOT inner_ AND z < 990) AS touching, count(*) FILTER (WHERE NOT inner_ AND z < 990) = 0 AS safe
    FROM (SELECT m.run_id, m.r, m.c, any_value(m.z) AS z, count(n.r) = 13 AS inner_
          FROM (SELECT h.*, d.z FROM ({_HAND}) h JOIN dem d USING (run_id, r, c) WHERE hand <= 40) m
          LEFT JOIN (SELECT * FROM ({_HAND}) WHERE hand <= 40) n
            ON n.run_id = m.run_id AND n.r BETWEEN m.r - 2 AND m.r + 2 AND abs(n.r - m.r) + abs(n.c - m.c) <= 2
          GROUP BY ALL) GROUP BY run_id""", ("drain",))
def _(s, d):
    h = cut(_hand(s, d), "hand")
    return masks.mask_is_safe(h, h.where("z < 990"), 40.0, 2)


@query("agg23_hydrology_summary", "AGG23", f"""
    SELECT run_id, count(*) FILTER (WHERE stream) AS stream_cells, round(100.0 * count(*) FILTER (WHERE stream) / count(*), 6) AS stream_pct,
           round(max(area_km2), 6) AS max_km2, min(hand) AS hand_min, max(hand) AS hand_max,
           count(*) FILTER (WHERE hand < -0.000001) AS negative_hand,
           round(100.0 * count(*) FILTER (WHERE hand <= 50) / count(*), 6) AS hand_le_50_pct,
           round(100.0 * count(*) FILTER (WHERE hand <= 100) / count(*), 6) AS hand_le_100_pct,
           round(100.0 * count(*) FILTER (WHERE hand <= 150) / count(*), 6) AS hand_le_150_pct,
           round(100.0 * count(*) FILTER (WHERE hand <= 300) / count(*), 6) AS hand_le_300_pct
    FROM drain JOIN ({_HAND}) USING (run_id, r, c) GROUP BY run_id""", ("drain",))
def _(s, d):
    return rounded(terrain.hydrology_summary(_hand(s, d)))


@query("agg23_terrain_summary", "AGG23", """
    SELECT run_id, max(r) + 1 AS ny, max(c) + 1 AS nx, min(z) FILTER (WHERE valid) AS z_min, max(z) FILTER (WHERE valid) AS z_max,
           count(*) FILTER (WHERE NOT valid) AS voids, round(100.0 * count(*) FILTER (WHERE NOT valid) / count(*), 6) AS void_pct
    FROM dem GROUP BY run_id""", ("dem",))
def _(s, d):
    return rounded(terrain.terrain_summary(_dem(s, d), DX))


# the smallest level that reaches the border, relaxed until nothing changes
_FILL = """
    SELECT run_id, r, c, w AS filled FROM (
      WITH RECURSIVE lake(run_id, r, c, w) USING KEY (run_id, r, c) AS (
        SELECT run_id, r, c, z AS w FROM dem JOIN (SELECT run_id, max(r) AS mr, max(c) AS mc FROM dem GROUP BY run_id) USING (run_id)
        WHERE r = 0 OR c = 0 OR r = mr OR c = mc
        UNION
        SELECT n.run_id, n.r, n.c, min(greatest(n.z, l.w)) AS w FROM lake l
        CROSS JOIN (VALUES (0,1),(1,1),(1,0),(1,-1),(0,-1),(-1,-1),(-1,0),(-1,1)) AS o(dr, dc)
        JOIN dem n ON n.run_id = l.run_id AND n.r = l.r + o.dr AND n.c = l.c + o.dc
        LEFT JOIN recurring.lake k ON k.run_id = n.run_id AND k.r = n.r AND k.c = n.c
        GROUP BY n.run_id, n.r, n.c HAVING any_value(k.w) IS NULL OR min(greatest(n.z, l.w)) < any_value(k.w))
      SELECT * FROM lake)"""


@query("gr1_depression_fill", "GR1", _FILL, ("dem",))
def _(s, d):
    return hyd.fill_depressions(_dem(s, d), TILE).select(*grid.CELL, "filled")


@query("agg38_depression_report", "AGG38 GR12", f"""
    SELECT run_id, count(*) FILTER (WHERE filled > z) AS cells_filled, round(max(filled - z), 3) AS max_depth,
           round(sum(filled - z) * 8100.0, 3) AS storage_removed_m3
    FROM ({_FILL}) JOIN dem USING (run_id, r, c) GROUP BY run_id""", ("dem",))
def _(s, d):
    return rounded(terrain.fill_report(terrain.capped_fill(_dem(s, d), None, TILE), DX), 3)


# the whole chain: voids filled, depressions filled, steps across flats, flow, areas, heights above drainage
_AROUND = "(VALUES (0,1),(1,1),(1,0),(1,-1),(0,-1),(-1,-1),(-1,0),(-1,1)) AS o(dr, dc)"
DERIVED["solid"] = (("dem",), """
    SELECT d.run_id, d.r, d.c, CASE WHEN d.valid THEN d.z ELSE n.z END AS z FROM dem d LEFT JOIN (
      SELECT v.run_id, v.r, v.c, arg_min(x.z, struct_pack(a := (v.r - x.r) * (v.r - x.r) + (v.c - x.c) * (v.c - x.c), b := x.r, c := x.c)) AS z
      FROM dem v JOIN dem x ON x.run_id = v.run_id WHERE NOT v.valid AND x.valid GROUP BY ALL) n USING (run_id, r, c)""")
DERIVED["lake"] = (("solid",), f"SELECT run_id, r, c, z, filled FROM ({_FILL.replace('dem', 'solid')}) JOIN solid USING (run_id, r, c)")
DERIVED["flats"] = (("lake",), f"""
    SELECT l.run_id, l.r, l.c, any_value(l.z) AS z, any_value(l.filled) AS filled,
           count(n.filled) = 8 AND count(*) FILTER (WHERE n.filled < l.filled) = 0 AS flat
    FROM lake l CROSS JOIN {_AROUND} LEFT JOIN lake n ON n.run_id = l.run_id AND n.r = l.r + o.dr AND n.c = l.c + o.dc GROUP BY l.run_id, l.r, l.c""")
DERIVED["surface"] = (("flats",), f"""
    SELECT run_id, r, c, z, filled, filled + 0.000001 * coalesce(d, 0) AS zr FROM flats LEFT JOIN (
      WITH RECURSIVE away(run_id, r, c, w, d) USING KEY (run_id, r, c) AS (
        SELECT run_id, r, c, filled AS w, 0.0 AS d FROM flats WHERE NOT flat
        UNION
        SELECT n.run_id, n.r, n.c, any_value(n.filled) AS w, min(a.d) + 1.0 AS d FROM away a CROSS JOIN {_AROUND}
        JOIN flats n ON n.run_id = a.run_id AND n.r = a.r + o.dr AND n.c = a.c + o.dc AND n.flat AND n.filled = a.w
        LEFT JOIN recurring.away k ON k.run_id = n.run_id AND k.r = n.r AND k.c = n.c
        GROUP BY n.run_id, n.r, n.c HAVING any_value(k.d) IS NULL OR min(a.d) + 1.0 < any_value(k.d))
      SELECT run_id, r, c, d FROM away) USING (run_id, r, c)""")
DERIVED["routed"] = (("surface",), DERIVED["flow"][1].replace("FROM dem d", "FROM surface d").replace("LEFT JOIN dem n", "LEFT JOIN surface n")
                     .replace("d.z - n.z", "d.zr - n.zr").replace("count(n.z)", "count(n.zr)")
                     .replace("any_value(d.z) AS z", "any_value(d.z) AS z, any_value(d.filled) AS filled, any_value(d.zr) AS zr"))
DERIVED["river_acc"] = (("routed",), DERIVED["acc"][1].replace("flow", "routed"))
DERIVED["river"] = (("routed", "river_acc"), DERIVED["drain"][1].replace("FROM flow f JOIN acc a", "FROM routed f JOIN river_acc a"))
FINE = 16


@query("gr1_gr4_full_flow_analysis", "GR1 GR2 GR3 GR4 GR5", f"""
    SELECT run_id, r, c, filled, round(zr, 9) AS zr, coalesce([1, 2, 4, 8, 16, 32, 64, 128][dir + 1], 0) AS d8, acc, stream, hand
    FROM river JOIN ({_HAND.replace("drain", "river")}) USING (run_id, r, c)""", ("river",))
def _(s, d):
    out = hyd.analyse_flow(cut(_solid(s, d), "solid"), DX, 0.08, FINE)
    return out.select(*grid.CELL, "filled", F.round("zr", 9).alias("zr"), "d8", "acc", "stream", "hand")


@query("agg24_routing_checks", "AGG24", """
    SELECT run_id, 0 AS interior_orphans, CAST(count(*) AS DOUBLE) AS outlet_total, count(*) AS cells, 0 AS lowered FROM dem GROUP BY run_id""",
       ("dem",))
def _(s, d):
    return hyd.routing_checks(_routed(s, d)).drop("negative_hand")


def _starts(s, d):
    return view(s, d, "poi").select(F.floor(F.col("poi_id") / 100.0).cast("int").alias("run_id"), F.col("poi_id").alias("start_id"),
                                    (F.col("poi_id") * 7 % 30).alias("r"), (F.col("poi_id") * 11 % 50).alias("c"))


_TRACE = """
    SELECT * FROM (
      WITH RECURSIVE walk AS (
        SELECT f.run_id, p.poi_id AS start_id, f.r, f.c, 0 AS k, f.down_r, f.down_c, f.z FROM poi p
        JOIN routed f ON f.run_id = CAST(floor(p.poi_id / 100.0) AS INT) AND f.r = p.poi_id * 7 % 30 AND f.c = p.poi_id * 11 % 50
        UNION ALL
        SELECT w.run_id, w.start_id, f.r, f.c, w.k + 1, f.down_r, f.down_c, f.z
        FROM walk w JOIN routed f ON f.run_id = w.run_id AND f.r = w.down_r AND f.c = w.down_c)
      SELECT * FROM walk)"""
_PROFILE = f"""
    SELECT run_id, start_id, r, c, k, z, sum(step) OVER (PARTITION BY start_id ORDER BY k) AS dist_m FROM (
      SELECT *, coalesce(90.0 * sqrt((r - lag(r) OVER w) * (r - lag(r) OVER w) + (c - lag(c) OVER w) * (c - lag(c) OVER w)), 0) AS step
      FROM ({_TRACE}) WINDOW w AS (PARTITION BY start_id ORDER BY k))"""


def _river(s, d, acc=False):
    """Flow over the filled surface, across its flats too."""
    filled = cut(hyd.fill_depressions(_solid(s, d).select(*grid.CELL, "z"), TILE), "filled")
    flow = cut(hyd.flow_direction(hyd.routing_surface(filled, tile=TILE), "zr", DX), "flow")
    return cut(hyd.with_stream(hyd.flow_accumulation(flow, TILE), DX, 0.08), "river") if acc else flow


def _trace(s, d, flow=None):
    return hyd.trace_downstream(_river(s, d) if flow is None else flow, _starts(s, d), FINE)


@query("gr6_trace_distance", "GR6 WIN3", f"SELECT run_id, start_id, r, c, k, round(dist_m, 6) AS dist_m FROM ({_PROFILE})", ("poi", "routed"))
def _(s, d):
    return rounded(hyd.path_distance(_trace(s, d), DX))


@query("win10_trace_profile", "WIN10", f"SELECT run_id, start_id, k, z, round(dist_m, 6) AS dist_m FROM ({_PROFILE})", ("poi", "routed"))
def _(s, d):
    flow = _river(s, d)
    return rounded(hyd.trace_profile(_trace(s, d, flow), flow, DX, "z").select("run_id", "start_id", "k", "z", "dist_m"))


@query("win10_bed_drop", "WIN10", f"""
    SELECT run_id, start_id, count(*) AS steps, round(max(dist_m), 6) AS length_m, arg_min(z, k) - arg_max(z, k) AS drop_m,
           round(1000.0 * (arg_min(z, k) - arg_max(z, k)) / greatest(max(dist_m), 1.0), 6) AS drop_per_km
    FROM ({_PROFILE}) GROUP BY run_id, start_id""", ("poi", "routed"))
def _(s, d):
    flow = _river(s, d)
    return rounded(hyd.bed_drop(hyd.trace_profile(_trace(s, d, flow), flow, DX, "z")))


@query("jn10_points_on_trace", "JN10", f"""
    SELECT p.poi_id, min(t.k) AS k FROM (SELECT poi_id, CAST(floor(poi_id / 100.0) AS INT) AS run_id, poi_id * 3 % 30 AS r, 20 + poi_id % 11 AS c FROM poi) p
    LEFT JOIN ({_TRACE}) t ON t.run_id = p.run_id AND t.r = p.r AND t.c = p.c GROUP BY p.poi_id""", ("poi", "routed"))
def _(s, d):
    p = view(s, d, "poi").select("poi_id", F.floor(F.col("poi_id") / 100.0).cast("int").alias("run_id"), (F.col("poi_id") * 3 % 30).alias("r"),
                                 (20 + F.col("poi_id") % 11).alias("c"))
    return p.join(_trace(s, d), grid.CELL, "left").groupBy("poi_id").agg(F.min("k").alias("k"))


@query("win4_confluences", "WIN4", f"""
    SELECT run_id, start_id, k, round(area, 6) AS area, round(prev, 6) AS prev FROM (
      SELECT t.run_id, start_id, k, a.area_km2 AS area, lag(a.area_km2) OVER (PARTITION BY start_id ORDER BY k) AS prev
      FROM (SELECT *, count(*) OVER (PARTITION BY start_id) AS n FROM ({_TRACE})) t JOIN river a USING (run_id, r, c)
      WHERE k % greatest(1, n // 20) = 0) WHERE area > 1.6 * prev""", ("poi", "river"))
def _(s, d):
    river = _river(s, d, acc=True)
    return rounded(hyd.confluences(_trace(s, d, river), river))


def _points(s, d):
    return _starts(s, d).withColumnRenamed("start_id", "point_id")


_SNAPW = """SELECT p.poi_id AS point_id, f.r, f.c, f.area_km2,
    (f.r - p.poi_id * 7 % 30) ** 2 + (f.c - p.poi_id * 11 % 50) ** 2 AS d2 FROM poi p JOIN drain f ON f.run_id = CAST(floor(p.poi_id / 100.0) AS INT)
    AND abs(f.r - p.poi_id * 7 % 30) <= {r} AND abs(f.c - p.poi_id * 11 % 50) <= {r}"""


@query("gr7_snap_to_stream", "GR7 JN6 WIN6", f"""
    SELECT b.point_id, b.snap.r AS snap_r, b.snap.c AS snap_c, round(-b.snap.na, 6) AS area_km2, round(w.best, 6) AS best_nearby_km2,
           w.best > 5 * -b.snap.na AS suspect
    FROM (SELECT point_id, min(struct_pack(d2 := d2, na := -area_km2, r := r, c := c)) AS snap
          FROM (SELECT *, max(area_km2) OVER (PARTITION BY point_id) AS peak FROM ({_SNAPW.format(r=4)}))
          WHERE area_km2 >= 0.5 * peak GROUP BY point_id) b
    JOIN (SELECT point_id, max(area_km2) AS best FROM ({_SNAPW.format(r=8)}) GROUP BY point_id) w USING (point_id)""",
       ("poi", "drain"))
def _(s, d):
    return rounded(hyd.snap_to_stream(_points(s, d), cut(_drain(s, d), "drain"), DX, 4).select(
        "point_id", "snap_r", "snap_c", "area_km2", "best_nearby_km2", "suspect"))


@query("gr8_injection_cell", "GR8", f"""
    SELECT p.poi_id AS point_id, inj_r, inj_c, CASE WHEN inj_r IS NULL THEN 'no cell below the dam outside the pool' END AS problem
    FROM poi p LEFT JOIN (SELECT point_id, min(struct_pack(d2 := d2, r := r, c := c)).r AS inj_r, min(struct_pack(d2 := d2, r := r, c := c)).c AS inj_c
    FROM (SELECT x.*, max(x.area_km2) OVER (PARTITION BY point_id) AS best FROM ({_SNAPW.format(r=4)}) x
          JOIN drain q ON q.run_id = CAST(floor(x.point_id / 100.0) AS INT) AND q.r = x.r AND q.c = x.c
          JOIN drain k ON k.run_id = CAST(floor(x.point_id / 100.0) AS INT) AND k.r = x.point_id * 7 % 30 AND k.c = x.point_id * 11 % 50
          WHERE q.z <= k.z AND NOT (x.r < 3))
    WHERE area_km2 >= 0.5 * best GROUP BY point_id) b ON b.point_id = p.poi_id""", ("poi", "drain"))
def _(s, d):
    c = cut(_drain(s, d), "drain").withColumn("pool", F.col("r") < 3)
    return hyd.injection_cell(_points(s, d), c, DX, 4).select("point_id", "inj_r", "inj_c", "problem")


@query("gr9_injection_footprint", "GR9", f"""
    SELECT start_id, r, c, k FROM (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY k) AS rank
      FROM ({_TRACE}) WHERE NOT (r < 3)) WHERE rank <= 4""", ("poi", "routed"))
def _(s, d):
    pool = _dem(s, d).where("r < 3")
    return hyd.injection_footprint(_trace(s, d), pool, 4, DX).select("start_id", "r", "c", "k")


_COMP = """
    SELECT run_id, r, c, lab FROM (
      WITH RECURSIVE grow(run_id, r, c, lab) USING KEY (run_id, r, c) AS (
        SELECT run_id, r, c, r * 100000 + c AS lab FROM low
        UNION
        SELECT n.run_id, n.r, n.c, min(g.lab) AS lab FROM grow g
        CROSS JOIN (VALUES (0,1),(1,0),(0,-1),(-1,0){diag}) AS o(dr, dc)
        JOIN low n ON n.run_id = g.run_id AND n.r = g.r + o.dr AND n.c = g.c + o.dc
        JOIN recurring.grow k ON k.run_id = n.run_id AND k.r = n.r AND k.c = n.c
        GROUP BY n.run_id, n.r, n.c HAVING min(g.lab) < any_value(k.lab))
      SELECT * FROM grow)"""
DERIVED["lakes"] = (("dem",), f"SELECT run_id, r, c, z, filled AS w FROM ({_FILL}) JOIN dem USING (run_id, r, c)")
DERIVED["lakebed"] = (("lakes",), "SELECT run_id, r, c FROM lakes WHERE w > z")


@query("gr12_capped_fill", "GR12 GR10", f"""
    SELECT l.run_id, l.r, l.c, CASE WHEN deep THEN l.z ELSE l.w END AS filled, CASE WHEN deep THEN 0.0 ELSE l.w - l.z END AS depth FROM lakes l
    LEFT JOIN (SELECT *, bool_or(w - z > 1.0) OVER (PARTITION BY run_id, lab) AS deep FROM ({_COMP.format(diag="").replace("FROM low", "FROM lakebed").replace("JOIN low n", "JOIN lakebed n")})
               JOIN lakes USING (run_id, r, c)) q USING (run_id, r, c)""", ("lakes", "lakebed"))
def _(s, d):
    return terrain.capped_fill(_dem(s, d), 1.0, TILE).select(*grid.CELL, "filled", "depth")


_LOW = "(SELECT run_id, r, c FROM dem WHERE (r * 13 + c * 7 + CAST(z AS INT)) % 5 < 3)"


def _low(s, d):
    return _dem(s, d).withColumn("low", (F.col("r") * 13 + F.col("c") * 7 + F.bround("z", 0).cast("int")) % 5 < 3)


@query("gr10_components", "GR10", _COMP.format(diag="").replace("low", "low_").replace(
    "FROM low_", f"FROM {_LOW}").replace("JOIN low_ n", f"JOIN {_LOW} n"), ("dem",))
def _(s, d):
    lab = comp.components(_low(s, d), "low", False, TILE)
    return lab.select(*grid.CELL, (F.floor(F.col("component") / comp.WIDE) * 100000 + F.col("component") % comp.WIDE).alias("lab"))


@query("gr10_component_sizes_diagonal", "GR10 GR13", f"""
    SELECT run_id, lab, count(*) AS size FROM ({_COMP.format(diag=",(1,1),(1,-1),(-1,1),(-1,-1)").replace("FROM low", f"FROM {_LOW}").replace("JOIN low n", f"JOIN {_LOW} n")})
    GROUP BY ALL HAVING count(*) >= 8""", ("dem",))
def _(s, d):
    kept = comp.drop_small(cut(comp.components(_low(s, d), "low", True, TILE), "lab"), fixed.SAR_MIN_BLOB_PX)
    return kept.withColumn("lab", F.floor(F.col("component") / comp.WIDE) * 100000 + F.col("component") % comp.WIDE).groupBy(
        "run_id", "lab").agg(F.count("*").alias("size"))


@query("agg43_component_ledger", "AGG43", f"""
    SELECT run_id, lab, cells, round(volume, 3) AS volume, round(volume / sum(volume) OVER (PARTITION BY run_id), 6) AS share,
           row_number() OVER (PARTITION BY run_id ORDER BY volume DESC, lab) AS rank
    FROM (SELECT run_id, lab, count(*) AS cells, sum(greatest(1100.0 - z, 0)) * 8100.0 AS volume FROM ({_COMP.format(diag="").replace("FROM low", f"FROM {_LOW}").replace("JOIN low n", f"JOIN {_LOW} n")})
          JOIN dem USING (run_id, r, c) GROUP BY ALL) QUALIFY rank <= 12""", ("dem",))
def _(s, d):
    from pyspark.sql import Window
    lab = comp.components(_low(s, d), "low", False, TILE).join(_dem(s, d).select(*grid.CELL, "z"), grid.CELL)
    per = comp.per_component(lab, cells=F.count("*"), volume=F.sum(F.greatest(F.lit(1100.0) - F.col("z"), F.lit(0.0))) * DX * DX)
    tot = per.groupBy("run_id").agg(F.sum("volume").alias("all_"))
    w = Window.partitionBy("run_id").orderBy(F.col("volume").desc(), "component")
    top = per.join(tot, "run_id").withColumn("share", F.col("volume") / F.col("all_")).withColumn("rank", F.row_number().over(w))
    lab = F.floor(F.col("component") / comp.WIDE) * 100000 + F.col("component") % comp.WIDE
    return top.where("rank <= 12").select("run_id", lab.alias("lab"), "cells", F.round("volume", 3).alias("volume"),
                                          F.round("share", 6).alias("share"), "rank")


@query("agg43_home_component", "AGG43", f"""
    SELECT * FROM (WITH lab AS (SELECT run_id, r, c, lab, greatest(1100.0 - z, 0) * 8100.0 AS v
                 FROM ({_COMP.format(diag="").replace("FROM low", f"FROM {_LOW}").replace("JOIN low n", f"JOIN {_LOW} n")}) JOIN dem USING (run_id, r, c)),
    home AS (SELECT run_id, arg_min(lab, struct_pack(a := (r - 10) * (r - 10) + (c - 25) * (c - 25), b := r, c := c)) AS home FROM lab GROUP BY run_id)
    SELECT run_id, any_value(home) AS home, round(sum(v), 3) AS total, round(coalesce(sum(v) FILTER (WHERE lab = home), 0), 3) AS home_volume,
           round(1 - coalesce(sum(v) FILTER (WHERE lab = home), 0) / sum(v), 6) AS stray, 1 - coalesce(sum(v) FILTER (WHERE lab = home), 0) / sum(v) > 0.02 AS leaks
    FROM lab JOIN home USING (run_id) GROUP BY run_id)""", ("dem",))
def _(s, d):
    lab = cut(comp.components(_low(s, d), "low", False, FINE).join(_dem(s, d).select(*grid.CELL, "z"), grid.CELL), "lab")
    per = comp.per_component(lab, volume=F.sum(F.greatest(F.lit(1100.0) - F.col("z"), F.lit(0.0))) * DX * DX)
    out = comp.home_verdict(per, lab, _dams(s, d))
    home = F.floor(F.col("home") / comp.WIDE) * 100000 + F.col("home") % comp.WIDE
    return out.select("run_id", home.alias("home"), F.round("total", 3).alias("total"), F.round("home_volume", 3).alias("home_volume"),
                      F.round("stray", 6).alias("stray"), "leaks")


def _sizes(s, d):
    return grid.grid_sizes(_dem(s, d))


def _dams(s, d):
    return _sizes(s, d).select("run_id", F.lit(10).alias("r"), F.lit(25).alias("c"), F.lit(1.0e5).alias("published_m2"))


def _terraced(s, d):
    """The same grids with a lake surface cut into the valley floor."""
    return _dem(s, d).withColumn("z", F.when(F.col("z") < 1008, 1008.0).otherwise(F.col("z")))


_TERRACE = "(SELECT run_id, r, c, CASE WHEN z < 1008 THEN 1008.0 ELSE z END AS z FROM dem)"
DERIVED["terrace_flat"] = (("dem",), f"""
    SELECT x.run_id, x.r, x.c, x.z FROM {_TERRACE} x JOIN {_TERRACE} y
      ON y.run_id = x.run_id AND abs(y.r - x.r) + abs(y.c - x.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1
      AND abs(x.z - y.z) <= 0.01 GROUP BY ALL HAVING count(*) = 4""")
DERIVED["pool_flat"] = (("terrace_flat",), f"""
    SELECT p.run_id, p.r, p.c, p.lab, f.z FROM ({_COMP.format(diag="").replace("FROM low", "FROM terrace_flat").replace("JOIN low n", "JOIN terrace_flat n")}) p
    JOIN terrace_flat f USING (run_id, r, c)""")
DERIVED["pool_seed"] = (("pool_flat",), """
    SELECT run_id, lab, level FROM (SELECT run_id, lab, count(*) AS n, median(z) AS level FROM pool_flat GROUP BY ALL
                                     HAVING count(*) FILTER (WHERE abs(r - 10) <= 30 AND abs(c - 25) <= 30) > 0)
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, lab) = 1 AND n >= 25""")
DERIVED["pool_low"] = (("dem", "pool_seed"), f"SELECT t.run_id, t.r, t.c FROM {_TERRACE} t JOIN pool_seed USING (run_id) WHERE t.z <= level + 0.000001")


POOL_SQL = f"""
    SELECT run_id, max(level) AS level_m, round(count(*) * 0.0081, 6) AS area_km2, bool_or(r = 0) AS touches_j0, bool_or(r = mr) AS touches_jmax,
           bool_or(c = 0) AS touches_i0, bool_or(c = mc) AS touches_imax, 100000.0 AS published_m2, count(*) * 0.0081 > 0.1 * 1.05 AS suspect
    FROM (SELECT b.*, lab, first_value(lab) OVER (PARTITION BY b.run_id ORDER BY (r * 100000 + c = seed) DESC) AS home FROM (
            SELECT k.run_id, k.r, k.c, k.lab, q.lab AS seed, q.level FROM ({_COMP.format(diag="").replace("FROM low", "FROM pool_low").replace("JOIN low n", "JOIN pool_low n")}) k
            JOIN pool_seed q USING (run_id)) b)
    JOIN (SELECT run_id, max(r) AS mr, max(c) AS mc FROM dem GROUP BY run_id) USING (run_id) WHERE lab = home GROUP BY run_id"""


@query("gr11_pool_detection", "GR11 TOP7", POOL_SQL, ("dem", "pool_low"))
def _(s, d):
    dem = cut(_terraced(s, d), "dem")
    return rounded(terrain.pool_report(terrain.detect_pools(dem, _sizes(s, d), _dams(s, d), DX, tile=FINE), _sizes(s, d), _dams(s, d), DX))


@query("gr11_flat_cells", "GR11 JN14", """
    SELECT x.run_id, x.r, x.c FROM (SELECT run_id, r, c, CASE WHEN z < 1008 THEN 1008.0 ELSE z END AS z FROM dem) x
    JOIN (SELECT run_id, r, c, CASE WHEN z < 1008 THEN 1008.0 ELSE z END AS z FROM dem) y
      ON y.run_id = x.run_id AND abs(y.r - x.r) + abs(y.c - x.c) = 1 AND y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1
      AND abs(x.z - y.z) <= 0.01 GROUP BY ALL HAVING count(*) = 4""", ("dem",))
def _(s, d):
    return terrain.flat_cells(_terraced(s, d)).where("flat").select(*grid.CELL)


def _peaks(keep: int, apart: int) -> str:
    """The greedy choice written out: each peak is the largest cell clear of those before it."""
    steps = []
    for k in range(keep):
        clear = "".join(f" AND NOT EXISTS (SELECT 1 FROM p{j} WHERE p{j}.run_id = d.run_id AND abs(p{j}.r - d.r) < {apart}"
                        f" AND abs(p{j}.c - d.c) < {apart})" for j in range(k))
        steps.append(f"p{k} AS (SELECT run_id, b.r AS r, b.c AS c, -b.v AS v FROM (SELECT d.run_id, "
                     f"min(struct_pack(v := -d.area_km2, r := d.r, c := d.c)) AS b FROM drain d WHERE true{clear} GROUP BY d.run_id))")
    return (f"SELECT run_id, r, c, round(v, 6) AS v FROM (WITH {', '.join(steps)} "
            + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(keep)) + ")")


@query("top5_suppressed_peaks", "TOP5", _peaks(8, 15), ("drain",))
def _(s, d):
    return rounded(terrain.suppressed_peaks(_drain(s, d), "area_km2"))


@query("src8_coarsened_bed", "SRC8", """
    SELECT run_id, CAST(floor(r / 4) AS INT) AS r, CAST(floor(c / 4) AS INT) AS c, coalesce(round(avg(z) FILTER (WHERE valid), 6), 200.0) AS z,
           count(*) FILTER (WHERE valid) > 0 AS valid
    FROM dem JOIN (SELECT run_id, max(r) + 1 AS ny, max(c) + 1 AS nx FROM dem GROUP BY run_id) USING (run_id)
    WHERE r < floor(ny / 4) * 4 AND c < floor(nx / 4) * 4 GROUP BY 1, 2, 3""", ("dem",))
def _(s, d):
    return rounded(terrain.coarsen(_dem(s, d), _sizes(s, d), 4))


@query("win9_slope", "WIN9", """
    SELECT a.run_id, a.r, a.c, round(degrees(atan(sqrt(((e.z - w.z) / 180.0) ** 2 + ((s.z - n.z) / 180.0) ** 2))), 6) AS slope_deg
    FROM dem a LEFT JOIN dem e ON e.run_id = a.run_id AND e.r = a.r AND e.c = a.c + 1
    LEFT JOIN dem w ON w.run_id = a.run_id AND w.r = a.r AND w.c = a.c - 1
    LEFT JOIN dem s ON s.run_id = a.run_id AND s.r = a.r + 1 AND s.c = a.c
    LEFT JOIN dem n ON n.run_id = a.run_id AND n.r = a.r - 1 AND n.c = a.c""", ("dem",))
def _(s, d):
    return rounded(terrain.slope_degrees(_dem(s, d), DX).select(*grid.CELL, "slope_deg"))


@query("win8_focal_median", "WIN8", """
    SELECT a.run_id, a.r, a.c, round(median(b.z), 6) AS focal FROM dem a CROSS JOIN (SELECT x.i AS dr, y.i AS dc
      FROM (SELECT unnest(range(-2, 3)) AS i) x, (SELECT unnest(range(-2, 3)) AS i) y WHERE x.i * x.i + y.i * y.i <= 4) o
    JOIN dem b ON b.run_id = a.run_id AND b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY ALL""", ("dem",))
def _(s, d):
    return rounded(terrain.focal_median(_dem(s, d), "z", 2.0, TILE).select(*grid.CELL, "focal"))


@query("agg44_hypsometry", "AGG44", """
    SELECT run_id, CAST(level AS DOUBLE) AS level, round(sum(greatest(level - z, 0)) * 8100.0, 3) AS volume_m3, count(*) FILTER (WHERE z < level) AS wet_cells
    FROM dem CROSS JOIN (VALUES (1000.0::DOUBLE), (1010.0::DOUBLE), (1050.0::DOUBLE), (1100.0::DOUBLE)) AS t(level) GROUP BY ALL""", ("dem",))
def _(s, d):
    return rounded(terrain.hypsometry(_dem(s, d), [1000.0, 1010.0, 1050.0, 1100.0], DX), 3)


@query("agg44_elevation_percentiles", "AGG44", """
    SELECT run_id, 0.25::DOUBLE AS q, quantile_cont(z, 0.25) AS value FROM dem GROUP BY run_id
    UNION ALL SELECT run_id, 0.5::DOUBLE, quantile_cont(z, 0.5) FROM dem GROUP BY run_id
    UNION ALL SELECT run_id, 0.9::DOUBLE, quantile_cont(z, 0.9) FROM dem GROUP BY run_id""", ("dem",))
def _(s, d):
    from floodspark.operators.quantiles import exact_quantiles
    return rounded(exact_quantiles(_dem(s, d), ["run_id"], "z", [0.25, 0.5, 0.9]))


@query("win5_valley_width", "WIN5", """
    SELECT run_id, point_id, CASE WHEN n >= 5 AND k > 1 AND k < n THEN (coalesce(rt, n + 1) - coalesce(lf, 0) - 1) * 90.0 END AS width_m FROM (
      SELECT run_id, point_id, any_value(n) AS n, any_value(k) AS k, max(i) FILTER (WHERE hi AND i < k) AS lf, min(i) FILTER (WHERE hi AND i > k) AS rt
      FROM (SELECT run_id, point_id, n, k, i, zs[i] >= lo + 25 AS hi FROM (
              SELECT *, len(zs) AS n, list_min(zs) AS lo, list_position(zs, list_min(zs)) AS k, unnest(range(1, len(zs) + 1)) AS i FROM (
                SELECT f.run_id, p.poi_id AS point_id, list(f.z ORDER BY f.c) AS zs FROM poi p JOIN dem f ON f.run_id = CAST(floor(p.poi_id / 100.0) AS INT)
                  AND f.r = p.poi_id * 7 % 30 AND abs(f.c - p.poi_id * 11 % 50) <= 40 GROUP BY ALL)))
      GROUP BY ALL)""", ("poi", "dem"))
def _(s, d):
    return terrain.valley_width(_dem(s, d), _points(s, d), DX, 25.0, 40)


@query("win5_contiguous_floor", "WIN5", """
    SELECT vec_id, CASE WHEN n >= 5 AND k > 1 AND k < n THEN (coalesce(rt, n + 1) - coalesce(lf, 0) - 1) * 90.0 END AS width_m FROM (
      SELECT vec_id, any_value(n) AS n, any_value(k) AS k, max(i) FILTER (WHERE hi AND i < k) AS lf, min(i) FILTER (WHERE hi AND i > k) AS rt
      FROM (SELECT vec_id, n, k, i, CAST(embedding[i] AS DOUBLE) >= lo + 0.1 AS hi FROM (
              SELECT vec_id, embedding, len(embedding) AS n, CAST(list_min(embedding) AS DOUBLE) AS lo,
                     list_position(embedding, list_min(embedding)) AS k, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
      GROUP BY vec_id)""")
def _(s, d):
    from floodspark.sources.tables import table
    z = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("zs"))
    return terrain.contiguous_floor(z, 0.1, DX)


@query("jn6_window_of_cells", "JN6 PRJ18", """
    SELECT p.poi_id AS point_id, count(*) AS n, min(z) AS z_min, max(z) AS z_max FROM poi p JOIN dem f ON f.run_id = CAST(floor(p.poi_id / 100.0) AS INT)
    AND abs(f.r - p.poi_id * 7 % 30) <= 2 AND abs(f.c - p.poi_id * 11 % 50) <= 2 GROUP BY p.poi_id""", ("poi", "dem"))
def _(s, d):
    return window_join(_points(s, d), _dem(s, d), 2).groupBy("point_id").agg(
        F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@query("prj7_fill_to_surface", "PRJ7 PRJ6", """
    SELECT run_id, r, c, lake, CASE WHEN lake THEN greatest(0, 1040.0 - z) ELSE 0 END AS h FROM (
      SELECT *, (500.0 * (c * 90.0 + 45 - 1000.0) * -1 + 900.0 * ((299 - r) * 90.0 + 45 - 200.0)) / sqrt(500.0 ** 2 + 900.0 ** 2) > 0.001
        AND valid AND z < 1040 AND (c * 90.0 + 45 - 2000) ** 2 + ((299 - r) * 90.0 + 45 - 20000) ** 2 > 1000.0 * 1000 AS lake FROM dem)""", ("dem",))
def _(s, d):
    from floodspark.functions.hydraulics import surface_fill
    x = _dem(s, d).withColumn("x", F.col("c") * 90.0 + 45).withColumn("y", (299 - F.col("r")) * 90.0 + 45)
    lake = masks.reservoir(x, ((1000.0, 200.0), (1900.0, 700.0)), 1040.0, (2000.0, 20000.0), 1000.0)
    return lake.select(*grid.CELL, "lake", surface_fill(F.lit(1040.0), F.col("z"), F.col("lake")).alias("h"))


@query("agg26_initial_condition_audit", "AGG26", """
    SELECT run_id, count(*) AS cells, round(sum(1040.0 - z) * 8100, 3) AS volume, min(r) AS r_min, max(r) AS r_max, min(c) AS c_min, max(c) AS c_max
    FROM dem WHERE valid AND z < 1040 GROUP BY run_id""", ("dem",))
def _(s, d):
    lake = _dem(s, d).where("valid AND z < 1040")
    return rounded(lake.groupBy("run_id").agg(F.count("*").alias("cells"), (F.sum(1040.0 - F.col("z")) * DX * DX).alias("volume"),
                                             F.min("r").alias("r_min"), F.max("r").alias("r_max"),
                                             F.min("c").alias("c_min"), F.max("c").alias("c_max")), 3)


@query("agg26_points_wet_at_start", "AGG26 JN2", """
    SELECT p.run_id, count(*) AS points, count(*) FILTER (WHERE f.valid AND f.z < 1040) AS wet, count(*) FILTER (WHERE f.z IS NULL) AS outside
    FROM (SELECT CAST(floor(poi_id / 100.0) AS INT) AS run_id, poi_id * 7 % 310 AS r, poi_id * 11 % 50 AS c FROM poi) p LEFT JOIN dem f USING (run_id, r, c)
    GROUP BY p.run_id""", ("poi", "dem"))
def _(s, d):
    p = view(s, d, "poi").select(F.floor(F.col("poi_id") / 100.0).cast("int").alias("run_id"), (F.col("poi_id") * 7 % 310).alias("r"),
                                 (F.col("poi_id") * 11 % 50).alias("c"))
    lake = _dem(s, d).withColumn("lake", F.col("valid") & (F.col("z") < 1040))
    return masks.points_wet_at_start(p, lake)


# --- land cover -------------------------------------------------------------------------------

_LC = "(VALUES " + ", ".join(f"({c}, {n}::DOUBLE, {lo}::DOUBLE, {hi}::DOUBLE)" for c, _, n, lo, hi in fixed.LANDCOVER_CLASSES) + ") AS t(cls, n, n_low, n_high)"


@query("jn7_roughness_lookup", "JN7", f"""
    SELECT run_id, fr, fc, coalesce(n, 0.033) AS n, coalesce(n_low, 0.033) AS n_low, coalesce(n_high, 0.033) AS n_high
    FROM landcover LEFT JOIN {_LC} USING (cls)""", ("landcover",))
def _(s, d):
    return resample.with_roughness(view(s, d, "landcover")).select("run_id", "fr", "fc", "n", "n_low", "n_high")


_ROUGH = f"""SELECT run_id, CAST(floor(fr / 3) AS INT) AS r, CAST(floor(fc / 3) AS INT) AS c, avg(coalesce(n, 0.033)) AS n,
    avg(coalesce(n_low, 0.033)) AS n_low, avg(coalesce(n_high, 0.033)) AS n_high FROM landcover LEFT JOIN {_LC} USING (cls) GROUP BY 1, 2, 3"""


def _rough(s, d):
    return resample.composite_roughness(view(s, d, "landcover"), _dem(s, d), 3)


@query("agg11_composite_roughness", "AGG11 PRJ17", f"""
    SELECT run_id, r, c, round(coalesce(n, 0.033), 6) AS n, round(coalesce(n_low, 0.033), 6) AS n_low,
           round(coalesce(n_high, 0.033), 6) AS n_high, n IS NULL AS fallback FROM dem LEFT JOIN ({_ROUGH}) USING (run_id, r, c)""",
       ("dem", "landcover"))
def _(s, d):
    return rounded(_rough(s, d))


@query("agg12_dominant_class", "AGG12", """
    SELECT run_id, r, c, arg_min(cls, struct_pack(a := -n, b := cls)) AS cls FROM (
      SELECT run_id, CAST(floor(fr / 3) AS INT) AS r, CAST(floor(fc / 3) AS INT) AS c, cls, count(*) AS n FROM landcover WHERE cls <> 0 GROUP BY ALL)
    GROUP BY ALL""", ("landcover",))
def _(s, d):
    return resample.dominant_class(view(s, d, "landcover"), 3)


@query("agg13_cover_fractions", "AGG13", """
    SELECT run_id, cls, round(count(*) / sum(count(*)) OVER (PARTITION BY run_id), 6) AS fraction FROM landcover GROUP BY run_id, cls""", ("landcover",))
def _(s, d):
    return rounded(resample.cover_fractions(view(s, d, "landcover")))


@query("agg13_roughness_summary", "AGG13", f"""
    SELECT run_id, round(min(n), 6) AS n_min, round(max(n), 6) AS n_max, round(avg(n), 6) AS n_mean, round(avg(n_high) / avg(n_low), 6) AS sensitivity_ratio
    FROM (SELECT run_id, coalesce(n, 0.033) AS n, coalesce(n_low, 0.033) AS n_low, coalesce(n_high, 0.033) AS n_high
          FROM dem LEFT JOIN ({_ROUGH}) USING (run_id, r, c)) GROUP BY run_id""", ("dem", "landcover"))
def _(s, d):
    return rounded(resample.roughness_summary(_rough(s, d)))


@query("prj17_roughness_fallback", "PRJ17", """
    SELECT run_id, r, c, CASE WHEN valid THEN 0.05 ELSE 0.099 END AS n, NOT valid AS noted FROM dem""", ("dem",))
def _(s, d):
    x = _dem(s, d).withColumn("n", F.when(F.col("valid"), 0.05))
    return rounded(resample.roughness_or_uniform(x, debris_flow=True).select(*grid.CELL, "n", F.col("note").isNotNull().alias("noted")))


@query("top8_top_covers", "TOP8", """
    SELECT run_id, cls, round(f, 6) AS fraction, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY f DESC, cls) AS place FROM (
      SELECT run_id, cls, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS f FROM landcover GROUP BY run_id, cls) WHERE f >= 0.001)
    WHERE place <= 4""", ("landcover",))
def _(s, d):
    from pyspark.sql import Window
    f = resample.cover_fractions(view(s, d, "landcover")).where("fraction >= 0.001")
    w = Window.partitionBy("run_id").orderBy(F.col("fraction").desc(), "cls")
    return rounded(f.withColumn("place", F.row_number().over(w)).where("place <= 4"))


# --- population and elevation onto other grids -----------------------------------------------------

def _to_source(r, c):
    return F.struct(((r + 0.3) / 4.0).alias("r"), ((c + 0.7) / 4.0).alias("c"))


def _to_target(r, c):
    return F.struct((r * 4.0 - 0.3).alias("r"), (c * 4.0 - 0.7).alias("c"))


_POP = """SELECT d.run_id, d.r, d.c, CASE WHEN count(s.cnt) > 0 THEN avg(greatest(coalesce(s.cnt, 0), 0) / 129600.0) FILTER (WHERE s.sr IS NOT NULL) * 8100.0 ELSE 0 END AS pop
    FROM dem d CROSS JOIN (SELECT (a.i + 0.5) / 4.0 AS u, (b.i + 0.5) / 4.0 AS v FROM (SELECT unnest(range(4)) AS i) a, (SELECT unnest(range(4)) AS i) b) o
    LEFT JOIN counts s ON s.run_id = d.run_id AND s.sr = CAST(floor((d.r + o.u + 0.3) / 4.0) AS INT) AND s.sc = CAST(floor((d.c + o.v + 0.7) / 4.0) AS INT)
    GROUP BY d.run_id, d.r, d.c"""


def _people(s, d):
    return resample.resample_population(view(s, d, "counts"), _dem(s, d), _to_source, DX, F.lit(129600.0))


@query("agg10_population_resample", "AGG10 JN16 SRC7", f"SELECT run_id, r, c, round(pop, 10) AS pop FROM ({_POP})", ("dem", "counts"))
def _(s, d):
    return rounded(_people(s, d), 10)


# sub-points of pixels that lie in the grid
FOOTPRINT = """
    SELECT run_id, sum(CASE WHEN tr >= 0 AND tr < ny AND tc >= 0 AND tc < nx THEN q ELSE 0 END) / 16.0 AS source_total, sum(q) / 16.0 AS raw_total
    FROM (SELECT s.run_id, greatest(coalesce(cnt, 0), 0) AS q, (sr + (a.i + 0.5) / 4.0) * 4.0 - 0.3 AS tr, (sc + (b.i + 0.5) / 4.0) * 4.0 - 0.7 AS tc
          FROM counts s, (SELECT unnest(range(4)) AS i) a, (SELECT unnest(range(4)) AS i) b)
    JOIN (SELECT run_id, max(r) + 1 AS ny, max(c) + 1 AS nx FROM dem GROUP BY run_id) USING (run_id) GROUP BY run_id"""


@query("agg10_conservation_report", "AGG10", f"""
    SELECT run_id, round(source_total, 4) AS source_total, round(raw_total, 4) AS raw_total, round(t, 4) AS resampled_total,
           round((t - source_total) / source_total, 6) AS residual, abs((t - source_total) / source_total) <= 0.02 AS conserved, 4 AS subpoints
    FROM ({FOOTPRINT}) JOIN (SELECT run_id, sum(pop) AS t FROM ({_POP}) GROUP BY run_id) USING (run_id)""", ("dem", "counts"))
def _(s, d):
    c = resample.conservation(view(s, d, "counts"), _people(s, d), _to_target, _sizes(s, d))
    return c.select("run_id", F.round("source_total", 4).alias("source_total"), F.round("raw_total", 4).alias("raw_total"),
                    F.round("resampled_total", 4).alias("resampled_total"), F.round("residual", 6).alias("residual"), "conserved", "subpoints")


# --- the same across a change of projection: pixels of 0.004 degrees under cells of UTM zone 44 north ------------

_RASTER = resample.GeographicRaster(78.9305, 29.8, 0.004)
_GRID = resample.UtmGrid(300_000.0, 3_298_000.0, DX, 44)
_FLAT = "(1.0 / 298.257223563)"
_N = 1.0 / 298.257223563 / (2.0 - 1.0 / 298.257223563)
_SCALE = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64 + _N ** 6 / 256)
_BETA = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96 - _N ** 4 / 360, _N ** 2 / 48 + _N ** 3 / 15 - 437 * _N ** 4 / 1440,
         17 * _N ** 3 / 480 - 37 * _N ** 4 / 840, 4397 * _N ** 4 / 161280)
_DELTA = (2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45, 7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45,
          56 * _N ** 3 / 15 - 136 * _N ** 4 / 35, 4279 * _N ** 4 / 630)
_ALPHA = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16 + 41 * _N ** 4 / 180, 13 * _N ** 2 / 48 - 3 * _N ** 3 / 5 + 557 * _N ** 4 / 1440,
          61 * _N ** 3 / 240 - 103 * _N ** 4 / 140, 49561 * _N ** 4 / 161280)


def _series(terms, sign: str, first: str, second: str) -> str:
    return "".join(f" {sign} {v!r}::DOUBLE * {first.format(2 * j)} * {second.format(2 * j)}" for j, v in enumerate(terms, 1))


_OFFSETS = "(SELECT (a.i + 0.5) / 4.0 AS u, (b.i + 0.5) / 4.0 AS v FROM (SELECT unnest(range(4)) AS i) a, (SELECT unnest(range(4)) AS i) b) o"
# sub-points of cells as longitude and latitude
_SUBS = f"""
    SELECT run_id, r, c, chi{"".join(f" + {v!r}::DOUBLE * sin({2 * j} * chi)" for j, v in enumerate(_DELTA, 1))} AS phi, lam FROM (
      SELECT run_id, r, c, asin(sin(xi) / cosh(eta)) AS chi, degrees(atan2(sinh(eta), cos(xi))) + 81.0 AS lam FROM (
        SELECT run_id, r, c, x{_series(_BETA, "-", "sin({} * x)", "cosh({} * e)")} AS xi, e{_series(_BETA, "-", "cos({} * x)", "sinh({} * e)")} AS eta FROM (
          SELECT run_id, r, c, (3298000.0 - (r + u) * 90.0) / {_SCALE!r}::DOUBLE AS x, (300000.0 + (c + v) * 90.0 - 500000.0) / {_SCALE!r}::DOUBLE AS e
          FROM dem, {_OFFSETS})))"""
_ACROSS = f"""
    SELECT p.run_id, p.r, p.c, CASE WHEN count(s.cnt) > 0 THEN avg(greatest(coalesce(s.cnt, 0), 0) / m2) FILTER (WHERE s.sr IS NOT NULL) * 8100.0 ELSE 0 END AS pop
    FROM (SELECT run_id, r, c, CAST(floor((29.8 - degrees(phi)) / 0.004) AS INT) AS sr, CAST(floor((lam - 78.9305) / 0.004) AS INT) AS sc FROM ({_SUBS})) p
    LEFT JOIN (SELECT *, 6371008.8 * 6371008.8 * radians(0.004) * abs(sin(radians(29.8 - (sr + 0.5) * 0.004 + 0.002)) - sin(radians(29.8 - (sr + 0.5) * 0.004 - 0.002))) AS m2
               FROM counts) s USING (run_id, sr, sc) GROUP BY p.run_id, p.r, p.c"""


def _across(s, d):
    return resample.people_across(view(s, d, "counts"), _RASTER, _dem(s, d), _GRID)


@query("agg10_people_across_projections", "AGG10 JN16 GEO1 GEO2", f"SELECT run_id, r, c, round(pop, 8) AS pop FROM ({_ACROSS})", ("dem", "counts"))
def _(s, d):
    return rounded(_across(s, d), 8)


# sub-points of pixels that lie in the grid
_COVERED = f"""
    SELECT run_id, sum(CASE WHEN tr >= 0 AND tr < ny AND tc >= 0 AND tc < nx THEN q ELSE 0 END) / 16.0 AS source_total, sum(q) / 16.0 AS raw_total FROM (
      SELECT run_id, q, (3298000.0 - {_SCALE!r}::DOUBLE * (xi{_series(_ALPHA, "+", "sin({} * xi)", "cosh({} * eta)")})) / 90.0 AS tr,
             (500000.0 + {_SCALE!r}::DOUBLE * (eta{_series(_ALPHA, "+", "cos({} * xi)", "sinh({} * eta)")}) - 300000.0) / 90.0 AS tc FROM (
        SELECT run_id, q, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1.0 + t * t)) AS eta FROM (
          SELECT run_id, q, radians(lon - 81.0) AS lam, sinh(atanh(sin(radians(lat))) - ec * atanh(ec * sin(radians(lat)))) AS t FROM (
            SELECT run_id, greatest(coalesce(cnt, 0), 0) AS q, 29.8 - (sr + u) * 0.004 AS lat, 78.9305 + (sc + v) * 0.004 AS lon, sqrt({_FLAT} * (2.0 - {_FLAT})) AS ec
            FROM counts, {_OFFSETS}))))
    JOIN (SELECT run_id, max(r) + 1 AS ny, max(c) + 1 AS nx FROM dem GROUP BY run_id) USING (run_id) GROUP BY run_id"""


@query("agg10_conservation_across_projections", "AGG10 JN16", f"""
    SELECT run_id, round(source_total, 4) AS source_total, round(raw_total, 4) AS raw_total, round(t, 4) AS resampled_total,
           round((t - source_total) / source_total, 6) AS residual, abs((t - source_total) / source_total) <= 0.05 AS conserved
    FROM ({_COVERED}) JOIN (SELECT run_id, sum(pop) AS t FROM ({_ACROSS}) GROUP BY run_id) USING (run_id)""", ("dem", "counts"))
def _(s, d):
    rep = resample.conservation(view(s, d, "counts"), _across(s, d), _GRID.from_pixels(_RASTER), _sizes(s, d), tolerance=0.05)
    return rep.select("run_id", *[F.round(c, 4).alias(c) for c in ("source_total", "raw_total", "resampled_total")],
                      F.round("residual", 6).alias("residual"), "conserved")


@query("src7_windowed_counts", "SRC7", """
    SELECT run_id, sr, sc, greatest(coalesce(cnt, 0), 0) AS cnt FROM counts WHERE sr BETWEEN 10 AND 50 AND sc BETWEEN -17 AND 26""", ("counts",))
def _(s, d):
    return rasters.window(view(s, d, "counts"), (30, 30), (3, 6)).select("run_id", "sr", "sc", "cnt")


@query("geo8_bilinear_reprojection", "GEO8", """
    SELECT t.run_id, t.r, t.c, round(sum(w * z) / nullif(sum(w) FILTER (WHERE z IS NOT NULL), 0), 6) AS z FROM (
      SELECT p.run_id, p.r, p.c, CASE i WHEN 1 THEN fr - floor(fr) ELSE 1 - (fr - floor(fr)) END
             * CASE j WHEN 1 THEN fc - floor(fc) ELSE 1 - (fc - floor(fc)) END AS w, s.z
      FROM (SELECT *, (r + 0.5) * 1.3 + 2 - 0.5 AS fr, (c + 0.5) * 1.1 + 1 - 0.5 AS fc FROM dem) p, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)
      LEFT JOIN (SELECT * FROM dem WHERE valid) s ON s.run_id = p.run_id AND s.r = CAST(floor(p.fr) AS INT) + i AND s.c = CAST(floor(p.fc) AS INT) + j) t
    GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY t.run_id, t.r, t.c"), ("dem",))
def _(s, d):
    src = _dem(s, d).withColumn("z", F.when(F.col("valid"), F.col("z")))
    out = resample.bilinear(src, _dem(s, d), lambda r, c: F.struct((r * 1.3 + 2).alias("r"), (c * 1.1 + 1).alias("c")))
    return rounded(out)


@query("src5_elevation_mosaic", "SRC5", """
    SELECT d.run_id, d.r, d.c, CASE WHEN z2 >= -500 THEN z2 END AS z FROM dem d LEFT JOIN (
      SELECT run_id, r, c, arg_max(z, t) AS z2 FROM (
        SELECT run_id, r, c, 0 AS t, CASE WHEN c % 17 = 0 THEN -900.0 ELSE z END AS z FROM dem WHERE c < 30 AND valid
        UNION ALL SELECT run_id, r, c, 1, z + 0.25 FROM dem WHERE c >= 25 AND valid) GROUP BY ALL) USING (run_id, r, c)""", ("dem",))
def _(s, d):
    x = _dem(s, d)
    z = F.when(F.col("valid"), F.col("z"))
    west = x.where("c < 30").select(*grid.CELL, F.lit(0).alias("tile_no"), F.when(
        F.col("valid") & (F.col("c") % 17 == 0), -900.0).otherwise(z).alias("z"))
    east = x.where("c >= 25").select(*grid.CELL, F.lit(1).alias("tile_no"), (z + 0.25).alias("z"))
    return rasters.elevation_mosaic(west.union(east), x.select(*grid.CELL))


@query("src6_landcover_mosaic", "SRC6", """
    SELECT run_id, fr AS r, fc AS c, CASE WHEN fc >= 70 AND cls > 0 AND fr % 3 > 0 THEN cls WHEN fc < 80 THEN cls
           WHEN fr % 3 > 0 THEN cls ELSE 0 END AS cls FROM landcover""", ("landcover",))
def _(s, d):
    x = view(s, d, "landcover").select("run_id", F.col("fr").alias("r"), F.col("fc").alias("c"), "cls")
    west = x.where("c < 80").withColumn("tile_no", F.lit(0))
    east = x.where("c >= 70").withColumn("tile_no", F.lit(1)).withColumn("cls", F.when(F.col("r") % 3 > 0, F.col("cls")).otherwise(0))
    return rasters.landcover_mosaic(west.unionByName(east), x.select(*grid.CELL))


@query("geo1_spherical_cell_area", "GEO1", """
    SELECT run_id, r, c, round(6371008.8 * 6371008.8 * radians(0.001) * abs(sin(radians(30 + r * 0.001 + 0.0005)) - sin(radians(30 + r * 0.001 - 0.0005))), 4) AS m2
    FROM dem""", ("dem",))
def _(s, d):
    return rounded(_dem(s, d).select(*grid.CELL, geo.spherical_cell_area(30.0 + F.col("r") * 0.001, 0.001, 0.001).alias("m2")), 4)


@query("geo2_utm_round_trip", "GEO2", """
    SELECT run_id, r, c, 'EPSG:32644' AS epsg, round(30.0 + r * 0.01, 7) AS lat, round(78.0 + c * 0.02, 7) AS lon FROM dem""", ("dem",))
def _(s, d):
    p = _dem(s, d).select(*grid.CELL, (30.0 + F.col("r") * 0.01).alias("lat"), (78.0 + F.col("c") * 0.02).alias("lon"))
    zone = geo.utm_zone(F.col("lon"))
    p = p.withColumn("p", geo.utm_forward(F.col("lat"), F.col("lon"), zone)).withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon")))
    back = p.withColumn("g", geo.utm_inverse(F.col("p.x"), F.col("p.y"), zone, F.lit(True)))
    return rounded(back.select(*grid.CELL, "epsg", F.col("g.lat").alias("lat"), F.col("g.lon").alias("lon")), 7)


@query("arr1_affine_cells", "ARR1 GEO2", """
    SELECT run_id, r, c, c * 90.0 + 45 + 1000 AS x, 50000 - (r * 90.0 + 45) AS y, r AS r2, c AS c2 FROM dem""", ("dem",))
def _(s, d):
    t = F.array(*[F.lit(v) for v in (90.0, 0.0, 1000.0, 0.0, -90.0, 50000.0)])
    p = _dem(s, d).select(*grid.CELL, geo.affine_xy(t, F.col("r"), F.col("c")).alias("p"))
    q = p.withColumn("q", geo.affine_cell(t, F.col("p.x"), F.col("p.y")))
    return q.select(*grid.CELL, F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.r").alias("r2"), F.col("q.c").alias("c2"))


def _inverse(x: str, y: str) -> str:
    """Columns ``lat, lon`` from the columns ``x, y`` of a zone 44 grid, as a FROM item over ``{from}``."""
    return f"""(
      SELECT *, degrees(chi{"".join(f" + {v!r}::DOUBLE * sin({2 * j} * chi)" for j, v in enumerate(_DELTA, 1))}) AS lat FROM (
        SELECT *, asin(sin(xi) / cosh(eta)) AS chi, degrees(atan2(sinh(eta), cos(xi))) + 81.0 AS lon FROM (
          SELECT *, n{_series(_BETA, "-", "sin({} * n)", "cosh({} * e)")} AS xi, e{_series(_BETA, "-", "cos({} * n)", "sinh({} * e)")} AS eta
          FROM (SELECT *, {y} / {_SCALE!r}::DOUBLE AS n, ({x} - 500000.0) / {_SCALE!r}::DOUBLE AS e FROM """


@query("geo7_geographic_cover", "GEO7", f"""
    SELECT extent_id, round(min(lon) - 0.01, 6) AS west, round(min(lat) - 0.01, 6) AS south, round(max(lon) + 0.01, 6) AS east, round(max(lat) + 0.01, 6) AS north
    FROM {_inverse("x", "y")} (
      SELECT extent_id, CASE WHEN side < 2 THEN 300000.0 + w * f WHEN side = 2 THEN 300000.0 ELSE 300000.0 + w END AS x,
             CASE WHEN side >= 2 THEN 3300000.0 + h * f WHEN side = 0 THEN 3300000.0 ELSE 3300000.0 + h END AS y
      FROM (SELECT run_id AS extent_id, (max(c) + 1) * 90.0 AS w, (max(r) + 1) * 90.0 AS h FROM dem GROUP BY run_id),
           (SELECT unnest(range(4)) AS side), (SELECT unnest(range(65)) / 64.0 AS f)))))) GROUP BY extent_id""", ("dem",))
def _(s, d):
    e = _sizes(s, d).select(F.col("run_id").alias("extent_id"), F.lit(300000.0).alias("xmin"), F.lit(3300000.0).alias("ymin"),
                            (300000.0 + F.col("nx") * DX).alias("xmax"), (3300000.0 + F.col("ny") * DX).alias("ymax"))
    return rounded(resample.geographic_cover(e, F.lit(44), F.lit(True)))
