"""Hydrographs, hydraulics, validation, particles, meshes and radar observation."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodspark import grid
from floodspark.functions import hydraulics as hy
from floodspark.functions import text as ft
from floodspark.operators import accumulate, mesh, observe, particles, sampling, series
from floodspark.queries.base import DERIVED, cells, query, rounded
from floodspark.queries.terrain import _COMP
from floodspark.sources.tables import DX, stream_view, view
from floodspark.streaming import frames as streams


def _hyd(s, d):
    return view(s, d, "hydrographs")


_TRAP = """SELECT run_id, label, coalesce(sum((q + p) / 2.0 * (t_s - tp)), 0) AS volume FROM (
    SELECT *, lag(q) OVER w AS p, lag(t_s) OVER w AS tp FROM hydrographs WINDOW w AS (PARTITION BY run_id, label ORDER BY t_s))
    GROUP BY run_id, label"""


@query("win2_trapezoid", "WIN2", f"SELECT run_id, label, round(volume, 3) AS volume FROM ({_TRAP})", ("hydrographs",))
def _(s, d):
    return rounded(series.trapezoid(_hyd(s, d)), 3)


_SUMM = f"""SELECT run_id, label, max(q) AS peak_q, arg_min(t_s, struct_pack(a := -q, b := t_s)) AS t_peak, min(t_s) AS t_first,
    max(t_s) AS t_last, any_value(volume) AS released FROM hydrographs JOIN ({_TRAP}) USING (run_id, label) GROUP BY ALL"""


@query("agg17_hydrograph_summary", "AGG17 WIN6", f"""
    SELECT run_id, label, round(peak_q, 6) AS peak_q, t_peak, t_first, t_last, round(released, 3) AS released FROM ({_SUMM})""", ("hydrographs",))
def _(s, d):
    x = series.summarise(_hyd(s, d))
    return x.select("run_id", "label", F.round("peak_q", 6).alias("peak_q"), "t_peak", "t_first", "t_last", F.round("released", 3).alias("released"))


def _breached(s, d):
    """Hydrographs with the head over the sill and the tailwater, so that velocity and submergence follow."""
    h = _hyd(s, d).withColumn("head", 2.0 + F.col("q") / 500.0)
    tail = F.col("head") * (F.floor(F.col("t_s") / 3600.0) % 10) / 8.0
    return h.withColumn("velocity", hy.breach_velocity(F.col("q"), F.col("head"), F.lit(20.0), F.lit(0.5))).withColumn(
        "ks", hy.submergence_factor(F.col("head"), tail))


@query("agg17_velocity_and_submergence", "AGG17 FN10 FN13", """
    SELECT run_id, label, round(max(CASE WHEN q <= 0 THEN 0 ELSE q / (20 * w + 0.5 * w * w) END), 6) AS peak_velocity, round(min(k), 6) AS min_submergence, min(k) < 1 AS drowned
    FROM (SELECT *, 2.0 * h / 3.0 AS w, CASE WHEN x <= 0.67 THEN 1 WHEN x >= 1 THEN 0 ELSE pow(1 - pow(x, 1.5), 0.385) END AS k
          FROM (SELECT *, 2.0 + q / 500.0 AS h, floor(t_s / 3600.0) % 10 / 8.0 AS x FROM hydrographs)) GROUP BY run_id, label""", ("hydrographs",))
def _(s, d):
    x = series.summarise(_breached(s, d))
    return rounded(x.select("run_id", "label", "peak_velocity", "min_submergence", "drowned"))


@query("agg17_mass_balance", "AGG17", f"""
    SELECT run_id, label, round(abs(released - e) / e, 6) AS mass_balance_rel FROM (
      SELECT *, 1000000.0 * (run_id + 1) + 12.5 * t_last AS e FROM ({_SUMM}))""", ("hydrographs",))
def _(s, d):
    st = _hyd(s, d).select("run_id").distinct().select("run_id", (1.0e6 * (F.col("run_id") + 1)).alias("storage_drop"),
                                                       F.lit(12.5).alias("inflow"), F.lit(1.0e9).alias("gross_storage"))
    return rounded(series.mass_balance(series.summarise(_hyd(s, d)), st).select("run_id", "label", "mass_balance_rel"))


@query("agg39_peak_band", "AGG39", """
    SELECT run_id, round(min(p), 6) AS low, round(max(p), 6) AS high, count(*) AS members FROM (
      SELECT run_id, label, max(q) AS p FROM hydrographs GROUP BY ALL) GROUP BY run_id""", ("hydrographs",))
def _(s, d):
    return rounded(series.peak_band(series.summarise(_hyd(s, d))))


_AT = """SELECT p.run_id, p.label, p.t_s, CASE WHEN a.t_s IS NULL THEN b.q WHEN b.t_s IS NULL THEN a.q WHEN a.t_s = b.t_s THEN a.q
      ELSE a.q + (b.q - a.q) * ((p.t_s - a.t_s) / (b.t_s - a.t_s)) END AS q
    FROM {probes} p ASOF LEFT JOIN hydrographs a ON a.run_id = p.run_id AND a.label = p.label AND p.t_s >= a.t_s
    ASOF LEFT JOIN hydrographs b ON b.run_id = p.run_id AND b.label = p.label AND p.t_s <= b.t_s"""
_PROBES = """(SELECT run_id, label, CAST(k * 5000.5 - 20000 AS DOUBLE) AS t_s FROM (SELECT DISTINCT run_id, label FROM hydrographs), (SELECT unnest(range(600)) AS k))"""


@query("jn11_interpolation_join", "JN11", f"SELECT run_id, label, t_s, round(q, 9) AS q FROM ({_AT.format(probes=_PROBES)})", ("hydrographs",))
def _(s, d):
    h = _hyd(s, d)
    p = h.select("run_id", "label").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(599)))).select(
        "run_id", "label", (F.col("k") * 5000.5 - 20000.0).alias("t_s"))
    return rounded(series.interpolate(h, p), 9)


_EVEN = """(SELECT run_id, label, a + (b - a) * (k / 399.0) AS t_s FROM (SELECT run_id, label, min(t_s) AS a, max(t_s) AS b FROM hydrographs GROUP BY ALL),
    (SELECT unnest(range(400)) AS k))"""


@query("agg32_hydrograph_comparison", "AGG32", f"""
    SELECT run_id, label, round(sum((q + p) / 2.0 * (t_s - tp)), 2) AS volume FROM (
      SELECT *, lag(q) OVER w AS p, lag(t_s) OVER w AS tp FROM ({_AT.format(probes=_EVEN)}) WINDOW w AS (PARTITION BY run_id, label ORDER BY t_s))
    GROUP BY run_id, label""", ("hydrographs",))
def _(s, d):
    h = _hyd(s, d)
    return rounded(series.trapezoid(series.interpolate(h, series.even_probes(h, 400))), 2)


@query("agg16_volume_error", "AGG16", """
    SELECT run_id, round(first, 3) AS first, round(last, 3) AS last, round((last - first - 500.0) / (first + 500.0), 6) AS error FROM (
      SELECT run_id, arg_min(v, t_s) AS first, arg_max(v, t_s) AS last FROM (
        SELECT run_id, t_s, sum(h) * 8100.0 AS v FROM frames GROUP BY ALL) GROUP BY run_id)""", ("frames",))
def _(s, d):
    v = accumulate.frame_volumes(view(s, d, "frames"), DX)
    inj = v.select("run_id").distinct().withColumn("injected", F.lit(500.0))
    return v.transform(lambda x: accumulate.volume_error(x, inj, False)).select(
        "run_id", F.round("first", 3).alias("first"), F.round("last", 3).alias("last"), F.round("error", 6).alias("error"))


@query("fn8_velocity_and_surface", "FN8", """
    SELECT run_id, r, c, t_s, h, round(u, 6) AS u, round(v, 6) AS v, round(speed, 6) AS speed FROM frames_v""", ("frames_v",))
def _(s, d):
    f = view(s, d, "frames")
    return rounded(f.select(*grid.CELL, "t_s", "h", hy.velocity(F.col("h"), F.col("hu")).alias("u"),
                            hy.velocity(F.col("h"), F.col("hv")).alias("v"), hy.speed(F.col("h"), F.col("hu"), F.col("hv")).alias("speed")))


@query("fn21_inflow_weights", "FN21", """
    SELECT run_id, label, t_s, round(q / sum(q) OVER (PARTITION BY run_id, label), 9) AS weight FROM hydrographs""", ("hydrographs",))
def _(s, d):
    return rounded(series.inflow_weights(_hyd(s, d).withColumnRenamed("q", "weight")).select("run_id", "label", "t_s", "weight"), 9)


# --- closed-form hydraulics over the table of breach specifications ---------------------------

def _b(s, d):
    return view(s, d, "breaches")


@query("fn9_breach_growth", "FN9", """
    SELECT id, round(f, 6) AS fraction, round(s * 10 * f, 6) AS width, round(800 - (800 - (700 + b)) * f, 6) AS invert FROM (
      SELECT *, CASE WHEN mode = 'instant' OR b <= 0 THEN 1.0 WHEN mode = 'linear' THEN x ELSE x * x * (3 - 2 * x) END AS f
      FROM (SELECT *, least(1.0, greatest(0.0, CASE WHEN b > 0 THEN a * 10 / (b * 60) ELSE 0 END)) AS x FROM breaches))""", ("breaches",))
def _(s, d):
    f = hy.growth_fraction(F.col("a") * 10, F.nullif(F.col("b") * 60, F.lit(0.0)), F.col("mode"))
    f = F.when(F.col("b") <= 0, 1.0).otherwise(f)
    x = _b(s, d).withColumn("fraction", f)
    return rounded(x.select("id", "fraction", hy.breach_width(F.col("fraction"), F.col("s") * 10).alias("width"),
                            hy.breach_invert(F.col("fraction"), F.lit(800.0), 700.0 + F.col("b")).alias("invert")))


@query("fn11_weir_outflow", "FN10 FN11 FN13", """
    SELECT id, round(k, 6) AS ks, round(CASE WHEN h <= 0 OR s <= 0 THEN 0 ELSE (1.7 * s * pow(greatest(h, 0), 1.5) + 1.35 * 0.5 * pow(greatest(h, 0), 2.5)) * k END, 4) AS q,
           round(CASE WHEN h <= 0 THEN 0 ELSE sqrt(2 * 9.81 * h / 3) END, 6) AS uc
    FROM (SELECT *, CASE WHEN h <= 0 THEN 0 WHEN t / h <= 0.67 THEN 1 WHEN t / h >= 1 THEN 0 ELSE pow(1 - pow(t / h, 1.5), 0.385) END AS k
          FROM (SELECT *, a - 10 AS h, b * 5 AS t FROM breaches))""", ("breaches",))
def _(s, d):
    x = _b(s, d).withColumn("h", F.col("a") - 10).withColumn("t", F.col("b") * 5)
    safe = F.greatest(F.col("h"), F.lit(0.0))
    ks = F.when(F.col("h") <= 0, 0.0).otherwise(hy.submergence_factor(F.nullif(safe, F.lit(0.0)), F.col("t")))
    q = F.when(F.col("h") <= 0, 0.0).otherwise(hy.weir_outflow(
        F.lit(100.0) + safe, F.lit(100.0), F.col("s"), F.lit(0.5)) * ks)
    return x.select("id", F.round(ks, 6).alias("ks"), F.round(q, 4).alias("q"), F.round(hy.critical_velocity(F.col("h")), 6).alias("uc"))


@query("fn13_breach_velocity", "FN13", """
    SELECT id, round(CASE WHEN price <= 0 OR a <= 0 OR s <= 0 THEN 0 ELSE price / (s * 2 * a / 3 + 0.5 * (2 * a / 3) * (2 * a / 3)) END, 9) AS u FROM breaches""", ("breaches",))
def _(s, d):
    a = F.col("a")
    u = F.when(a <= 0, 0.0).otherwise(hy.breach_velocity(F.col("price"), F.nullif(a, F.lit(0.0)), F.col("s"), F.lit(0.5)))
    return rounded(_b(s, d).select("id", u.alias("u")), 9)


@query("fn12_empirical_peaks", "FN12", """
    SELECT id, round(0.607 * pow(v, 0.295) * pow(h, 1.24), 2) AS froehlich, round(19.1 * pow(h, 1.85), 2) AS usbr, round(1.154 * pow(v * h, 0.412), 2) AS mlm,
           round(0.1803 * 1.4 * pow(v, 0.32) * pow(h, 0.19), 4) AS width_m, round(0.00254 * pow(v, 0.53) * pow(h, -0.9) * 3600, 4) AS time_s
    FROM (SELECT *, price * 1000 AS v, a + 5 AS h FROM breaches)""", ("breaches",))
def _(s, d):
    v, h = F.col("price") * 1000, F.col("a") + 5
    g = hy.froehlich_geometry(v, h, F.lit("overtopping"))
    return _b(s, d).select("id", F.round(hy.froehlich_peak(v, h), 2).alias("froehlich"), F.round(hy.usbr_peak(h), 2).alias("usbr"),
                           F.round(hy.mlm_peak(v, h), 2).alias("mlm"), F.round(g["width_m"], 4).alias("width_m"), F.round(g["time_s"], 4).alias("time_s"))


@query("fn12_peak_disagreement", "FN12", """
    SELECT id, routed > greatest(a1, a2, a3) * 1.5 OR routed < least(a1, a2, a3) / 1.5 AS disagrees FROM (
      SELECT id, price * 20 AS routed, 0.607 * pow(price * 1000, 0.295) * pow(a + 5, 1.24) AS a1, 19.1 * pow(a + 5, 1.85) AS a2, 1.154 * pow(price * 1000 * (a + 5), 0.412) AS a3 FROM breaches)""", ("breaches",))
def _(s, d):
    v, h = F.col("price") * 1000, F.col("a") + 5
    e = [hy.froehlich_peak(v, h), hy.usbr_peak(h), hy.mlm_peak(v, h)]
    return _b(s, d).select("id", hy.peak_disagrees(F.col("price") * 20, F.least(*e), F.greatest(*e)).alias("disagrees"))


@query("fn14_breach_geometry", "FN14", """
    SELECT id, s + 2 * 1.5 * a AS top_m, greatest(0, 120 - 2 * 1.5 * a) AS max_bottom, s + 3 * a <= 120 + 0.000000001 AS fits,
           CASE WHEN a > 0 AND 120 * 0.5 - 3 * a > 0 THEN 60 - 3 * a END AS widest FROM breaches""", ("breaches",))
def _(s, d):
    a, side, L = F.col("a"), F.lit(1.5), F.lit(120.0)
    return _b(s, d).select("id", hy.top_width(F.col("s"), a, side).alias("top_m"), hy.max_bottom_width(L, a, side).alias("max_bottom"),
                           hy.fits_crest(F.col("s"), a, side, L).alias("fits"), hy.widest_fit(L, a, side, F.lit(0.5)).alias("widest"))


@query("fn15_reservoir_storage", "FN15", """
    SELECT id, round(b2, 6) AS exponent, round(b2 * v * pow(greatest(b * 4, 1), b2 - 1) / pow(50, b2), 3) AS area, round(v * pow(b * 4 / 50, b2), 3) AS storage,
           CASE WHEN b2 < 1.3 THEN 'near vertical-sided' WHEN b2 < 2.3 THEN 'wedge-shaped valley' WHEN b2 < 3.3 THEN 'conical / steep valley' ELSE 'deep narrow gorge' END AS shape
    FROM (SELECT *, 1000000.0 AS v, (20000.0 + a * 600) * 50 / 1000000.0 AS b2 FROM breaches)""", ("breaches",))
def _(s, d):
    v, bed, full, lvl = F.lit(1.0e6), F.lit(100.0), F.lit(150.0), 100.0 + F.col("b") * 4
    x = _b(s, d).withColumn("e", hy.storage_exponent(20000.0 + F.col("a") * 600, F.lit(50.0), v))
    return x.select("id", F.round("e", 6).alias("exponent"), F.round(hy.power_area(lvl, bed, full, v, F.col("e")), 3).alias("area"),
                    F.round(hy.power_storage(lvl, bed, full, v, F.col("e")), 3).alias("storage"), hy.shape_word(F.col("e")).alias("shape"))


@query("fn15_storage_table_mode", "FN15 JN12", """
    SELECT id, CASE WHEN lvl < 10 THEN 100 + lvl * 20.0 ELSE 300 + (lvl - 10) * 70.0 END AS area FROM (
      SELECT id, least(b * 2, 30.0) AS lvl FROM breaches)""", ("breaches",))
def _(s, d):
    from floodspark.functions.damage import piecewise
    return _b(s, d).select("id", piecewise(F.col("b") * 2, [0.0, 10.0, 30.0], [100.0, 300.0, 1700.0]).alias("area"))


@query("fn16_blockage_geometry", "FN16", """
    SELECT id, w AS width_m, round(v / 700 / (0.65 * w), 6) AS height_m, round(0.4 * (v / 700 / (0.65 * w)) * w * 700, 3) AS impounded_m3, assumed AS width_assumed
    FROM (SELECT id, price * 1000 AS v, a * 10 < 270 AS assumed, CASE WHEN a * 10 < 270 THEN 360.0 ELSE a * 10 END AS w FROM breaches)""", ("breaches",))
def _(s, d):
    g = hy.blockage_geometry(F.col("price") * 1000, F.col("a") * 10, F.lit(DX))
    return _b(s, d).select("id", g["width_m"].alias("width_m"), F.round(g["height_m"], 6).alias("height_m"),
                           F.round(g["impounded_m3"], 3).alias("impounded_m3"), g["width_assumed"].alias("width_assumed"))


@query("fn17_breach_section", "FN17", """
    SELECT id, crest AS crest_m, invert AS invert_m, least(s * 20, greatest(0, 300 - 2 * (crest - invert))) AS bottom_m, s * 20 > greatest(0, 300 - 2 * (crest - invert)) AS clamped
    FROM (SELECT *, greatest(crest - (a + 1), crest - 60) AS invert FROM (SELECT *, CASE WHEN b > 5 THEN 500 + b ELSE 495.0 + 5 END AS crest FROM breaches))""", ("breaches",))
def _(s, d):
    g = hy.breach_section(F.lit(None).cast("double"), F.when(F.col("b") > 5, 500 + F.col("b")), F.lit(495.0), F.lit(60.0), F.col("a") + 1,
                          F.col("s") * 20, F.lit(1.0), F.lit(300.0))
    return _b(s, d).select("id", *[g[k].alias(k) for k in ("crest_m", "invert_m", "bottom_m", "clamped")])


@query("fn18_ritter_profile", "FN18 AGG31", """
    SELECT id, round(CASE WHEN xi <= -c0 THEN h0 WHEN xi < 2 * c0 THEN (2 * c0 - xi) * (2 * c0 - xi) / (9 * 9.81) ELSE 0 END, 6) AS h,
           round(CASE WHEN xi > -c0 AND xi < 2 * c0 THEN 2.0 / 3 * (xi + c0) ELSE 0 END, 6) AS u, round(2 * c0 * 5, 6) AS front, round(8.0 / 27 * sqrt(9.81) * pow(h0, 1.5), 6) AS q0
    FROM (SELECT *, sqrt(9.81 * h0) AS c0, x / 5.0 AS xi FROM (SELECT id, b + 1 AS h0, a * 2 - 60 AS x FROM breaches))""", ("breaches",))
def _(s, d):
    x, t, h0, x0 = F.col("a") * 2 - 60, F.lit(5.0), F.col("b") + 1, F.lit(0.0)
    return rounded(_b(s, d).select("id", hy.ritter_depth(x, t, h0, x0).alias("h"), hy.ritter_velocity(x, t, h0, x0).alias("u"),
                                   hy.ritter_front(t, h0, x0).alias("front"), hy.ritter_discharge(h0).alias("q0")))


# the wave speed at which both branches meet, halved sixty times between the two states
_STOKER = """
    SELECT *, cm * cm / 9.81 AS hm, 2.0 * (cl - cm) AS u2, cm * cm / 9.81 * 2.0 * (cl - cm) / (cm * cm / 9.81 - hr) AS shock FROM (
      SELECT *, (pin.lo + pin.hi) / 2.0 AS cm FROM (
        SELECT *, list_reduce(
          list_prepend(struct_pack(lo := sqrt(9.81 * hr), hi := cl), list_transform(range(60), lambda i: struct_pack(lo := cl, hi := cl))),
          lambda acc, i: CASE WHEN 2.0 * (cl - (acc.lo + acc.hi) / 2.0) > (pow((acc.lo + acc.hi) / 2.0, 2) / 9.81 - hr)
                                * sqrt(0.5 * 9.81 * (9.81 / pow((acc.lo + acc.hi) / 2.0, 2) + 1.0 / hr))
            THEN struct_pack(lo := (acc.lo + acc.hi) / 2.0, hi := acc.hi) ELSE struct_pack(lo := acc.lo, hi := (acc.lo + acc.hi) / 2.0) END) AS pin
        FROM (SELECT *, sqrt(9.81 * hl) AS cl FROM ({source}))))"""


@query("fn19_stoker_middle_state", "FN19", f"""
    SELECT id, CASE WHEN hl > hr THEN round(hm, 6) END AS hm, CASE WHEN hl > hr THEN round(u2, 6) END AS u2,
           CASE WHEN hl > hr THEN round(shock, 6) END AS shock
    FROM ({_STOKER.format(source='SELECT id, b + 2.0 AS hl, (a + 1) / 100.0 AS hr FROM breaches')})""", ("breaches",))
def _(s, d):
    x = _b(s, d).withColumn("m", hy.stoker_state(F.col("b") + 2, (F.col("a") + 1) / 100.0))
    return rounded(x.select("id", "m.hm", "m.u2", "m.shock"))


@query("fn19_stoker_profile", "FN19", f"""
    SELECT id, round(CASE WHEN xi <= -cl THEN hl WHEN xi <= u2 - cm THEN (2.0 * cl - xi) * (2.0 * cl - xi) / (9.0 * 9.81)
                          WHEN xi < shock THEN hm ELSE hr END, 6) AS h,
           round(CASE WHEN xi <= -cl THEN 0.0 WHEN xi <= u2 - cm THEN 2.0 / 3.0 * (xi + cl) WHEN xi < shock THEN u2 ELSE 0.0 END, 6) AS u
    FROM (SELECT *, (a * 2.0 - 80.0) / 5.0 AS xi FROM ({_STOKER.format(source='SELECT id, a, b + 2.0 AS hl, 0.5 AS hr FROM breaches')}))""",
       ("breaches",))
def _(s, d):
    hl, hr = F.col("b") + 2, F.lit(0.5)
    x = _b(s, d).withColumn("m", hy.stoker_state(hl, hr)).withColumn("x", F.col("a") * 2 - 80)
    return rounded(x.select("id", hy.stoker_depth(F.col("x"), F.lit(5.0), hl, hr, F.lit(0.0), F.col("m")).alias("h"),
                            hy.stoker_velocity(F.col("x"), F.lit(5.0), hl, F.lit(0.0), F.col("m")).alias("u")))


@query("fn20_inflow_speed", "FN20", """
    SELECT id, round(CASE WHEN a <= 0 THEN 0 ELSE sqrt(9.81 * pow(a * 27.0 / (8 * sqrt(9.81)), 2.0 / 3)) END, 6) AS u FROM breaches""", ("breaches",))
def _(s, d):
    return rounded(_b(s, d).select("id", hy.inflow_speed(F.col("a")).alias("u")))


# --- validation ---------------------------------------------------------------------------------

_OBS_CELLS = """(SELECT k.run_id, k.r, k.c, 1000 + 0.5 * (k.r % 20) AS z, max_depth, arrival_s FROM cells k)"""
_SAMPLED = f"""SELECT o.run_id, o.name, o.label, o.kind, o.ws_obs_m, o.at_obs_s,
      CASE WHEN ws_obs_m IS NOT NULL THEN max(z + max_depth) FILTER (WHERE max_depth > 0.1) END AS mod_ws,
      CASE WHEN at_obs_s IS NOT NULL THEN min(arrival_s) END AS mod_at
    FROM observations o LEFT JOIN {_OBS_CELLS} k ON k.run_id = o.run_id
      AND (20.0 * k.c - o.x) ** 2 + (20.0 * k.r - o.y) ** 2 <= CASE WHEN kind = 'gauge' THEN 100.0 ELSE 900.0 END
    GROUP BY o.run_id, o.name, o.label, o.kind, o.ws_obs_m, o.at_obs_s"""


def _sampled(s, d):
    c = cells(s, d).withColumn("z", 1000 + 0.5 * (F.col("r") % 20))
    return sampling.sample_observations(view(s, d, "observations"), c, 0.0, 0.0, 20.0)


@query("agg20_observation_samples", "AGG20 JN5 JN18", f"SELECT run_id, name, mod_ws, mod_at FROM ({_SAMPLED})", ("observations", "cells"))
def _(s, d):
    return _sampled(s, d).select("run_id", "name", "mod_ws", "mod_at")


@query("agg18_error_norms", "AGG18", f"""
    SELECT kind, count(e) AS n, round(avg(abs(e)), 6) AS l1, round(sqrt(avg(e * e)), 6) AS l2, max(abs(e)) AS linf, round(avg(e), 6) AS bias
    FROM (SELECT kind, mod_ws - ws_obs_m AS e FROM ({_SAMPLED})) GROUP BY kind""", ("observations", "cells"))
def _(s, d):
    return rounded(sampling.error_norms(_sampled(s, d), ["kind"], "ws_err"))


@query("agg19_validation_score", "AGG19", f"""
    SELECT run_id, count(mod_ws - ws_obs_m) AS ws_n, round(avg(abs(mod_ws - ws_obs_m)), 6) AS ws_l1,
           round(avg(abs(mod_at - at_obs_s)) FILTER (WHERE kind = 'gauge'), 6) AS at_l1, count(*) AS points,
           count(*) FILTER (WHERE ws_obs_m IS NOT NULL AND mod_ws IS NULL) AS dry_in_model,
           max(mod_at) FILTER (WHERE label = 'B') - max(mod_at) FILTER (WHERE label = 'A') - 1140 AS rel_err_b_s
    FROM ({_SAMPLED}) GROUP BY run_id""", ("observations", "cells"))
def _(s, d):
    return rounded(sampling.validation_score(_sampled(s, d)).select("run_id", "ws_n", "ws_l1", "at_l1", "points", "dry_in_model", "rel_err_b_s"))


@query("agg30_gauges_by_label", "AGG30", """
    SELECT o.name, o.kind, arrival_s, max_depth, round(max_speed, 6) AS max_speed FROM observations o
    LEFT JOIN cells k ON k.run_id = o.run_id AND k.c = CAST(round_even(o.x / 20.0, 0) AS INT) AND k.r = CAST(round_even(o.y / 20.0, 0) AS INT)""", ("observations", "cells"))
def _(s, d):
    o = view(s, d, "observations").withColumn("c", F.bround(F.col("x") / 20, 0).cast("int")).withColumn("r", F.bround(F.col("y") / 20, 0).cast("int"))
    return rounded(sampling.at_cells(o, cells(s, d), "arrival_s", "max_depth", "max_speed").select(
        "name", "kind", "arrival_s", "max_depth", "max_speed"))


@query("agg30_arrivals_pivoted", "AGG30", """
    SELECT run_id, max(CASE WHEN label = 'A' THEN arrival_s END) AS a_s, max(CASE WHEN label = 'B' THEN arrival_s END) AS b_s,
           max(CASE WHEN label = 'C' THEN arrival_s END) AS c_s FROM (
      SELECT o.run_id, o.label, k.arrival_s FROM observations o LEFT JOIN cells k ON k.run_id = o.run_id
        AND k.c = CAST(round_even(o.x / 20.0, 0) AS INT) AND k.r = CAST(round_even(o.y / 20.0, 0) AS INT)) GROUP BY run_id""", ("observations", "cells"))
def _(s, d):
    o = view(s, d, "observations").withColumn("c", F.bround(F.col("x") / 20, 0).cast("int")).withColumn("r", F.bround(F.col("y") / 20, 0).cast("int"))
    return sampling.by_label(sampling.at_cells(o, cells(s, d), "arrival_s"), "arrival_s", ("A", "B", "C"), "_s")


@query("agg31_profile_front", "AGG31", """
    SELECT run_id, coalesce(max(c * 90.0) FILTER (WHERE max_depth > 4.9), -1.0) AS front FROM cells GROUP BY run_id""", ("cells",))
def _(s, d):
    return particles.profile_front(cells(s, d).select("run_id", F.col("max_depth").alias("h"), (F.col("c") * 90.0).alias("x")), 4.9, -1.0)


# --- particles and meshes ---------------------------------------------------------------------------

@query("agg29_gauge_flux", "AGG29", """
    SELECT run_id, t_s, round(coalesce(sum(m / rho * u) FILTER (WHERE fluid AND abs(x - 3.0) < 0.5), 0) / 1.0, 9) AS q FROM particles GROUP BY ALL""", ("particles",))
def _(s, d):
    return rounded(particles.gauge_flux(view(s, d, "particles"), 3.0, 0.5), 9)


@query("agg29_free_surface", "AGG29", """
    SELECT t.run_id, t.t_s, bin, (bin + 0.5) * 0.5 AS x_mid, round(coalesce(max(z), 0), 9) AS h FROM (SELECT DISTINCT run_id, t_s FROM particles) t
    CROSS JOIN (SELECT unnest(range(14)) AS bin) LEFT JOIN (SELECT *, least(greatest(floor(x / 0.5), 0), 13) AS b FROM particles WHERE fluid) p
      ON p.run_id = t.run_id AND p.t_s = t.t_s AND p.b = bin GROUP BY t.run_id, t.t_s, bin""", ("particles",))
def _(s, d):
    return rounded(particles.free_surface(view(s, d, "particles"), 7.0, 0.5), 9)


@query("agg29_front_and_volume", "AGG29", """
    SELECT run_id, t_s, coalesce(max(x) FILTER (WHERE fluid AND z < 0.2), max(x) FILTER (WHERE fluid)) AS front,
           round(coalesce(sum(m / rho) FILTER (WHERE fluid), 0), 6) AS volume FROM particles GROUP BY ALL""", ("particles",))
def _(s, d):
    return rounded(particles.front_and_volume(view(s, d, "particles"), 0.1))


@query("src9_face_maxima", "SRC9", "SELECT face_id, max(depth) AS max_depth, max(wl) AS max_wl, count(*) AS times FROM face_frames GROUP BY face_id", ("face_frames",))
def _(s, d):
    return mesh.face_maxima(view(s, d, "face_frames"))


@query("src9_map_import", "SRC9", """
    SELECT face_id, max(depth) AS max_depth, max(wl) AS max_wl, min(700 + face_id % 50 * 1.5) AS bed, count(*) AS times FROM face_frames GROUP BY face_id""", ("face_frames",))
def _(s, d):
    f = view(s, d, "face_frames").select("face_id", "t_s", F.col("depth").alias("mesh2d_waterdepth"), F.col("wl").alias("Mesh2D_S1"),
                                         (700 + F.col("face_id") % 50 * 1.5).alias("mesh2d_flowelem_bl"))
    return mesh.face_maxima(mesh.read_map(f))


@query("src9_map_without_levels", "SRC9", "SELECT face_id, max(depth) AS max_depth, count(*) AS times FROM face_frames GROUP BY face_id", ("face_frames",))
def _(s, d):
    return mesh.face_maxima(mesh.read_map(view(s, d, "face_frames").select("face_id", "t_s", F.col("depth").alias("water_depth"))))


@query("snk8_quad_faces", "SNK8", """
    SELECT run_id, CAST(r AS BIGINT) * 50 + c AS face_id, (r + 1) * 51 + c AS sw, r * 51 + c AS nw, (c + 0.5) * 90 AS x, 27000 - (r + 0.5) * 90 AS y FROM dem""", ("dem",))
def _(s, d):
    dem = view(s, d, "dem")
    f = mesh.faces(dem, grid.grid_sizes(dem), DX, 0.0, 27000.0)
    return f.select("run_id", "face_id", F.get("node_ids", F.lit(0)).alias("sw"), F.get("node_ids", F.lit(3)).alias("nw"), "x", "y")


@query("agg25_mesh_quality", "AGG25", """
    SELECT run_id, true AS indices_in_range, true AS faces_ccw, true AS bed_finite, count(*) AS n_faces, (max(r) + 2) * (max(c) + 2) AS n_nodes FROM dem GROUP BY run_id""", ("dem",))
def _(s, d):
    dem = view(s, d, "dem")
    z = grid.grid_sizes(dem)
    return mesh.mesh_quality(mesh.faces(dem, z, DX, 0.0, 27000.0), mesh.nodes(z, DX, 0.0, 27000.0))


# --- radar observation --------------------------------------------------------------------------------

EVENT = "2024-01-16"
_PRE = "acq_date >= DATE '2023-12-23' AND acq_date < DATE '2024-01-16' AND mode = 'IW' AND pols = 'VV,VH'"
_POST = "acq_date >= DATE '2024-01-16' AND acq_date < DATE '2024-02-01' AND mode = 'IW' AND pols = 'VV,VH'"
_MED = "SELECT run_id, r, c, median(db) AS db FROM sar_px WHERE {w} GROUP BY ALL"


def _composites(s, d):
    px, e = view(s, d, "sar_px"), F.lit(EVENT).cast("date")
    pre, post = ft.pre_window(e), ft.post_window(e)
    return [observe.median_composite(observe.select_scenes(px, w["start"], w["end"])) for w in (pre, post)]


@query("src12_scene_filter", "SRC12", f"SELECT orbit, count(*) AS n, round(sum(db), 4) AS db FROM sar_px WHERE {_PRE} GROUP BY orbit", ("sar_px",))
def _(s, d):
    w = ft.pre_window(F.lit(EVENT).cast("date"))
    return rounded(observe.select_scenes(view(s, d, "sar_px"), w["start"], w["end"]).groupBy("orbit").agg(F.count("*").alias("n"), F.sum("db").alias("db")), 4)


@query("agg21_median_composite", "AGG21", f"SELECT run_id, r, c, round(db, 6) AS db FROM ({_MED.format(w=_PRE)})", ("sar_px",))
def _(s, d):
    return rounded(_composites(s, d)[0])


_FOCAL = """SELECT a.run_id, a.r, a.c, median(b.db) AS v FROM ({m}) a JOIN ({m}) b ON b.run_id = a.run_id
    AND (b.r - a.r) * (b.r - a.r) + (b.c - a.c) * (b.c - a.c) <= 1 GROUP BY ALL"""
_CHANGED = f"""SELECT a.run_id, a.r, a.c FROM ({_FOCAL.format(m=_MED.format(w=_PRE))}) a JOIN ({_FOCAL.format(m=_MED.format(w=_POST))}) b USING (run_id, r, c)
    WHERE b.v / a.v > 1.02"""


def _changed(s, d):
    return observe.changed_cells(*_composites(s, d), 1.0, 1.02, tile=64)


def _slope(s, d):
    pre, _ = _composites(s, d)
    return pre.select(*grid.CELL, (F.col("c") % 7).cast("double").alias("slope_deg"))


@query("prj10_refined_flood_pixels", "PRJ10", f"""
    SELECT x.run_id, x.r, x.c FROM ({_CHANGED}) x LEFT JOIN occurrence USING (run_id, r, c) WHERE coalesce(occurrence, 0) < 50 AND x.c % 7 <= 5""", ("sar_px", "occurrence"))
def _(s, d):
    return observe.refine(_changed(s, d).select(*grid.CELL), view(s, d, "occurrence"), _slope(s, d)).select(*grid.CELL)


@query("agg22_observed_area", "AGG22", f"""
    SELECT round(coalesce(sum(900.0 * cos(radians(30 + r * 0.01))), 0) / 1e6, 9) AS km2 FROM ({_CHANGED}) x LEFT JOIN occurrence USING (run_id, r, c)
    WHERE coalesce(occurrence, 0) < 50 AND x.c % 7 <= 5""", ("sar_px", "occurrence"))
def _(s, d):
    f = observe.refine(_changed(s, d).select(*grid.CELL), view(s, d, "occurrence"), _slope(s, d))
    return rounded(observe.observed_area(f, 900.0 * F.cos(F.radians(30 + F.col("r") * 0.01))), 9)


@query("st5_event_bands_on_stream", "ST5 PRJ10", f"""
    SELECT x.run_id, x.r, x.c FROM ({_CHANGED}) x LEFT JOIN occurrence USING (run_id, r, c) WHERE coalesce(occurrence, 0) < 50 AND x.c % 7 <= 5""", ("sar_px", "occurrence"))
def _(s, d):
    px = stream_view(s, d, "events", "sar_px").withColumn("acquired", F.col("acq_date").cast("timestamp"))
    events = s.range(1).select(F.lit(0).alias("run_id"), F.lit(EVENT).cast("date").alias("event_date"))
    found = streams.drain(streams.event_scenes(px, events, view(s, d, "occurrence"), _slope(s, d), "10 days", ["event_id"]), "append")
    usable = found.groupBy(*grid.CELL).agg(F.bool_and("usable").alias("usable")).where("usable").select(*grid.CELL)
    pre, post = (observe.median_composite(found.where(F.col("band") == b)) for b in ("pre", "post"))
    return observe.changed_cells(pre, post, 1.0, 1.02, tile=64).join(usable, grid.CELL, "left_semi").select(*grid.CELL)


_DARK = f"""(SELECT a.run_id, a.r, a.c FROM ({_FOCAL.format(m=_MED.format(w=_PRE))}) a JOIN ({_FOCAL.format(m=_MED.format(w=_POST))}) b USING (run_id, r, c)
    LEFT JOIN occurrence USING (run_id, r, c) WHERE b.v / a.v > 0.98 AND coalesce(occurrence // 2, 0) < 50 AND a.c % 7 <= 5)"""
_BLOBS = _COMP.format(diag=",(1,1),(1,-1),(-1,1),(-1,-1)").replace("FROM low", "FROM dark").replace("JOIN low n", "JOIN dark n")
DERIVED["dark"] = (("sar_px", "occurrence"), f"SELECT * FROM {_DARK}")


@query("gr13_observed_flood_extent", "GR13 PRJ10 GR10", f"""
    SELECT run_id, r, c FROM ({_BLOBS}) QUALIFY count(*) OVER (PARTITION BY run_id, lab) >= 8""", ("dark",))
def _(s, d):
    pre, post = _composites(s, d)
    occ = view(s, d, "occurrence").withColumn("occurrence", F.floor(F.col("occurrence") / 2).cast("int"))
    return observe.flood_pixels(pre, post, occ, _slope(s, d), 1.0, threshold=0.98, tile=64)


@query("dt1_event_windows", "DT1 ST5", """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) - 24 AS pre_start, CAST(o_orderdate AS DATE) + 16 AS post_end FROM orders""")
def _(s, d):
    from floodspark.sources.tables import table
    e = F.col("o_orderdate").cast("date")
    return table(s, d, "orders").select("o_orderkey", ft.pre_window(e)["start"].alias("pre_start"), ft.post_window(e)["end"].alias("post_end"))
