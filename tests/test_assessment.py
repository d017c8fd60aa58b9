import math

import pytest
from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.functions import arrival, damage, hazard, text
from floodspark.operators import exposure, masks, sampling
from floodspark.plans import summary as ps

DX = 90.0


def scene(spark, depth=2.0):
    """20 x 20 cells: west half floods, two columns of lake, five minutes per column."""
    rows = [(1, r, c, depth if c < 10 else 0.0, 1.5 if c < 10 else 0.0, depth * 1.5 if c < 10 else 0.0,
             c * 300.0 if c < 10 and depth > 0 else None, c < 2, 10.0, True) for r in range(20) for c in range(20)]
    return spark.createDataFrame(rows, "run_id int, r int, c int, max_depth double, max_speed double, max_dv double, "
                                       "arrival_s double, initially_wet boolean, pop double, valid boolean")


def enriched(spark, **kw):
    return exposure.enrich(scene(spark, **kw)).withColumn("reportable", F.lit(True))


def test_scene_figures(spark):
    e = enriched(spark).cache()
    f = exposure.run_figures(e, DX).first()
    assert (f.flooded_cells, round(f.wetted_km2, 6), round(f.new_km2, 6)) == (200, 1.62, 1.296)
    assert (f.first_arrival_min, f.last_arrival_min, f.peak_depth_m) == (10.0, 45.0, 2.0)
    t = exposure.exposure_totals(e).first()
    assert (t.total, t.by_hazard, t.by_band, t.cross_tab, t.disagreeing_cells) == (1600.0, 1600.0, 1600.0, 1600.0, 0)
    bands = {x.label: x.km2 for x in exposure.area_by_class(e, "band", arrival.band_labels(), DX).collect()}
    assert len(bands) == 5 and bands[">120 min"] == 0 and abs(sum(bands.values()) - 1.296) < 1e-9
    assert exposure.cross_tab(e).count() == 20
    pairs = {x.level: x.people for x in exposure.exposure_cube(e).groupBy("level").agg(F.sum("people").alias("people")).collect()}
    assert set(pairs.values()) == {1600.0}


def test_nothing_floods(spark):
    e = enriched(spark, depth=0.0)
    f = exposure.run_figures(e, DX).first()
    assert (f.flooded_cells, f.first_arrival_min, f.peak_depth_m, f.never_cells) == (0, None, 0.0, 400)
    assert exposure.exposure_totals(e).first().total == 0.0


def test_band_edges_are_closed_below(spark):
    df = spark.createDataFrame([(m,) for m in (0.0, 14.999, 15.0, 30.0, 59.9, 60.0, 120.0, None, float("nan"))], "m double")
    got = [x.b for x in df.select(arrival.band_index(F.col("m")).alias("b")).collect()]
    assert got == [0, 0, 1, 2, 2, 3, 4, -1, -1]
    hr = spark.createDataFrame([(v,) for v in (0.74, 0.75, 1.25, 2.5)], "v double")
    assert [x.k for x in hr.select(hazard.hazard_class(F.col("v"), F.lit(False)).alias("k")).collect()] == [0, 1, 2, 3]


def test_fast_shallow_water_is_debris_carrying_and_h5(spark):
    df = spark.createDataFrame([(0.2, 3.0), (0.2, 0.1), (0.05, 5.0)], "d double, v double")
    dry = hazard.is_dry(F.col("d"))
    got = df.select(hazard.debris_factor(F.col("d"), F.col("v"), "pasture_arable").alias("df"),
                    hazard.aidr_class(F.col("d"), F.col("v"), dry).alias("k")).collect()
    assert [(x.df, x.k) for x in got] == [(0.5, 4), (0.0, 0), (0.5, -1)]
    with pytest.raises(ValueError):
        hazard.debris_factor(F.col("d"), F.col("v"), "swamp")
    with pytest.raises(Exception, match="out of range"):
        df.select(hazard.debris_factor(F.col("d"), F.col("v"), F.lit(3))).collect()


@pytest.mark.parametrize("curve", list(fixed.DAMAGE_CURVES))
def test_every_tabulated_damage_point(spark, curve):
    pts = list(zip(fixed.CURVE_DEPTHS, fixed.DAMAGE_CURVES[curve]))
    df = spark.createDataFrame(pts + [(-1.0, 0.0), (50.0, 1.0)], "d double, want double")
    for x in df.select("want", damage.damage_fraction(F.col("d"), curve).alias("got")).collect():
        assert math.isclose(x.want, x.got, abs_tol=1e-12)


def test_damage_units_must_agree(spark):
    t = spark.createDataFrame([(1, 1.0, 0.5, 2.0, "INR"), (1, 1.0, 0.5, 2.0, "USD")],
                              "run_id int, central double, low double, high double, unit string")
    with pytest.raises(Exception, match="different units"):
        exposure.total_damage(t).collect()
    assert exposure.total_damage(t.where("unit = 'INR'")).first().high == 2.0


def test_unreached_and_outside_settlements_keep_their_rows(spark):
    p = spark.createDataFrame([(1, 1, "Near", 400.0, 1700.0, 50), (1, 2, None, 1500.0, 900.0, 9), (1, 3, "Away", 9999.0, 10.0, 7)],
                              "run_id int, poi_id int, name string, x double, y double, population long")
    loc = sampling.locate(p, [DX, 0.0, 0.0, 0.0, -DX, 1800.0], 20, 20)
    got = [(x.name, x.arr_min, x.flooded, x.haz_class, x.band, x.outside)
           for x in sampling.by_urgency(sampling.settlements_at_risk(loc, enriched(spark))).collect()]
    assert got[0][:3] == ("Near", 20.0, True)
    assert got[1] == ("Away", -1.0, False, -1, -1, True)
    assert got[2] == ("unnamed_2", -1.0, False, -1, -1, False)


def test_reportable_mask_and_erosion(spark):
    e = enriched(spark).drop("reportable")
    sizes = grid.grid_sizes(e)
    seeds = e.where("r = 10 and c = 10").select(*grid.CELL)
    m = masks.reportable(e, sizes, seeds, DX, ("i0",), 3, near_field_m=2 * DX)
    bad = {(x.r, x.c) for x in m.where(~F.col("reportable")).collect()}
    want = {(r, c) for r in range(20) for c in range(20) if c < 3 or abs(r - 10) + abs(c - 10) <= 2}
    assert bad == want
    kept = {(x.r, x.c) for x in masks.erode(e.where("c < 6"), 2).collect()}
    assert kept == {(r, c) for r in range(2, 18) for c in range(2, 4)}


def test_gate_and_caveats(spark):
    r = spark.createDataFrame([(1, 0, False, 0.0, False, True), (2, 3, True, -0.1, False, False), (3, 0, False, -0.1, True, True)],
                              "run_id int, unverified_n int, has_damage boolean, volume_error double, open_edges boolean, conserved boolean")
    got = {x.run_id: (x.presentable, len(x.reasons)) for x in ps.release_gate(r).collect()}
    assert got == {1: (True, 0), 2: (False, 4), 3: (True, 0)}
    c = spark.createDataFrame([(1, 1, 0, "b"), (1, 0, 0, "a"), (1, 2, 0, "a")], "run_id int, stage int, pos int, text string")
    assert ps.ordered_distinct(c).first().limitations == ["a", "b"]


def test_text_functions(spark):
    df = spark.createDataFrame([(12437.0,), (12500.0,), (13500.0,), (7.0,), (0.0,), (-3.0,)], "v double")
    assert [x.p for x in df.select(text.two_figures(F.col("v")).alias("p")).collect()] == [12000, 12000, 14000, 7, 0, 0]
    one = spark.range(1)
    row = one.select(text.kml_colour(F.lit("#7f0000"), F.lit(1.0)).alias("k"),
                     text.escapes(F.lit("a/../../b")).alias("e1"), text.escapes(F.lit("a/..b/c")).alias("e2"),
                     text.show_volume_error(F.lit(0.00123)).alias("v"), text.area_text(F.lit(1.296)).alias("a"),
                     damage.format_crore(F.lit(5e8), F.lit(2e9)).alias("c"),
                     text.finite(F.lit(float("nan"))).alias("n")).first()
    assert (row.k, row.e1, row.e2, row.v, row.a, row.n) == ("ff00007f", True, False, "1.23e-3", "1.3", None)
    assert row.c == "Rs 50-200 crore (order-of-magnitude estimate)"
    with pytest.raises(Exception, match="expected #rrggbb"):
        one.select(text.kml_colour(F.lit("#fff"), F.lit(1.0))).collect()
