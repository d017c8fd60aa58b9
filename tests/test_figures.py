"""Printed figures: a double is rounded as it is, and sums do not depend on the order of rows."""

from pyspark.sql import functions as F

from floodspark.functions import text
from floodspark.operators import exposure, vectors
from floodspark.plans import summary as ps


def test_figures_print_as_the_double_is(spark):
    row = spark.range(1).select(
        text.digits(F.lit(0.25), 1).alias("a"), text.digits(F.lit(12345.05), 1).alias("b"), text.digits(F.lit(-0.04), 1).alias("c"),
        text.digits(F.lit(2.5), 0).alias("d"), text.scientific(F.lit(2105.0), 2, plus=True).alias("e"),
        text.scientific(F.lit(-0.00125), 1, plus=True).alias("f"), text.scientific(F.lit(9.999), 2).alias("g"),
        text.show_duration(F.lit(255780.0)).alias("h")).first()
    assert tuple(row) == ("0.2", "%.1f" % 12345.05, "-0.0", "2", "+2.10e+03", "%+.1e" % -0.00125, "1.00e+01", "71.0 h")


def test_caveats_print_as_the_double_is(spark):
    f = spark.createDataFrame([(1, 0, 2, 6.25)], "run_id int, never_cells int, interpolated_cells int, interpolated_pct double")
    assert "2 flooded cells (6.2%) lie on terrain interpolated across voids." in {x.text for x in ps.stage_caveats(f, 90.0).collect()}
    runs = spark.createDataFrame([(1, 2105.0, True, 10, None, None, None, None, None), (2, -0.00125, True, 10, 0.0625, 1.125, 1.625, 0.1, False)],
                                 "run_id int, volume_error double, open_edges boolean, edge_cells int, min_submergence double, "
                                 "released_fraction double, pool_km2 double, published_km2 double, pool_at_edge boolean")
    got = [x.text for x in ps.run_caveats(runs, 90.0).collect()]
    assert "Relative mass error +2.10e+03; above 1e-6 it needs looking into before the result is used." in got
    assert any("0.1% of the water" in t for t in got) and any("least factor 0.062)" in t for t in got)
    assert any("released 1.12 times" in t for t in got) and any("covers 1.62 km2" in t for t in got)


def test_areas_are_cells_times_the_area_of_one(spark):
    cells = spark.range(950).select(F.lit(1).alias("run_id"), F.lit(0).alias("band"))
    a = exposure.area_by_class(cells, "band", ["near"], 90.0)
    assert a.first().km2 == 950 * 0.0081 and a.select(F.format_number("km2", 2).alias("t")).first().t == "7.69"


def test_damage_is_an_exact_sum_of_fractions(spark):
    b = spark.range(3).select(F.lit(1).alias("run_id"), F.lit("residential").alias("curve"), F.lit(0.75).alias("max_depth"))
    assert exposure.building_damage(b).first().central == 1530000.0
    cells = spark.range(10).select(F.lit(1).alias("run_id"), F.lit(True).alias("new_flood"), (F.col("id") / 8.0).alias("max_depth"))
    want = {1.0 * k: exposure.land_damage(cells.repartition(k), 90.0).first().central for k in (1, 2, 3, 7)}
    assert len(set(want.values())) == 1


def test_lengths_add_up_exactly(spark):
    visited = spark.range(10).select(F.lit(1).alias("run_id"), F.lit(2).alias("r"), F.lit(3).alias("c"), F.lit(0.1).alias("length_m"))
    flood = spark.createDataFrame([(1, 2, 3)], "run_id int, r int, c int")
    assert vectors.flooded_length(visited, flood).first().km == 0.001
