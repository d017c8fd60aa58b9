from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from floodspark import grid
from floodspark.functions import geodesy, hydraulics
from floodspark.operators import masks, quantiles, resample, series, terrain, vectors
from floodspark.sources import rasters
from test_hydrology import array, pitted, table


@pytest.mark.parametrize("dense", [True, False])
def test_nearest_seed_is_exact_with_ties_by_row_then_column(spark, dense):
    rng = np.random.default_rng(2)
    seed = rng.random((17, 23)) < 0.04
    seed[3, 4] = True
    got = terrain.nearest_seed(table(spark, seed.astype(float), seed=seed), "seed", dense).toPandas()
    pts = np.argwhere(seed)
    for x in got.itertuples():
        best = min(((x.r - a) ** 2 + (x.c - b) ** 2, a, b) for a, b in pts)
        assert (x.d2, x.seed_r, x.seed_c) == best


def test_sparse_grid_reaches_seeds_through_missing_cells(spark):
    df = spark.createDataFrame([(0, 0, 0, True), (0, 5, 3, False), (0, 9, 9, False)], "run_id int, r int, c int, seed boolean")
    got = {(x.r, x.c): x.d2 for x in terrain.nearest_seed(df, "seed", False).collect()}
    assert got == {(0, 0): 0, (5, 3): 34, (9, 9): 162}


def test_capped_fill_is_all_or_nothing_per_depression(spark):
    z = pitted(4)
    full = brute.fill(z)
    lab = brute.label(full > z, False)
    want = full.copy()
    for k in set(lab[lab >= 0]):
        if (full - z)[lab == k].max() > 6.0:
            want[lab == k] = z[lab == k]
    assert (array(terrain.capped_fill(table(spark, z), 6.0, 8), "filled", z.shape) == want).all()


def test_pool_is_found_from_its_flat(spark):
    rr, cc = np.indices((40, 40))
    z = 100.0 + np.hypot(rr - 20.0, cc - 20.0) * 3 + (rr % 2) * 0.5
    z[12:28, 12:28] = 90.0
    z[0, 20] = 80.0
    df = table(spark, z)
    sizes = grid.grid_sizes(df)
    dams = spark.createDataFrame([(0, 20, 25, 1.0e6)], "run_id int, r int, c int, published_m2 double")
    pool = terrain.detect_pools(df, sizes, dams, 30.0, search=10, tile=16).cache()
    assert pool.count() == 256 and pool.first().level == 90.0
    rep = terrain.pool_report(pool, sizes, dams, 30.0).first()
    assert not rep.suspect and not rep.touches_j0
    far = dams.withColumn("r", F.lit(39)).withColumn("c", F.lit(39))
    assert terrain.detect_pools(df, sizes, far, 30.0, search=3, tile=16).count() == 0


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(size=1001), 2), np.full(50, 3.0)
    pdf = pd.concat([pd.DataFrame({"k": 0, "v": a}), pd.DataFrame({"k": 1, "v": b})])
    got = {(x.k, x.q): x.value for x in quantiles.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", [0.1, 0.5, 0.95]).collect()}
    for q in (0.1, 0.5, 0.95):
        assert abs(got[0, q] - np.quantile(a, q)) < 1e-12 and got[1, q] == 3.0


def test_one_far_value_does_not_hide_the_rest(spark):
    rng = np.random.default_rng(9)
    a = np.concatenate([rng.normal(size=4000), [1e12, -1e300, 1e308]])
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "v": a})).unionByName(
        spark.createDataFrame(pd.DataFrame({"k": 1, "v": rng.integers(0, 3, 500).astype(float)})))
    qs = [0.0, 0.01, 0.5, 0.77, 0.999, 1.0]
    got = {(x.k, x.q): x.value for x in quantiles.exact_quantiles(df, ["k"], "v", qs, small=20, buckets=8).collect()}
    one = df.where("k = 1").toPandas()["v"]
    for q in qs:
        assert got[0, q] == pytest.approx(np.quantile(a, q), rel=1e-12) and got[1, q] == np.quantile(one, q)
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_rings_keep_holes_and_area(spark):
    m = [(r, c) for r in range(5) for c in range(5) if (r, c) != (2, 2)] + [(5, 5)]
    df = spark.createDataFrame([(0, r, c, 1) for r, c in m], "run_id int, r int, c int, cls int")
    rings = vectors.traced_rings(df).cache()
    areas = {x.ring: x.signed_cells for x in vectors.ring_areas(rings).collect()}
    assert sorted(areas.values()) == [-1.0, 1.0, 25.0] and sum(areas.values()) == len(m)
    vertices = vectors.ring_vertices(rings, [1.0, 0.0, 0.0, 0.0, -1.0, 6.0])
    corners = Counter(x.ring for x in vertices.collect())
    assert all(n == 4 for n in corners.values())
    for per in (1, 4096):  # a ring's blocks join to one closed text
        blocks = vectors.ring_text(vertices, per).orderBy("ring", "block").collect()
        for ring in areas:
            points = ", ".join(x.points for x in blocks if x.ring == ring).split(", ")
            assert len(points) == 5 and points[0] == points[-1]
            xy = np.array([list(map(float, p.split())) for p in points])
            area = (xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]).sum() / 2
            assert area == areas[ring]
    assert len(blocks) == 3


def test_segment_split_is_exact(spark):
    s = spark.createDataFrame([(0, 1, 0.5, 9.5, 3.5, 6.5), (0, 2, 1.0, 9.0, 1.0, 9.0)],
                              "run_id int, feature_id int, xa double, ya double, xb double, yb double")
    got = vectors.segments_to_cells(s, 1.0, 0.0, 10.0).where("feature_id = 1").toPandas()
    assert set(zip(got["r"], got["c"])) == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert abs(got["length_m"].sum() - 3 * 2 ** 0.5) < 1e-12


@pytest.mark.parametrize("bucket", [10.0, 1e9])
def test_series_do_not_depend_on_bucket_size(spark, bucket):
    t = [0.0, 3.0, 9.0, 25.0, 61.0]
    q = [0.0, 5.0, 2.0, 8.0, 1.0]
    pts = spark.createDataFrame([(1, "a", a, b) for a, b in zip(t, q)], "run_id int, label string, t_s double, q double")
    assert abs(series.trapezoid(pts, bucket).first().volume - np.trapezoid(q, t)) < 1e-9
    probes = [-5.0, 0.0, 4.0, 12.0, 40.0, 61.0, 90.0]
    pr = spark.createDataFrame([(1, "a", p) for p in probes], "run_id int, label string, t_s double")
    got = {x.t_s: x.q for x in series.interpolate(pts, pr, bucket).collect()}
    assert all(abs(got[p] - np.interp(p, t, q)) < 1e-12 for p in probes)


def test_utm_against_published_points(spark):
    # CN Tower, Toronto: zone 17, 630084 m E, 4833438 m N
    df = spark.createDataFrame([(43.0 + 38.0 / 60 + 33.24 / 3600, -(79.0 + 23.0 / 60 + 13.7 / 3600))], "lat double, lon double")
    p = geodesy.utm_forward(F.col("lat"), F.col("lon"), geodesy.utm_zone(F.col("lon")))
    row = df.select(geodesy.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"), p.alias("p")).first()
    assert row.epsg == "EPSG:32617" and abs(row.p.x - 630084) < 1 and abs(row.p.y - 4833438) < 1
    # on the central meridian easting is exactly 500 km and the equator is northing 0
    z = spark.createDataFrame([(0.0, 81.0)], "lat double, lon double").select(geodesy.utm_forward(F.col("lat"), F.col("lon"), F.lit(44)).alias("p")).first()
    assert abs(z.p.x - 500000) < 1e-6 and abs(z.p.y) < 1e-6


def test_aligned_resampling_conserves_people_exactly(spark):
    src = spark.createDataFrame([(0, i, j, float(i * 7 + j)) for i in range(6) for j in range(6)], "run_id int, sr int, sc int, cnt double")
    tgt = spark.createDataFrame([(0, i, j) for i in range(12) for j in range(12)], "run_id int, r int, c int")
    down = lambda r, c: F.struct((r / 2.0).alias("r"), (c / 2.0).alias("c"))
    up = lambda r, c: F.struct((r * 2.0).alias("r"), (c * 2.0).alias("c"))
    sizes = grid.grid_sizes(tgt)
    pop = resample.resample_population(src, tgt, down, 50.0, F.lit(10_000.0))
    rep = resample.conservation(src, pop, up, sizes).first()
    assert abs(rep.residual) < 1e-12 and rep.conserved


def test_people_cross_a_change_of_projection(spark):
    raster = resample.GeographicRaster(78.9, 29.85, 0.004)
    utm = resample.UtmGrid(300_000.0, 3_298_000.0, 90.0, 44)
    rng = np.random.default_rng(1)
    counts = [(run, i, j, float(rng.integers(0, 900))) for run in (0, 1) for i in range(60) for j in range(40)]
    counts += [(1, 60, 0, None), (1, 60, 1, -50.0)]
    src = spark.createDataFrame(counts, "run_id int, sr int, sc int, cnt double")
    tgt = spark.createDataFrame([(run, i, j) for run in (0, 1) for i in range(60) for j in range(50)], "run_id int, r int, c int")
    pop = resample.people_across(src, raster, tgt, utm).cache()
    rep = resample.conservation(src, pop, utm.from_pixels(raster), grid.grid_sizes(tgt), tolerance=0.05).collect()
    assert len(rep) == 2 and all(abs(r.residual) < 0.02 and r.conserved for r in rep)
    assert all(r.source_total < r.raw_total / 5 for r in rep)  # the padded window holds people from outside
    finer = resample.people_across(src, raster, tgt, utm, 8).agg(F.sum("pop")).first()[0]
    assert abs(finer / pop.agg(F.sum("pop")).first()[0] - 1) < 0.005
    even = resample.people_across(src.withColumn("cnt", raster.area(F.col("sr")) * 0.001), raster, tgt, utm)
    assert even.agg(F.min("pop"), F.max("pop")).first() == pytest.approx((8.1, 8.1))  # a constant density stays one


def test_a_window_beside_the_raster_is_an_error(spark):
    src = spark.createDataFrame([(0, 5, 5, 1.0), (0, 90, 5, -2.0), (1, 500, 500, 1.0)], "run_id int, sr int, sc int, cnt double")
    near = rasters.window(src.where("run_id = 0"), (0, 80), (0, 10))
    assert sorted(map(tuple, near.collect())) == [(0, 5, 5, 1.0), (0, 90, 5, 0.0)]
    with pytest.raises(Exception, match="does not overlap the raster of run 1"):
        rasters.window(src, (0, 80), (0, 10)).collect()


def test_ritter_is_the_dry_limit_of_stoker(spark):
    x = spark.createDataFrame([(v,) for v in (-40.0, -5.0, 0.0, 8.0)], "x double")
    st = hydraulics.stoker_state(F.lit(5.0), F.lit(1e-9))
    row = x.select(hydraulics.ritter_depth(F.col("x"), F.lit(3.0), F.lit(5.0), F.lit(0.0)).alias("a"),
                   hydraulics.stoker_depth(F.col("x"), F.lit(3.0), F.lit(5.0), F.lit(1e-9), F.lit(0.0), st).alias("b")).collect()
    assert all(abs(r.a - r.b) < 2e-2 for r in row)


def test_front_speed_of_a_plane_wave(spark):
    rr, cc = np.indices((6, 9))
    df = table(spark, np.zeros((6, 9)), arrival_s=cc * 30.0)
    got = terrain.front_speed(df, grid.grid_sizes(df), 90.0).toPandas()
    assert np.allclose(got["front_speed"], 3.0)


def test_lowest_parabola_with_ties():
    rng = np.random.default_rng(0)
    for _ in range(1000):
        n = int(rng.integers(1, 25))
        at = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
        off = rng.integers(-5, 6, len(at))
        got = terrain._lowest(off * off, at, 100 + off, n)
        want = [min(range(len(at)), key=lambda k: (off[k] ** 2 + (c - at[k]) ** 2, 100 + off[k], k)) for c in range(n)]
        assert got.tolist() == want


def test_absent_cells_are_dry_and_widths_are_distances(spark):
    rng = np.random.default_rng(11)
    wet = rng.random((14, 17)) < 0.8
    wet[4:11, 5:13] = True
    rows = [(0, int(r), int(c), float(r + c)) for r, c in np.argwhere(wet)]
    df = spark.createDataFrame(rows, "run_id int, r int, c int, max_depth double")
    sizes = spark.createDataFrame([(0, 14, 17)], "run_id int, ny int, nx int")
    dry = np.argwhere(~wet)
    near = {(r, c): min(((r - a) ** 2 + (c - b) ** 2) ** 0.5 for a, b in dry) for r, c in np.argwhere(wet)}
    got = {(x.r, x.c): x.half_width for x in terrain.half_widths(df, sizes).collect()}
    assert got == pytest.approx(near)
    conf = {(x.r, x.c): x.confined for x in terrain.confined(df, sizes).collect()}
    assert conf == {k: d < 1.5 for k, d in near.items()}
    bins = {x.half_width: (x.cells, x.peak, x.median) for x in terrain.width_bins(df, sizes, 10.0).collect()}
    for w, (n, peak, median) in bins.items():
        depths = [r + c for (r, c), d in near.items() if d >= w]
        assert (n, peak, median) == (len(depths), max(depths), np.median(depths))
    whole = spark.createDataFrame([(1, r, c, 1.0) for r in range(3) for c in range(3)], df.schema)
    none = terrain.half_widths(whole, spark.createDataFrame([(1, 3, 3)], "run_id int, ny int, nx int")).collect()
    assert len(none) == 9 and all(x.half_width is None for x in none)


def test_front_speed_at_the_end_of_the_data_is_unknown(spark):
    df = spark.createDataFrame([(0, 0, c, 30.0 * c) for c in range(4)] + [(0, r, 0, 0.0) for r in range(1, 4)],
                               "run_id int, r int, c int, arrival_s double")
    sizes = spark.createDataFrame([(0, 4, 9)], "run_id int, ny int, nx int")
    got = {(x.r, x.c): x.front_speed for x in terrain.front_speed(df, sizes, 90.0).collect()}
    assert got[0, 0] == 3.0 and got[0, 3] is None and got[3, 0] is None


def test_steps_to_seeds_need_no_full_grid(spark):
    rng = np.random.default_rng(12)
    here = {(int(r), int(c)) for r, c in rng.integers(0, 30, (200, 2))}
    seeds = {(int(r), int(c)) for r, c in rng.integers(-3, 33, (6, 2))}
    make = lambda s: spark.createDataFrame([(0, r, c) for r, c in s], "run_id int, r int, c int")
    for radius in (1, 4, 40):
        got = {(x.r, x.c): x.l1 for x in masks.near_l1(make(here), make(seeds), radius).collect()}
        near = {(r, c): min(abs(r - a) + abs(c - b) for a, b in seeds) for r, c in here}
        assert got == {k: v for k, v in near.items() if v <= radius}
    solid = {(r, c) for r in range(12) for c in range(15) if (r, c) not in ((5, 5), (8, 12))}
    for radius in (1, 3):
        kept = {(x.r, x.c) for x in masks.erode(make(solid), radius).collect()}
        ball = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius]
        assert kept == {(r, c) for r, c in solid if all((r + a, c + b) in solid for a, b in ball)}


def test_long_rings_are_cut_into_joined_parts(spark):
    m = [(r, c) for r in range(9) for c in range(9) if (r + c) % 2 == 0 or r == 4]
    df = spark.createDataFrame([(0, r, c, 1) for r, c in m], "run_id int, r int, c int, cls int")
    rings = vectors.traced_rings(df).cache()
    t = [1.0, 0.0, 0.0, 0.0, -1.0, 9.0]
    whole = {x.ring: x for x in vectors.ring_features(rings, t, 1.0).collect()}
    parts = vectors.ring_features(rings, t, 1.0, per=5).orderBy("ring", "part").collect()
    assert all(x.kind == "Polygon" and x.points[0] == x.points[-1] for x in whole.values())
    assert sum(-x.km2 if x.hole else x.km2 for x in whole.values()) == len(m)
    for ring, x in whole.items():
        mine = [p for p in parts if p.ring == ring]
        line = mine[0].points + [q for p in mine[1:] for q in p.points[1:]]
        assert line == x.points and all(a.points[-1] == b.points[0] for a, b in zip(mine, mine[1:]))
    assert any(x.kind == "LineString" for x in parts)
