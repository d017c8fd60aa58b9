"""Joins whose generated side the planner takes for small, and work per row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark import grid
from floodspark.functions import hydraulics
from floodspark.operators import hydrology, mesh, resample, series, terrain, vectors
from floodspark.queries import assessment
from floodspark.session import scratch_path
from floodspark.sinks import bands


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sizes(spark):
    return spark.createDataFrame([(0, 6, 5)], "run_id int, ny int, nx int")


def full(spark):
    return grid.lattice(sizes(spark)).withColumn("z", F.lit(1.0))


def test_mesh_nodes_are_never_broadcast(spark):
    z = sizes(spark)
    q = mesh.mesh_quality(mesh.faces(full(spark), z, 90.0, 0.0, 540.0), mesh.nodes(z, 90.0, 0.0, 540.0))
    faces = plan(q).split("node_id")[0]
    assert "SortMergeJoin [run_id" in plan(q) and "node_id" in plan(q) and "BroadcastHashJoin" not in faces
    assert tuple(q.drop("run_id").first()) == (True, True, True, 30, 42)


def test_half_widths_broadcast_no_cells(spark):
    wet = full(spark).where("r > 0 AND r < 5 AND c > 0 AND c < 4").select(*grid.CELL, "z")
    got = terrain.half_widths(wet, sizes(spark))
    assert "BroadcastHashJoin" not in plan(got)
    assert {(x.r, x.c): x.half_width for x in got.collect()}[(2, 2)] == 2.0


def test_window_cells_are_never_broadcast(spark):
    cells = full(spark).select(*grid.CELL, F.col("c").cast("double").alias("area_km2"))
    points = spark.createDataFrame([(0, 7, 2, 2)], "run_id int, point_id int, r int, c int")
    near = hydrology._window_cells(points, cells, 1)
    assert "BroadcastHashJoin" not in plan(near) and near.count() == 9


def test_stoker_state_is_found_for_a_batch_at_once(spark):
    df = spark.createDataFrame([(5.0, 0.5), (2.0, 1.9), (1.0, 2.0), (1.0, 0.0), (None, 1.0)], "hl double, hr double")
    x = df.select("hl", "hr", hydraulics.stoker_state(F.col("hl"), F.col("hr")).alias("m")).select("hl", "hr", "m.*")
    assert "lambda" not in plan(x) and plan(x).count("ArrowEvalPython") == 1
    rows = x.collect()
    assert all(r.hm is None and r.u2 is None and r.shock is None for r in rows[2:])
    g = hydraulics.G
    for r in rows[:2]:
        assert r.hr < r.hm < r.hl
        assert math.isclose(r.u2, 2 * (math.sqrt(g * r.hl) - math.sqrt(g * r.hm)), rel_tol=1e-9)
        assert math.isclose(r.u2, (r.hm - r.hr) * math.sqrt(0.5 * g * (1 / r.hm + 1 / r.hr)), rel_tol=1e-9)
        assert math.isclose(r.shock, r.hm * r.u2 / (r.hm - r.hr), rel_tol=1e-12)


def test_rings_across_tiles_are_those_of_one_tile(spark):
    rng = random.Random(4)
    cells = [(run, r, c, rng.choice((0, 0, 1))) for run in (1, 2) for r in range(13) for c in range(11) if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "run_id int, r int, c int, cls int")
    whole = {tuple(x) for x in vectors.traced_rings(df).collect()}
    assert whole == {tuple(x) for x in vectors.traced_rings(df, tile=3).collect()}
    after = {}
    for x in vectors.traced_rings(df, tile=4).collect():
        after.setdefault((x.run_id, x.ring), {})[x.place] = x
    for (_, ring), edges in after.items():
        assert sorted(edges) == list(range(1, len(edges) + 1)) and edges[1].edge_id == ring == min(e.edge_id for e in edges.values())
        for k, e in edges.items():
            f = edges[k % len(edges) + 1]
            assert (e.cls, e.r1, e.c1) == (f.cls, f.r0, f.c0) and f.corner == (e.side != f.side)


def test_rings_within_a_tile_need_no_graph(spark, monkeypatch):
    monkeypatch.setattr(vectors, "connected", None)
    monkeypatch.setattr(vectors, "forest_sums", None)
    df = spark.createDataFrame([(1, 0, 0, 2), (1, 0, 1, 2)], "run_id int, r int, c int, cls int")
    assert sorted(x.place for x in vectors.traced_rings(df).collect()) == [1, 2, 3, 4, 5, 6]


def test_sub_points_are_counted_per_pixel_before_the_join(spark):
    source = spark.createDataFrame([(0, 0, 0, 32.0), (0, 0, 1, 64.0)], "run_id int, sr int, sc int, cnt double")
    targets = spark.createDataFrame([(0, 0, 1)], "run_id int, r int, c int")
    got = resample.resample_population(source, targets, lambda r, c: F.struct((r / 2).alias("r"), ((c + 0.5) / 2).alias("c")), 1.0, F.lit(4.0))
    text = plan(got)
    assert "sr#" in text.split("keys=", 2)[2] and text.count("HashAggregate") >= 4
    assert got.first().pop == (8 * 8.0 + 8 * 16.0) / 16


def test_band_files_do_not_follow_the_runs(spark):
    path = scratch_path(spark, "bands")
    cells = spark.range(40 * 6).selectExpr(
        "cast(id % 40 as int) as run_id", "cast(id div 40 as int) as r", "0 as c", "id * 0.5d as max_depth", "id % 3 = 0 as initially_wet",
        "1d as arrival_min", "2 as band", "3d as max_speed", "4d as max_dv", "5d as rating", "1 as defra_class", "2 as aidr_class", "true as domain", "1 as valid")
    bands.write_bands(cells, path)
    back = spark.read.parquet(path)
    assert len(back.inputFiles()) <= 4 * len(bands.BANDS)  # four tasks; there was a file for every band of every run
    rows = lambda df: sorted(map(tuple, df.select("run_id", "r", "c", "band", "value").collect()))
    assert rows(back) == rows(bands.scenario_bands(cells))


def test_tile_kernels_take_arrays(spark):
    """A data frame for every small tile cost more than the tile's cells."""
    cells = full(spark).withColumn("down_r", F.when(F.col("r") < 5, F.col("r") + 1)).withColumn("down_c", F.when(F.col("r") < 5, F.col("c")))
    starts = spark.createDataFrame([(0, 7, 0, 2)], "run_id int, start_id int, r int, c int")
    trace = hydrology.trace_downstream(cells, starts, 2)
    assert "InPandas" not in plan(trace)
    assert sorted(map(tuple, trace.collect())) == [(0, 7, r, 2, r) for r in range(6)]
    halo = {"r": np.array([1, 1, 1, 3, 9]), "c": np.array([2, 3, 4, 1, 9]), "down_r": np.array([2, 2, 2, 3, np.nan]), "down_c": np.array([2, 2, 3, 2, np.nan])}
    at, src = hydrology._entries(halo, hydrology._ids(np.array([2, 2, 3, 3]), np.array([2, 3, 2, 3])), 2)
    wide = hydrology.WIDE
    assert list(zip(at.tolist(), src.tolist())) == [(0, wide + 2), (1, wide + 4), (2, 3 * wide + 1)]


def test_interpolation_sorts_probes_once(spark):
    """Least structs per bucket had all probes sorted before the shuffle, two windows and a join sorted them again."""
    points = spark.createDataFrame([(0, "a", 10.0, 1.0), (0, "a", 50.0, 5.0), (0, "a", 350.0, 8.0)], "run_id int, label string, t_s double, q double")
    probes = spark.createDataFrame([(0, "a", float(t)) for t in (0, 10, 30, 50, 60, 150, 200, 350, 400)], "run_id int, label string, t_s double")
    got = series.interpolate(points, probes, 100.0)
    assert not any(x in plan(got) for x in ("SortAggregate", "Join"))
    assert [x.q for x in got.orderBy("t_s").collect()] == pytest.approx([1, 1, 3, 5, 5.1, 6, 6.5, 8, 8])


def test_a_full_record_works_out_its_cells_once(spark, monkeypatch):
    calls, enriched = [], assessment.enriched
    monkeypatch.setattr(assessment, "enriched", lambda s, d: calls.append(d) or enriched(s, d))
    record = assessment._record(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1  # the parts worked them out seven times
    assert set(record.columns) == {"run_id", "headline", "grid", "run", "results", "provenance", "honesty"}
