import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from floodspark import fixed
from floodspark.operators import components as comp
from floodspark.operators import graph, rims
from floodspark.operators import hydrology as hyd
from floodspark.session import cut


def table(spark, *arrays, **named):
    """Cells of one or more runs; extra columns by name for a single run."""
    frames = []
    for k, z in enumerate(arrays):
        rr, cc = np.indices(z.shape)
        pdf = pd.DataFrame({"run_id": k, "r": rr.ravel(), "c": cc.ravel(), "z": z.ravel().astype(float)})
        for name, a in named.items():
            pdf[name] = a.ravel()
        frames.append(pdf)
    df = spark.createDataFrame(pd.concat(frames))
    return df.withColumn("run_id", F.col("run_id").cast("int")).withColumn(
        "r", F.col("r").cast("int")).withColumn("c", F.col("c").cast("int"))


def array(df, name, shape):
    pdf = df.select("r", "c", name).toPandas()
    out = np.full(shape, np.nan)
    out[pdf["r"], pdf["c"]] = pdf[name].astype(float)
    return out


def pitted(seed, ny=20, nx=20):
    rng = np.random.default_rng(seed)
    z = 3.0 * (nx - 1 - np.arange(nx))[None, :] + np.zeros((ny, 1))
    z += rng.integers(0, 12, (ny, nx))
    for _ in range(12):
        i, j = rng.integers(1, ny - 1), rng.integers(1, nx - 1)
        z[i:i + 3, j:j + 3] -= rng.integers(1, 30)
    z[8:14, 5:11] = 20.0
    return z


@pytest.mark.parametrize("tile", [5, 64])
def test_whole_flow_analysis_matches_plain_arrays(spark, tile):
    za, zb = pitted(1), pitted(2)
    out = hyd.analyse_flow(table(spark, za, zb), 30.0, 0.03, tile).cache()
    for run, z in enumerate((za, zb)):
        got = out.where(F.col("run_id") == run)
        filled = array(got, "filled", z.shape)
        assert (filled == brute.fill(z)).all()
        w = brute.epsilon_surface(z, fixed.FILL_EPS)
        assert np.abs(array(got, "zr", z.shape) - w).max() < 5e-5
        zr = array(got, "zr", z.shape)
        down = brute.d8(zr)
        acc = brute.accumulate(zr, down)
        assert (array(got, "acc", z.shape) == np.array([[acc[i, j] for j in range(20)] for i in range(20)])).all()
        stream = {k: acc[k] >= 0.03 * 1e6 / 900.0 for k in acc}
        hand = brute.hand(z, zr, down, stream)
        assert np.allclose(array(got, "hand", z.shape),
                           np.array([[hand[i, j] for j in range(20)] for i in range(20)]))
    checks = hyd.routing_checks(out).toPandas()
    assert (checks["interior_orphans"] == 0).all()
    assert (checks["outlet_total"] == checks["cells"]).all()
    assert (checks["lowered"] == 0).all()


def test_hand_on_a_valley_is_the_side_slope(spark):
    rr, cc = np.indices((30, 21))
    z = 1000.0 - 2.0 * rr + 5.0 * np.abs(cc - 10)
    out = hyd.analyse_flow(table(spark, z), 30.0, 0.03, 8)
    hand = array(out, "hand", z.shape)
    assert np.allclose(hand[20, 2:10], [5.0 * k for k in range(8, 0, -1)], atol=1e-6)
    assert (hand[15:-1, 10] == 0).all()


def test_trace_follows_the_valley_across_tiles(spark):
    rr, cc = np.indices((30, 21))
    z = 1000.0 - 2.0 * rr + 5.0 * np.abs(cc - 10)
    flow = hyd.flow_direction(table(spark, z), "z", 1.0)
    starts = spark.createDataFrame([(0, 7, 5, 3)], "run_id int, start_id int, r int, c int")
    got = hyd.path_distance(hyd.trace_downstream(flow, starts, 4), 10.0).orderBy("k").toPandas()
    down, at, path = brute.d8(z), (5, 3), []
    while at is not None:
        path.append(at)
        at = down[at]
    assert list(zip(got["r"], got["c"])) == path
    d = np.hypot(np.diff(got["r"]), np.diff(got["c"])).sum() * 10.0
    assert abs(got["dist_m"].iloc[-1] - d) < 1e-9


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [4, 64])
def test_components_match_flood_fill(spark, diagonal, tile):
    rng = np.random.default_rng(5)
    mask = rng.random((24, 31)) < 0.55
    df = table(spark, mask.astype(float), wet=mask)
    got = comp.components(df, "wet", diagonal, tile).toPandas()
    want = brute.label(mask, diagonal)
    wide = got["component"] // comp.WIDE * 31 + got["component"] % comp.WIDE
    assert len(got) == mask.sum()
    assert (want[got["r"], got["c"]] == wide.to_numpy()).all()


def test_snap_prefers_the_trunk_to_a_near_tributary(spark):
    area = np.ones((20, 20))
    area[:, 10], area[:, 6] = 100.0 + np.arange(20), 5.0
    flow = table(spark, np.zeros((20, 20)), area_km2=area)
    pts = spark.createDataFrame([(0, 1, 10, 5)], "run_id int, point_id int, r int, c int")
    row = hyd.snap_to_stream(pts, flow, 90.0, 5).first()
    assert (row["snap_r"], row["snap_c"], row["suspect"]) == (10, 10, False)
    near = hyd.snap_to_stream(pts, flow, 90.0, 3).first()
    assert near["snap_c"] == 6 and near["suspect"]


def lowest_passes(n, rows):
    level = {k: np.inf for k in range(n)} | {-1: -np.inf}
    for _ in range(n):
        for a, b, w in rows:
            level[a], level[b] = min(level[a], max(level[b], w)), min(level[b], max(level[a], w))
    return level


@pytest.mark.parametrize("seed", range(5))
def test_passes_keep_their_heights_when_nodes_go(seed):
    rng = np.random.default_rng(seed)
    n = 60
    rows = [(int(a), int(b), float(rng.integers(1, 40))) for a, b in rng.integers(0, n, (120, 2)) if a != b]
    rows += [(int(k), -1, float(rng.integers(10, 50))) for k in rng.integers(0, n, 3)]
    a, b, w = (np.array(x) for x in zip(*rows))
    level = lowest_passes(n, rows)
    nodes, got = rims.drained(a, b, w)
    assert all(level[int(k)] == x for k, x in zip(nodes, got) if k >= 0)
    keep = np.unique(rng.integers(0, n, 20))
    fewer = rims.joined_passes(a, b, w, np.append(keep, -1))
    assert len(fewer) <= len(keep) and {x for e in fewer for x in e[:2]} <= set(keep.tolist()) | {-1}
    assert {k: x for k, x in lowest_passes(n, fewer).items() if k in keep} == {k: level[k] for k in keep.tolist()}


def test_graph_solvers_match_plain_loops(spark):
    rng = np.random.default_rng(3)
    n = 60
    rows = [(0, int(a), int(b)) for a, b in rng.integers(0, n, (150, 2)) if a != b]
    edges = spark.createDataFrame(rows, "run_id int, a long, b long")
    parent = {k: (k * 7 + 3) % k if k else None for k in range(n)}
    tree = spark.createDataFrame([(0, k, p, float(k)) for k, p in parent.items()], "run_id int, a long, p long, v double")

    sums = {k: float(k) for k in range(n)}
    for k in range(n):
        up = parent[k]
        while up is not None:
            sums[up], up = sums[up] + k, parent[up]
    assert {r["a"]: r["v"] for r in graph.forest_sums(tree).collect()} == sums

    root = {k: k for k in range(n)}
    links = [(a, b) for _, a, b in rows if a % 4 == b % 4]
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.connected(edges.where("a % 4 = b % 4")).collect()}
    assert got == {k: root[k] for k in {x for link in links for x in link}}
    got = graph.resolve_roots(tree.select("run_id", "a", F.coalesce("p", "a").alias("p"))).collect()
    assert {r["a"]: r["root"] for r in got} == {k: 0 for k in range(n)}


def test_levels_of_united_tiles_change_nothing(spark, monkeypatch):
    """Small tiles and few to a level: several levels up and down."""
    monkeypatch.setattr(rims, "FAN", 2)
    z = pitted(6, 15, 18)
    z[3:12, 4:14] = 15.0
    out = cut(hyd.analyse_flow(table(spark, z), 30.0, 0.03, 4))
    assert (array(out, "filled", z.shape) == brute.fill(z)).all()
    zr = array(out, "zr", z.shape)
    down = brute.d8(zr)
    acc = brute.accumulate(zr, down)
    assert all(array(out, "acc", z.shape)[k] == acc[k] for k in acc)
    stream = {k: acc[k] >= 0.03 * 1e6 / 900.0 for k in acc}
    hand = brute.hand(z, zr, down, stream)
    assert all(abs(array(out, "hand", z.shape)[k] - hand[k]) < 1e-9 for k in hand)
    mask = z < 40
    lab = comp.components(table(spark, z, wet=mask), "wet", False, 4).toPandas()
    want = brute.label(mask, False)
    assert (want[lab["r"], lab["c"]] == (lab["component"] // comp.WIDE * 18 + lab["component"] % comp.WIDE)).all()
    starts = [(0, k, int(r), int(c)) for k, (r, c) in enumerate(np.random.default_rng(1).integers(1, 14, (12, 2)))] + [(0, 99, 500, 500)]
    got = hyd.trace_downstream(out, spark.createDataFrame(starts, "run_id int, start_id int, r int, c int"), 4).toPandas()
    for _, k, r, c in starts[:-1]:
        path, at = [], (r, c)
        while at is not None:
            path.append(at)
            at = down[at]
        mine = got[got["start_id"] == k].sort_values("k")
        assert list(zip(mine["r"], mine["c"])) == path and mine["k"].tolist() == list(range(len(path)))
    assert not (got["start_id"] == 99).any()


def test_a_lake_over_many_tiles_has_one_outlet(spark):
    """Steps run round walls through thirty tiles; only tiles that hear something new are settled again."""
    z = np.full((24, 60), 50.0)
    z[0], z[-1], z[:, 0], z[:, -1] = 90.0, 90.0, 90.0, 90.0
    for k in range(6, 55, 8):
        z[slice(1, 20) if k % 16 == 6 else slice(4, 23), k] = 80.0
    z[22, 0] = 40.0
    df = table(spark, z)
    out = hyd.routing_surface(hyd.fill_depressions(df, 8), 1.0, 8)
    filled = brute.fill(z)
    flat_steps = array(out, "zr", z.shape) - filled
    big = array(hyd.routing_surface(hyd.fill_depressions(df, 64), 1.0, 64), "zr", z.shape) - filled
    assert (flat_steps == big).all() and flat_steps.max() > 60


def test_steps_are_fewest():
    rng = np.random.default_rng(8)
    for _ in range(30):
        w = rng.integers(0, 2, (9, 11)).astype(float)
        core = np.zeros(w.shape, bool)
        core[1:-1, 1:-1] = True
        d = np.where(rng.random(w.shape) < 0.08, rng.integers(0, 9, w.shape), np.nan)
        d[0], d[-1], d[:, 0], d[:, -1] = np.nan, np.nan, np.nan, np.nan
        want = np.where(np.isnan(d), np.inf, d)
        for _ in range(100):
            for i in range(1, 8):
                for j in range(1, 10):
                    for di, dj in brute.RING:
                        if w[i, j] == w[i + di, j + dj]:
                            want[i, j] = min(want[i, j], want[i + di, j + dj] + 1)
        got = hyd._steps(w, d, core)
        assert (np.where(np.isnan(got), np.inf, got) == want).all()


def test_profile_drop_and_confluences(spark):
    rr, cc = np.indices((60, 21))
    z = 1000.0 - 2.0 * rr + 5.0 * np.abs(cc - 10)
    df = table(spark, z, area_km2=np.where(rr >= 30, 10.0, 1.0) + rr / 100.0)
    flow = hyd.flow_direction(df, "z", 10.0)
    starts = spark.createDataFrame([(0, 7, 2, 10), (0, 8, 59, 0)], "run_id int, start_id int, r int, c int")
    trace = hyd.trace_downstream(flow, starts, 16).cache()
    drop = {x.start_id: x for x in hyd.bed_drop(hyd.trace_profile(trace, flow, 10.0, "z")).collect()}
    assert (drop[7].steps, drop[7].length_m, drop[7].drop_m) == (58, 570.0, 114.0) and abs(drop[7].drop_per_km - 200.0) < 1e-9
    assert (drop[8].steps, drop[8].drop_m, drop[8].drop_per_km) == (1, 0.0, 0.0)
    found = hyd.confluences(trace, df).collect()
    assert [(x.start_id, x.k) for x in found] == [(7, 28)]  # 58 // 20 = 2: every second step


def test_empty_grid_gives_empty_results(spark):
    none = table(spark, np.zeros((2, 2))).limit(0)
    assert hyd.analyse_flow(none, 30.0, 0.03, 8).count() == 0
