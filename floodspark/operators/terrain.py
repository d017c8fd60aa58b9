"""Conditioning and local shape of terrain grids."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.operators import components as comp
from floodspark.operators import quantiles
from floodspark.operators.hydrology import fill_depressions
from floodspark.session import cut


def nearest_seed(cells: DataFrame, seed: str, dense: bool = True) -> DataFrame:
    """Adds ``d2, seed_r, seed_c``: the nearest cell where ``seed`` holds (Euclidean).

    Separable and exact: along each column the nearest seed comes from two window
    passes; along each row the lowest of the columns' parabolas is then nearest, in time
    linear in the width.  Groups are one column, or 64 rows, of one grid.  Ties go to the smaller row, then column.
    A grid with missing cells (``dense`` false) is completed for the two passes.
    """
    run = cells.schema["run_id"].dataType.simpleString()
    w = grid.col_window()
    inf, end = Window.unboundedPreceding, Window.unboundedFollowing
    at = F.when(F.col(seed), F.col("r"))
    up, dn = F.last(at, True).over(w.rowsBetween(inf, 0)), F.first(at, True).over(
        w.rowsBetween(0, end))
    body = cells.select(*grid.CELL, F.col(seed))
    if not dense:
        body = grid.lattice(grid.grid_sizes(cells)).join(body, grid.CELL, "left")
    col = (body.withColumn("_u", up).withColumn("_d", dn)
                .withColumn("near", F.when(F.col("_d").isNull() | (
                    F.col("r") - F.col("_u") <= F.col("_d") - F.col("r")), F.col("_u"))
                    .otherwise(F.col("_d"))).select(*grid.CELL, "near"))

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        rr, cc = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        n = int(cc.max()) + 1
        src = np.full((int(rr.max()) + 1, n), -1, dtype=np.int64)
        has = pdf["near"].notna().to_numpy()
        src[rr[has], cc[has]] = pdf["near"].to_numpy()[has].astype(np.int64)
        best, br, bc = (np.full(src.shape, -1, dtype=np.int64) for _ in range(3))
        for i in range(len(src)):
            at = np.flatnonzero(src[i] >= 0)
            if len(at):
                q = at[_lowest((src[i, at] - (r0 + i)) ** 2, at, src[i, at], n)]
                br[i], bc[i] = src[i, q], q
                best[i] = (src[i, q] - (r0 + i)) ** 2 + (q - np.arange(n)) ** 2
        ok = best[rr, cc] >= 0

        def column(a):
            out = pd.array(a[rr, cc], dtype="Int64")
            out[~ok] = pd.NA
            return out

        return pd.DataFrame({"run_id": pdf["run_id"], "r": pdf["r"], "c": pdf["c"],
                             "d2": column(best), "seed_r": column(br), "seed_c": column(bc + c0)})

    block = F.floor(F.col("r") / 64).cast("int").alias("block")
    got = col.groupBy("run_id", block).applyInPandas(
        across, f"run_id {run}, r int, c int, d2 long, seed_r int, seed_c int")
    return cells.join(got, grid.CELL)


def _lowest(height: np.ndarray, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For columns 0 to ``n`` (excluded) the index of the lowest parabola ``height[k] + (c - at[k]) ** 2``.

    Ties go to the smaller ``row[k]``, then ``k``: parabolas that touch the lower envelope in one point stay on it.
    """
    h, x = height.tolist(), at.tolist()
    kept: list[int] = []
    left: list[float] = []
    for k in range(len(x)):
        cross = float("-inf")
        while kept:
            j = kept[-1]
            cross = (h[k] + x[k] * x[k] - h[j] - x[j] * x[j]) / (2 * (x[k] - x[j]))
            if cross < left[-1]:
                kept.pop()
                left.pop()
            else:
                break
        kept.append(k)
        left.append(cross if len(kept) > 1 else float("-inf"))
    out, k = np.empty(n, dtype=np.int64), 0
    for c in range(n):
        while k + 1 < len(kept) and left[k + 1] < c:
            k += 1
        j = kept[k]
        m = k
        while m + 1 < len(kept) and left[m + 1] <= c:  # those that meet just here
            m += 1
            i = kept[m]
            if (h[i] + (c - x[i]) ** 2, row[i], i) < (h[j] + (c - x[j]) ** 2, row[j], j):
                j = i
        out[c] = j
    return out


def fill_voids(cells: DataFrame) -> DataFrame:
    """Voids (``valid`` false) take the elevation of the nearest valid cell."""
    near = nearest_seed(cells.select(*grid.CELL, "valid"), "valid").where(~F.col("valid")).select(
        *grid.CELL, "seed_r", "seed_c")
    src = cells.select("run_id", F.col("r").alias("seed_r"), F.col("c").alias("seed_c"), F.col("z").alias("zs"))
    got = near.join(src, ["run_id", "seed_r", "seed_c"], "left").select(*grid.CELL, "zs")
    return cells.join(got, grid.CELL, "left").withColumn(
        "z", F.when(F.col("valid"), F.col("z")).otherwise(F.col("zs"))).drop("zs")


def coarsen(cells: DataFrame, sizes: DataFrame, f: int, wall: float = fixed.OUTSIDE_BED_M) -> DataFrame:
    """Block means over valid cells; leftover edge cells are cropped, empty blocks become walls."""
    kept = cells.join(sizes, "run_id").where(
        (F.col("r") < F.floor(F.col("ny") / f) * f) & (F.col("c") < F.floor(F.col("nx") / f) * f))
    out = kept.groupBy("run_id", F.floor(F.col("r") / f).cast("int").alias("r"),
                       F.floor(F.col("c") / f).cast("int").alias("c")).agg(
        F.avg(F.when(F.col("valid"), F.col("z"))).alias("z"))
    return out.select(*grid.CELL, F.coalesce("z", F.lit(wall)).alias("z"), F.col("z").isNotNull().alias("valid"))


def capped_fill(cells: DataFrame, max_fill: float | None, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Fill depressions, all or nothing: one too deep anywhere is left alone entirely."""
    filled = cut(fill_depressions(cells.select(*grid.CELL, "z"), tile), "filled")
    if max_fill is None:
        return filled.withColumn("depth", F.col("filled") - F.col("z"))
    low = filled.withColumn("low", F.col("filled") > F.col("z"))
    lab = comp.components(low, "low", False, tile)
    deep = (lab.join(filled, grid.CELL).groupBy("run_id", "component")
               .agg(F.bool_or(F.col("filled") - F.col("z") > max_fill).alias("deep")))
    keep = comp.attach(lab, deep.where("deep")).select(*grid.CELL, "deep")
    return (filled.join(keep, grid.CELL, "left")
                  .withColumn("filled", F.when(F.col("deep"), F.col("z")).otherwise(F.col("filled")))
                  .drop("deep").withColumn("depth", F.col("filled") - F.col("z")))


def fill_report(filled: DataFrame, dx: float) -> DataFrame:
    return filled.groupBy("run_id").agg(
        F.count_if(F.col("depth") > 0).alias("cells_filled"), F.max("depth").alias("max_depth"),
        (F.sum("depth") * dx * dx).alias("storage_removed_m3"))


def gradient(value: str, dx: float, window, axis: str, size: Column) -> Column:
    """Central difference, one-sided at an edge of the grid, NULL if a needed neighbour is missing."""
    v = F.col(value)
    prev, nxt = grid.beside(value, window, -1, axis), grid.beside(value, window, 1, axis)
    return (F.when(F.col(axis) == 0, (nxt - v) / dx).when(F.col(axis) == size - 1, (v - prev) / dx)
             .otherwise((nxt - prev) / (2.0 * dx)))


def front_speed(cells: DataFrame, sizes: DataFrame, dx: float) -> DataFrame:
    """Adds ``front_speed``: reciprocal of the arrival gradient, NULL where it vanishes."""
    g = cells.join(sizes.select("run_id", "ny", "nx"), "run_id")
    g = (g.withColumn("_gx", gradient("arrival_s", dx, grid.row_window(), "c", F.col("nx")))
          .withColumn("_gy", gradient("arrival_s", dx, grid.col_window(), "r", F.col("ny"))))
    mag = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    known = F.col("arrival_s").isNotNull() & (mag > 0)
    return g.withColumn("front_speed", F.when(known, 1.0 / mag)).drop("_gx", "_gy", "ny", "nx")


def slope_degrees(cells: DataFrame, dx: float) -> DataFrame:
    """Adds ``slope_deg`` from 4-connected differences; NULL where a neighbour is missing."""
    n = grid.neighbours4(cells, "z")
    gx, gy = (F.col("e_") - F.col("w_")) / (2.0 * dx), (F.col("s_") - F.col("n_")) / (2.0 * dx)
    return n.withColumn("slope_deg", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))).drop("w_", "e_", "n_", "s_")


def focal_median(cells: DataFrame, value: str, radius_cells: float, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Adds ``focal``: median over a circular window, missing cells ignored.

    Tiles with a halo: the window reaches into neighbours without an exploded copy
    per offset.
    """
    run = cells.schema["run_id"].dataType.simpleString()
    offs, k = grid.disc(radius_cells), int(radius_cells)

    def medians(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["core"]]
        r0, c0 = int(pdf["r"].min()) - k, int(pdf["c"].min()) - k
        a = np.full((int(pdf["r"].max()) - r0 + k + 1, int(pdf["c"].max()) - c0 + k + 1), np.nan)
        a[pdf["r"] - r0, pdf["c"] - c0] = pdf[value].astype(float)
        rr, cc = own["r"].to_numpy() - r0, own["c"].to_numpy() - c0
        stack = np.sort(np.vstack([a[rr + dr, cc + dc] for dr, dc in offs]), axis=0)
        n = np.sum(~np.isnan(stack), axis=0)
        cols = np.arange(len(rr))
        med = (stack[np.maximum((n - 1) // 2, 0), cols] + stack[np.maximum(n // 2, 0), cols]) / 2
        return pd.DataFrame({"run_id": own["run_id"], "r": own["r"], "c": own["c"], "focal": med})

    got = grid.with_halo(cells.select(*grid.CELL, value), tile, k).groupBy("run_id", "tr", "tc").applyInPandas(
        medians, f"run_id {run}, r int, c int, focal double")
    return cells.join(got.withColumn("focal", F.nanvl("focal", F.lit(None).cast("double"))), grid.CELL)


def confined(wet_cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``confined``: a wet cell with a dry cell among its eight neighbours.

    The same as a Euclidean distance below 1.5 cells to the nearest dry cell.  A cell of the grid that has no row is
    dry; the outside of the grid is not.
    """
    nb = grid.neighbours8(wet_cells.withColumn("_one", F.lit(1)), "_one").join(sizes.select("run_id", "ny", "nx"), "run_id")
    dry = F.lit(False)
    for k, (dr, dc) in enumerate(grid.RING8):
        r, c = F.col("r") + dr, F.col("c") + dc
        here = (r >= 0) & (r < F.col("ny")) & (c >= 0) & (c < F.col("nx"))
        dry = dry | (here & F.get("nb", F.lit(k)).isNull())
    return nb.withColumn("confined", dry).drop("nb", "_one", "ny", "nx")


def half_widths(wet_cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``half_width`` to wet cells: the Euclidean distance to the nearest dry cell of the grid, in cells.

    Cells without a row are dry, the outside is not; NULL where a run has no dry cell.
    """
    wet = wet_cells.select(*grid.CELL, F.lit(False).alias("dry"))
    full = grid.lattice(sizes).join(wet.hint("merge"), grid.CELL, "left").withColumn("dry", F.coalesce("dry", F.lit(True)))
    away = nearest_seed(full, "dry").where("NOT dry").select(*grid.CELL, F.sqrt("d2").alias("half_width"))
    return wet_cells.join(away.hint("merge"), grid.CELL, "left")


def width_bins(wet_cells: DataFrame, sizes: DataFrame, dx: float, value: str = "max_depth",
               least: tuple[float, ...] = (0.0, 1.0, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """``run_id, half_width, peak, median, cells, km2`` of the wet cells at least so wide; empty bins have no row."""
    wide = half_widths(wet_cells.select(*grid.CELL, value), sizes).withColumnRenamed("half_width", "_w")
    bins = wide.withColumn("half_width", F.explode(F.array(*[F.lit(w) for w in least]))).where(F.col("_w") >= F.col("half_width"))
    keys = ["run_id", "half_width"]
    middle = quantiles.exact_quantiles(bins, keys, value, [0.5]).select(*keys, F.col("value").alias("median"))
    return bins.groupBy(*keys).agg(F.max(value).alias("peak"), F.count("*").alias("cells"),
                                   (F.count("*") * dx * dx / 1e6).alias("km2")).join(middle, keys)


def flat_cells(cells: DataFrame, tol: float = 0.01) -> DataFrame:
    """Adds ``flat``: equal to all four neighbours within ``tol``."""
    n = grid.neighbours4(cells, "z")
    ok = F.lit(True)
    for s in ("w_", "e_", "n_", "s_"):
        ok = ok & F.coalesce(F.abs(F.col("z") - F.col(s)) <= tol, F.lit(False))
    return n.withColumn("flat", ok).drop("w_", "e_", "n_", "s_")


def detect_pools(cells: DataFrame, sizes: DataFrame, dams: DataFrame, dx: float, search: int = 30,
                 flat_tol: float = 0.01, min_flat: int = 25, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """The reservoir of each run: cells with ``level``, found from the largest near flat.

    ``dams`` is ``(run_id, r, c, published_m2)``.  A run without a large enough flat
    has no pool and no rows.
    """
    flats = cut(comp.components(flat_cells(cells.select(*grid.CELL, "z"), flat_tol), "flat", False, tile), "pool")
    d = dams.select("run_id", F.col("r").alias("dr_"), F.col("c").alias("dc_"))
    near = flats.join(d, "run_id").where((F.abs(F.col("r") - F.col("dr_")) <= search)
                                         & (F.abs(F.col("c") - F.col("dc_")) <= search))
    near = near.select("run_id", "component").distinct()
    best = (comp.component_sizes(flats).join(near, ["run_id", "component"]).groupBy("run_id")
                .agg(F.max(F.struct("size", (-F.col("component")).alias("nc"))).alias("m"))
                .where(F.col("m.size") >= min_flat)
                .select("run_id", (-F.col("m.nc")).alias("component")))
    seed = flats.join(best, ["run_id", "component"], "left_semi").join(cells.select(*grid.CELL, "z"), grid.CELL)
    level = quantiles.exact_quantiles(seed, ["run_id"], "z", [0.5]).select("run_id", F.col("value").alias("level"))
    below = cells.join(level, "run_id").withColumn("low", F.col("z") <= F.col("level") + 1e-6)
    lab = cut(comp.components(below, "low", False, tile), "pool")
    # the flat's first cell is its component id; if it lies above the level the flat itself is the pool
    first = best.select("run_id", F.col("component").alias("seed_id"))
    home = lab.withColumn("seed_id", comp.cell_id()).join(first, ["run_id", "seed_id"]).select(
        "run_id", F.col("component"))
    filled = lab.join(home, ["run_id", "component"], "left_semi").select(*grid.CELL)
    alone = seed.join(home.select("run_id"), "run_id", "left_anti").select(*grid.CELL)
    return filled.unionByName(alone).join(level, "run_id")


def pool_report(pool: DataFrame, sizes: DataFrame, dams: DataFrame, dx: float) -> DataFrame:
    p = pool.join(sizes, "run_id").groupBy("run_id").agg(
        F.max("level").alias("level_m"), (F.count("*") * dx * dx / 1e6).alias("area_km2"),
        F.bool_or(F.col("r") == 0).alias("touches_j0"),
        F.bool_or(F.col("r") == F.col("ny") - 1).alias("touches_jmax"),
        F.bool_or(F.col("c") == 0).alias("touches_i0"),
        F.bool_or(F.col("c") == F.col("nx") - 1).alias("touches_imax"))
    return p.join(dams.select("run_id", "published_m2"), "run_id", "left").withColumn(
        "suspect", F.coalesce(F.col("area_km2") > F.col("published_m2") / 1e6 * 1.05, F.lit(False)))


def valley_width(cells: DataFrame, points: DataFrame, dx: float, relief: float = 25.0, half: int = 40) -> DataFrame:
    """Floor width of the valley on the east-west transect through each point.

    The transect is at most ``2*half+1`` cells: it is gathered as one array per point
    and the contiguous floor around its first minimum is read off it.
    """
    p = points.select("run_id", "point_id", "r", F.col("c").alias("pc"))
    step = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    near = p.withColumn("_d", step).withColumn("c", F.col("pc") + F.col("_d")).join(cells.select(*grid.CELL, "z"), grid.CELL)
    line = near.groupBy("run_id", "point_id").agg(F.array_sort(F.collect_list(F.struct("c", "z"))).alias("t"))
    return contiguous_floor(line.select("run_id", "point_id", F.col("t.z").alias("zs")), relief, dx)


def contiguous_floor(lines: DataFrame, relief: float, dx: float) -> DataFrame:
    """Adds ``width_m`` for each array ``zs``; NULL on short lines or a minimum at an end."""
    z, n = F.col("zs"), F.size("zs")
    low = F.array_min(z)
    k = F.array_position(z, low).cast("int")
    high = F.transform(z, lambda v, i: F.when(v >= low + relief, i + 1))
    left = F.coalesce(F.array_max(F.filter(high, lambda i: i < k)), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(high, lambda i: i > k)), n + 1)
    ok = (n >= 5) & (k > 1) & (k < n)
    return lines.withColumn("width_m", F.when(ok, (right - left - 1) * dx)).drop("zs")


def terrain_summary(cells: DataFrame, dx: float) -> DataFrame:
    void = F.count_if(~F.col("valid"))
    return cells.groupBy("run_id").agg(
        (F.max("r") + 1).alias("ny"), (F.max("c") + 1).alias("nx"),
        F.min(F.when(F.col("valid"), F.col("z"))).alias("z_min"),
        F.max(F.when(F.col("valid"), F.col("z"))).alias("z_max"),
        void.alias("voids"), (100.0 * void / F.count("*")).alias("void_pct"))


def hydrology_summary(flow: DataFrame) -> DataFrame:
    n = F.count("*")
    below = [(100.0 * F.count_if(F.col("hand") <= t) / n).alias(f"hand_le_{t}_pct") for t in (50, 100, 150, 300)]
    return flow.groupBy("run_id").agg(
        F.count_if("stream").alias("stream_cells"), (100.0 * F.count_if("stream") / n).alias("stream_pct"),
        F.max("area_km2").alias("max_km2"), F.min("hand").alias("hand_min"), F.max("hand").alias("hand_max"),
        F.count_if(F.col("hand") < -1e-6).alias("negative_hand"), *below)


def hypsometry(cells: DataFrame, levels: list[float], dx: float) -> DataFrame:
    """Stored volume and wet cells per level; a short fixed list of levels per cell."""
    lv = F.explode(F.array(*[F.lit(float(v)) for v in levels]))
    return cells.withColumn("level", lv).groupBy("run_id", "level").agg(
        (F.sum(F.greatest(F.col("level") - F.col("z"), F.lit(0.0))) * dx * dx).alias("volume_m3"),
        F.count_if(F.col("z") < F.col("level")).alias("wet_cells"))


def suppressed_peaks(flow: DataFrame, column: str, apart: int = 15, keep: int = 8) -> DataFrame:
    """Largest cells per run, each at least ``apart`` cells from those before it.

    Every peak is a maximum over all cells still clear: ``keep`` partial aggregates, no list of candidates.
    """
    clear = cut(flow.select(*grid.CELL, F.col(column).alias("v")), "peaks")
    found = []
    for _ in range(keep):
        best = clear.groupBy("run_id").agg(F.min(F.struct((-F.col("v")).alias("v"), "r", "c")).alias("b")).select(
            "run_id", F.col("b.r").alias("r"), F.col("b.c").alias("c"), (-F.col("b.v")).alias("v"))
        best = cut(best, "peaks")  # a row per run
        found.append(best)
        near = best.select("run_id", F.col("r").alias("_r"), F.col("c").alias("_c"))
        clear = clear.join(near, "run_id").where(
            (F.abs(F.col("r") - F.col("_r")) >= apart) | (F.abs(F.col("c") - F.col("_c")) >= apart)).drop("_r", "_c")
    return reduce(DataFrame.unionByName, found)
