"""Depression filling, flow direction, accumulation, HAND, traces and snapping.

The grid is cut into tiles.  A small per-tile kernel reduces each tile to what its
rim needs to know; tiles are united level by level (``rims``); a second kernel pass
writes the cells.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark import fixed, grid
from floodspark.operators.components import cell_id
from floodspark.operators.rims import (ENTRY, EXIT, OCEAN, WIDE, down_depth, down_sums, far_values, inflows, joined_passes,
                                       last_of, spill_levels)
from floodspark.session import cut

RING = grid.RING8
TILE_KEY = ["run_id", "tr", "tc"]


def _run_type(df: DataFrame) -> str:
    return df.schema["run_id"].dataType.simpleString()


# Tiles are many and small: their kernels work on plain arrays, as a data frame costs more than its cells.
Cells = dict[str, np.ndarray]


def _arrays(rows: pa.Table, *names: str) -> Cells:
    """Columns as arrays; NULL among numbers is NaN."""
    return {n: rows.column(n).to_numpy() for n in names or rows.column_names}


def _where(cells: Cells, mask: np.ndarray) -> Cells:
    return {n: a[mask] for n, a in cells.items()}


def _rows(key: tuple, schema: str, *columns) -> pa.Table:
    """A tile's result: the run of ``key``, then ``columns`` with the names and types of ``schema``."""
    names = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    n = next(len(c) for c in columns if isinstance(c, np.ndarray))
    arrays = [pa.array(np.broadcast_to(c, n), kinds[kind], from_pandas=True, safe=False) for c, (_, kind) in zip(columns, names)]
    return pa.table([pa.repeat(key[0], n), *arrays], names=["run_id", *[name for name, _ in names]])


def _block(cells: Cells, names: list[str], pad: int = 1):
    """Dense arrays of one tile with a frame of missing cells around it."""
    r0, c0 = int(cells["r"].min()) - pad, int(cells["c"].min()) - pad
    rr, cc = cells["r"] - r0, cells["c"] - c0
    shape = (rr.max() + 1 + pad, cc.max() + 1 + pad)
    out = {}
    for name in names:
        a = np.full(shape, np.nan)
        a[rr, cc] = cells[name]
        out[name] = a
    core = np.zeros(shape, dtype=bool)
    core[rr, cc] = cells["core"]
    return r0, c0, core, out


def _flood(key: np.ndarray, z: np.ndarray, core: np.ndarray):
    """Raise ``core`` cells, none of them on the frame, to the lowest level a seed (finite ``key``) reaches them at."""
    seeded = np.isfinite(key)
    level = np.where(seeded, key, np.inf).ravel().tolist()
    label = np.where(seeded, np.arange(key.size).reshape(key.shape), -1).ravel().tolist()
    heights, left = z.ravel().tolist(), core.ravel().tolist()
    around = [di * z.shape[1] + dj for di, dj in RING]
    heap = [(level[at], at) for at in np.flatnonzero(seeded).tolist()]
    heapq.heapify(heap)
    closed = [False] * key.size
    while heap:
        w, at = heapq.heappop(heap)
        if closed[at]:
            continue
        closed[at], left[at] = True, False
        for step in around:
            near = at + step
            if left[near]:
                up = heights[near]
                if up < w:
                    up = w
                if up < level[near]:
                    level[near], label[near] = up, label[at]
                    heapq.heappush(heap, (up, near))
    return np.array(level).reshape(z.shape), np.array(label, dtype=np.int64).reshape(z.shape)


def _seeds(z: np.ndarray, core: np.ndarray):
    """Core cells with a neighbour outside the tile, and those beside a missing cell."""
    rim, open_ = np.zeros(core.shape, dtype=bool), np.zeros(core.shape, dtype=bool)
    for di, dj in RING:
        rim |= ~np.roll(core, (-di, -dj), (0, 1))
        open_ |= np.isnan(np.roll(z, (-di, -dj), (0, 1)))
    return core & rim, core & open_


def fill_depressions(cells: DataFrame, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Adds ``filled``: the lowest level at which each cell drains off the grid.

    Cells next to a missing cell or the border of the grid drain outside.  The level
    is exact and does not depend on the tile size.
    """
    run = _run_type(cells)
    solid = F.coalesce("z", F.raise_error(F.lit("fill_depressions needs a grid without voids; fill them first")).cast("double"))
    cells = cells.withColumn("z", solid)
    haloed = grid.with_halo(cells.select(*grid.CELL, "z"), tile, 1)

    edge = "tr int, tc int, a long, b long, w double"

    def passes(key: tuple, rows: pa.Table) -> pa.Table:
        r0, c0, core, got = _block(_arrays(rows, "r", "c", "z", "core"), ["z"])
        z = got["z"]
        if not core.any():
            return _rows(key, edge, *[np.zeros(0)] * 5)
        rim, open_ = _seeds(z, core)
        level, label = _flood(np.where(rim, z, np.nan), z, core)
        nx = z.shape[1]

        def ident(flat):
            return (flat // nx + r0) * WIDE + flat % nx + c0

        beyond, inner = [], []
        here = np.arange(z.size, dtype=np.int64).reshape(z.shape)
        for di, dj in RING:
            other = np.roll(z, (-di, -dj), (0, 1))
            across = rim & ~np.roll(core, (-di, -dj), (0, 1)) & ~np.isnan(other)
            beyond.append((ident(here[across]), ident((here + di * nx + dj)[across]), np.maximum(z, other)[across]))
            lab, lev = np.roll(label, (-di, -dj), (0, 1)), np.roll(level, (-di, -dj), (0, 1))
            meet = core & np.roll(core, (-di, -dj), (0, 1)) & (lab > label)
            inner.append((ident(label[meet]), ident(lab[meet]), np.maximum(level, lev)[meet]))
        inner.append((ident(here[open_]), np.full(int(open_.sum()), OCEAN), z[open_]))
        a, b, w = (np.concatenate([p[k] for p in inner]) for k in range(3))
        tree = joined_passes(a, b, w, np.concatenate([a, b]))
        tree = [(y, x, h) if x == OCEAN else (x, y, h) for x, y, h in tree]
        a, b, w = (np.concatenate([p[k] for p in beyond] + [np.array([e[k] for e in tree], dtype)])
                   for k, dtype in enumerate((np.int64, np.int64, float)))
        return _rows(key, edge, key[1].as_py(), key[2].as_py(), a, b, w)

    edges = haloed.groupBy(TILE_KEY).applyInArrow(passes, f"run_id {run}, {edge}")
    levels = spill_levels(edges, tile, run)

    def raise_tile(cells_: pa.Table, known: pa.Table) -> pa.Table:
        if not len(cells_):
            return cells_.drop_columns(["tr", "tc"]).append_column("filled", pa.array([], pa.float64()))
        own = _arrays(cells_, "r", "c", "z")
        r0, c0, core, got = _block(own | {"core": np.ones(len(cells_), dtype=bool)}, ["z"])
        at = known.column("node").to_numpy()
        key = np.full(core.shape, np.nan)
        key[at // WIDE - r0, at % WIDE - c0] = known.column("level").to_numpy()
        level, _ = _flood(np.maximum(key, got["z"]), got["z"], core)
        rr, cc = own["r"] - r0, own["c"] - c0
        return cells_.drop_columns(["tr", "tc"]).append_column("filled", pa.array(level[rr, cc]))

    kept = cells.select(*grid.CELL, "z", *[c for c in cells.columns if c not in (*grid.CELL, "z")])
    return grid.with_tile(kept, tile).groupBy(TILE_KEY).cogroup(levels.groupBy(TILE_KEY)).applyInArrow(
        raise_tile, _with_column(kept, "filled double"))


def _with_column(df: DataFrame, extra: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {extra}"


def _any_null(nb: str) -> Column:
    return F.exists(F.col(nb), lambda v: v.isNull())


def _steps(w: np.ndarray, d: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Fewest steps to each ``core`` cell over equal ``w`` from the cells with a ``d``, which count from it.

    A frontier of one distance moves at a time, so a cell is visited once.
    """
    nx = w.shape[1]
    around = np.array([di * nx + dj for di, dj in RING])
    w, core = w.ravel(), core.ravel()
    dist = np.where(np.isnan(d), np.inf, d).ravel()
    seeds = np.flatnonzero(np.isfinite(dist))
    seeds = seeds[np.argsort(dist[seeds], kind="stable")]
    starts = dist[seeds]
    at, front, x = 0, np.zeros(0, np.int64), 0.0
    while len(front) or at < len(seeds):
        if not len(front):
            x = starts[at]
        to = int(np.searchsorted(starts, x, side="right"))
        fresh = seeds[at:to]
        at = to
        front = np.unique(np.concatenate([front, fresh[dist[fresh] == x]]))
        near = (front[:, None] + around).ravel()
        ok = core[near] & (w[near] == np.repeat(w[front], len(around))) & (dist[near] > x + 1)
        front = np.unique(near[ok])
        x += 1
        dist[front] = x
    return np.where(np.isfinite(dist), dist, np.nan).reshape(d.shape)


def routing_surface(filled: DataFrame, eps: float = fixed.FILL_EPS,
                    tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Adds ``zr``: the filled level plus ``eps`` per step away from a flat's outlet.

    Only cells of flats take part.  Every tile is settled by itself first; then only tiles that a neighbour's rim has
    brought something nearer are settled again, and tell their neighbours what moved on their own rims.  The cells of
    tiles that were reached are written once, at the end.
    """
    run = _run_type(filled)
    nb = grid.neighbours8(filled, "filled")
    flat = ~_any_null("nb") & ~F.exists(F.col("nb"), lambda v: v < F.col("filled"))
    marked = cut(nb.withColumn("flat", flat).drop("nb"), "flats")
    level = marked.select(*grid.CELL, F.col("filled").alias("w"), "flat")
    shore = (grid.spread(level.where("flat").select(*grid.CELL, "w"), RING)
                 .select(*grid.CELL, "w").distinct()
                 .join(level.where(~F.col("flat")), [*grid.CELL, "w"], "left_semi")
                 .select(*grid.CELL, "w", F.lit(0.0).alias("d")))
    work = level.where("flat").select(*grid.CELL, "w", F.lit(None).cast("double").alias("d")).unionByName(shore)
    # what a tile always knows: its own cells, and the shore around them
    known = cut(grid.with_halo(work, tile, 1).where("core OR d IS NOT NULL"), "flats")
    if known.isEmpty():
        return marked.withColumn("zr", F.col("filled")).drop("flat")

    def settle(told: Cells) -> tuple[Cells, np.ndarray]:
        """The tile's own cells, and their distances from all that is known."""
        order = np.lexsort((told["d"], told["c"], told["r"]))  # NaN comes last
        best = _where(told, order)
        fresh = np.append(True, (np.diff(best["r"]) != 0) | (np.diff(best["c"]) != 0))[:len(order)]
        best = _where(best, fresh)
        own = best["core"]
        if not own.any():
            return _where(best, own), np.zeros(0)
        r0, c0, core, got = _block(best, ["w", "d"])
        own = _where(best, own)
        return own, _steps(got["w"], got["d"], core)[own["r"] - r0, own["c"] - c0]

    cell = "r int, c int, w double, d double"
    schema = f"run_id {run}, {cell}"

    def all_cells(key: tuple, rows: pa.Table) -> pa.Table:
        own, d = settle(_arrays(rows, "r", "c", "w", "d", "core"))
        return _rows(key, cell, own["r"], own["c"], own["w"], d)

    def moved_rim(key: tuple, rows: pa.Table) -> pa.Table:
        told = _arrays(rows, "r", "c", "w", "d", "core", "before")
        before = _where(told, told["before"])
        own, d = settle(_where(told, ~told["before"]))
        rim = np.isin(own["r"] % tile, (0, tile - 1)) | np.isin(own["c"] % tile, (0, tile - 1))
        out, d = _where(own, rim), d[rim]
        # the nearest each rim cell was before: own cells come in order, one row each
        ids, was = out["r"].astype(np.int64) * WIDE + out["c"], np.full(len(d), np.inf)
        at = np.searchsorted(ids, before["r"].astype(np.int64) * WIDE + before["c"])
        np.fmin.at(was, at, before["d"])
        return _rows(key, cell, *[a[d < was] for a in (out["r"], out["c"], out["w"], d)])

    first = cut(known.groupBy(TILE_KEY).applyInArrow(all_cells, schema), "flats")
    on_rim = (F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1)
    moved = first.where(on_rim & F.col("d").isNotNull())
    rims, told, tiles = moved, None, None
    while True:
        news = cut(grid.with_halo(moved, tile, 1).where(~F.col("core")), "flats")
        if news.isEmpty():
            break
        told = news if told is None else told.unionByName(news)
        tiles_now = news.select(*TILE_KEY).distinct()
        tiles = tiles_now if tiles is None else tiles.union(tiles_now)
        heard = known.unionByName(told).withColumn("before", F.lit(False)).unionByName(
            grid.with_tile(rims, tile).withColumn("core", F.lit(True)).withColumn("before", F.lit(True)))
        moved = cut(heard.join(tiles_now, TILE_KEY, "left_semi").groupBy(TILE_KEY).applyInArrow(moved_rim, schema), "flats")
        rims = rims.unionByName(moved)
    done = first
    if tiles is not None:
        tiles = tiles.distinct()
        again = known.unionByName(told).join(tiles, TILE_KEY, "left_semi").groupBy(TILE_KEY).applyInArrow(all_cells, schema)
        done = again.unionByName(grid.with_tile(first, tile).join(tiles, TILE_KEY, "left_anti").select(*first.columns))
    return (marked.join(done.select(*grid.CELL, "d"), grid.CELL, "left")
                  .withColumn("zr", F.col("filled") + eps * F.coalesce("d", F.lit(0.0)))
                  .drop("flat", "d"))


def flow_direction(cells: DataFrame, value: str = "zr", dx: float = 1.0) -> DataFrame:
    """Adds ``dir`` (0..7 or NULL), ``d8`` (ESRI byte, 0 = none) and ``down_r, down_c``.

    Steepest drop per centre distance, strictly positive, first of E SE S SW W NW N NE.
    """
    diagonal = dx * 2.0 ** 0.5
    dist = [diagonal if dr and dc else dx for dr, dc in RING]
    nb = grid.neighbours8(cells, value)
    drop = F.array(*[(F.col(value) - F.col("nb")[k]) / dist[k] for k in range(8)])
    out = nb.withColumn("_s", drop).withColumn("_b", F.array_max("_s"))
    has = ~_any_null("nb") & (F.col("_b") > 0)
    out = out.withColumn("dir", F.when(has, F.array_position("_s", F.col("_b")).cast("int") - 1))

    def pick(values):
        return F.try_element_at(F.array(*[F.lit(v) for v in values]), F.col("dir") + 1)

    return (out.withColumn("d8", F.coalesce(pick(fixed.D8_CODES), F.lit(0)))
               .withColumn("down_r", F.col("r") + pick(fixed.D8_DR))
               .withColumn("down_c", F.col("c") + pick(fixed.D8_DC))
               .drop("nb", "_s", "_b"))


def _ids(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.nan_to_num(r).astype(np.int64) * WIDE + np.nan_to_num(c).astype(np.int64)


def _tile_paths(own: Cells):
    """Ids of a tile's cells, their targets, the successor inside the tile (``n`` = leaves or ends), and who ends."""
    n = len(own["r"])
    ids, ends = _ids(own["r"], own["c"]), np.isnan(own["down_r"])
    to = np.where(ends, -1, _ids(own["down_r"], own["down_c"]))
    order = np.argsort(ids)
    at = np.searchsorted(ids, to, sorter=order)
    at = order[np.minimum(at, n - 1)]
    inside = ~ends & (ids[at] == to)
    return ids, to, np.where(inside, at, n), ends


def _entries(halo: Cells, ids: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of core cells that neighbouring tiles drain into, and one draining cell of each such tile."""
    halo = _where(halo, ~np.isnan(halo["down_r"]))
    to = _ids(halo["down_r"], halo["down_c"])
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, to, sorter=order), len(ids) - 1)]
    hit = ids[at] == to
    at, src = at[hit], _ids(halo["r"], halo["c"])[hit]
    tr, tc = src // WIDE // tile, src % WIDE // tile
    order = np.lexsort((tc, tr, at))
    fresh = np.append(True, np.any([np.diff(a[order]) != 0 for a in (at, tr, tc)], axis=0))[:len(order)]
    return at[order][fresh], src[order][fresh]


def _flow_halo(flow: DataFrame, tile: int, *extra: str) -> DataFrame:
    return grid.with_halo(flow.select(*grid.CELL, "down_r", "down_c", *extra), tile, 1)


_LINK = "tr int, tc int, kind int, a long, p long, v double, src long"


def _links(key: tuple, kind, a, p, v, src) -> pa.Table:
    return _rows(key, _LINK, key[1].as_py(), key[2].as_py(), np.asarray(kind), np.asarray(a), np.asarray(p), np.asarray(v), np.asarray(src))


def flow_accumulation(flow: DataFrame, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Adds ``acc``: cells draining through each cell, itself included."""
    run = _run_type(flow)

    def links(key: tuple, rows: pa.Table) -> pa.Table:
        got = _arrays(rows, "r", "c", "down_r", "down_c", "core")
        if not got["core"].any():
            return _links(key, [], [], [], [], [])
        ids, to, nxt, ends = _tile_paths(_where(got, got["core"]))
        acc, last = down_sums(nxt, np.ones(len(ids))), last_of(nxt)
        leaves = np.flatnonzero((nxt == len(ids)) & ~ends)
        inn, src = _entries(_where(got, ~got["core"]), ids, tile)
        goal, place = np.unique(to[leaves], return_inverse=True)
        none = np.full(len(goal), -1)
        return _links(key, [EXIT] * len(goal) + [ENTRY] * len(inn), np.concatenate([goal, ids[inn]]),
                      np.concatenate([none, to[last[inn]]]),
                      np.concatenate([np.bincount(place, weights=acc[leaves], minlength=len(goal)), np.zeros(len(inn))]),
                      np.concatenate([none, src]))

    raw = _flow_halo(flow, tile).groupBy(TILE_KEY).applyInArrow(links, f"run_id {run}, {_LINK}")
    came = inflows(raw, tile, run)

    def sums(cells_: pa.Table, came_: pa.Table) -> pa.Table:
        body = cells_.drop_columns(["tr", "tc"])
        if not len(body):
            return body.append_column("acc", pa.array([], pa.float64()))
        ids, _, nxt, _ = _tile_paths(_arrays(cells_, "r", "c", "down_r", "down_c"))
        start = np.ones(len(ids))
        order = np.argsort(ids)
        start[order[np.searchsorted(ids, came_.column("a").to_numpy(), sorter=order)]] += came_.column("v").to_numpy()
        return body.append_column("acc", pa.array(down_sums(nxt, start)))

    return grid.with_tile(flow, tile).groupBy(TILE_KEY).cogroup(came.groupBy(TILE_KEY)).applyInArrow(
        sums, _with_column(flow, "acc double"))


def with_stream(flow: DataFrame, dx: float, threshold_km2: float = 1.0) -> DataFrame:
    """Adds ``area_km2`` and ``stream`` (contributing area at or above the threshold)."""
    return (flow.withColumn("area_km2", F.col("acc") * dx * dx / 1e6)
                .withColumn("stream", F.col("acc") >= threshold_km2 * 1e6 / (dx * dx)))


def height_above_drainage(flow: DataFrame, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Adds ``hand``: real bed minus the bed of the first stream or outlet cell downstream."""
    run = _run_type(flow)

    names = ("r", "c", "down_r", "down_c", "z", "stream")

    def paths(own: Cells):
        """Per core cell whether its path ends in the tile, the bed where it does, and the cell it leaves to."""
        ids, to, nxt, ends = _tile_paths(own)
        halt = own["stream"].astype(bool) | ends
        last = last_of(np.where(halt, len(ids), nxt))
        found = halt[last]
        return ids, found, np.where(found, own["z"].astype(float)[last], np.nan), np.where(found, -1, to[last])

    def links(key: tuple, rows: pa.Table) -> pa.Table:
        got = _arrays(rows, *names, "core")
        if not got["core"].any():
            return _links(key, [], [], [], [], [])
        ids, found, ref, goal = paths(_where(got, got["core"]))
        inn, src = _entries(_where(got, ~got["core"]), ids, tile)
        goals = np.unique(goal[~found])
        none = np.full(len(goals), -1)
        return _links(key, [EXIT] * len(goals) + [ENTRY] * len(inn), np.concatenate([goals, ids[inn]]),
                      np.concatenate([none, goal[inn]]), np.concatenate([none, ref[inn]]), np.concatenate([none, src]))

    raw = _flow_halo(flow, tile, "z", "stream").groupBy(TILE_KEY).applyInArrow(links, f"run_id {run}, {_LINK}")
    far = far_values(raw, tile, run)

    def heights(cells_: pa.Table, far_: pa.Table) -> pa.Table:
        body = cells_.drop_columns(["tr", "tc"])
        if not len(body):
            return body.append_column("hand", pa.array([], pa.float64()))
        own = _arrays(cells_, *names)
        _, found, ref, goal = paths(own)
        known, first = np.unique(far_.column("a").to_numpy(), return_index=True)
        if len(known):
            at = np.minimum(np.searchsorted(known, goal), len(known) - 1)
            ref = np.where(found, ref, far_.column("v").to_numpy()[first][at])
        return body.append_column("hand", pa.array(own["z"].astype(float) - ref))

    return grid.with_tile(flow, tile).groupBy(TILE_KEY).cogroup(far.groupBy(TILE_KEY)).applyInArrow(
        heights, _with_column(flow, "hand double"))


def trace_downstream(flow: DataFrame, starts: DataFrame, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Cells visited from each start ``(run_id, start_id, r, c)``: adds step ``k``.

    Paths are followed to their end, however long: flow only goes down, so none returns.  Where a path enters a tile
    it jumps to where it enters the next; jumps are doubled until none is left, and every start's entries are listed
    from the longest jump down.  So the rounds are the logarithm of the tiles crossed, on tables of rim cells; then
    each tile writes the cells of the paths through it.
    """
    run = _run_type(flow)
    sid = starts.schema["start_id"].dataType.simpleString()
    heads = starts.select("run_id", "start_id", "r", "c", cell_id().alias("a"))
    begins = grid.with_tile(heads.select(*grid.CELL).distinct(), tile)

    hop = "a long, b long, steps long"

    def hops(key: tuple, rows: pa.Table) -> pa.Table:
        got = _arrays(rows, "r", "c", "down_r", "down_c", "core", "begin")
        own = _where(got, got["core"] & ~got["begin"])
        if not len(own["r"]):
            return _rows(key, hop, *[np.zeros(0)] * 3)
        ids, to, nxt, ends = _tile_paths(own)
        marks = _where(got, got["begin"])
        at = _ids(marks["r"], marks["c"])
        inn = np.unique(np.concatenate([_entries(_where(got, ~got["core"] & ~got["begin"]), ids, tile)[0], np.flatnonzero(np.isin(ids, at))]))
        last = last_of(nxt)[inn]
        go = ~ends[last]
        return _rows(key, hop, ids[inn][go], to[last][go], down_depth(nxt)[inn][go])

    halo = _flow_halo(flow, tile).withColumn("begin", F.lit(False))
    marks = begins.withColumn("begin", F.lit(True)).withColumn("core", F.lit(False))
    jump = cut(halo.unionByName(marks, allowMissingColumns=True).groupBy(TILE_KEY).applyInArrow(
        hops, f"run_id {run}, {hop}"), "trace")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        then = jump.select("run_id", F.col("a").alias("b"), F.col("b").alias("to"), F.col("steps").alias("more"))
        jump = cut(jump.join(then, ["run_id", "b"]).select(
            "run_id", "a", F.col("to").alias("b"), (F.col("steps") + F.col("more")).alias("steps")), "trace")
    at = heads.select("run_id", "start_id", "a", F.lit(0).cast("long").alias("k"))
    for jump in reversed(jumps):
        on = at.join(jump, ["run_id", "a"]).select("run_id", "start_id", F.col("b").alias("a"), (F.col("k") + F.col("steps")).alias("k"))
        at = cut(at.unionByName(on), "trace")
    at = grid.with_tile(at.select("*", F.floor(F.col("a") / WIDE).cast("int").alias("r"),
                                  (F.col("a") % WIDE).cast("int").alias("c")).drop("a"), tile)

    def walk(heads_: pa.Table, cells_: pa.Table) -> pa.Table:
        names = ["run_id", "start_id", "r", "c", "k"]
        if not len(heads_) or not len(cells_):
            return heads_.select(names[:2]).slice(0, 0).append_column("r", pa.array([], pa.int32())).append_column(
                "c", pa.array([], pa.int32())).append_column("k", pa.array([], pa.int32()))
        own, at = _arrays(cells_, "r", "c", "down_r", "down_c"), _arrays(heads_, "r", "c", "k")
        ids, _, nxt, _ = _tile_paths(own)
        order, here = np.argsort(ids), _ids(at["r"], at["c"])
        cur = order[np.minimum(np.searchsorted(ids, here, sorter=order), len(ids) - 1)]
        on = np.flatnonzero(ids[cur] == here)
        who, cur, k = on, cur[on], at["k"][on]
        steps = []
        while len(cur):
            steps.append((who, cur, k))
            cur = nxt[cur]
            go = cur < len(ids)
            who, cur, k = who[go], cur[go], k[go] + 1
        who, cur, k = (np.concatenate(x) for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 3
        return pa.table([*heads_.select(names[:2]).take(pa.array(who)).columns, *[pa.array(x, pa.int32(), safe=False) for x in (own["r"][cur], own["c"][cur], k)]],
                        names=names)

    cells_ = grid.with_tile(flow.select(*grid.CELL, "down_r", "down_c"), tile).join(
        at.select(*TILE_KEY).distinct(), TILE_KEY, "left_semi")
    return at.groupBy(TILE_KEY).cogroup(cells_.groupBy(TILE_KEY)).applyInArrow(
        walk, f"run_id {run}, start_id {sid}, r int, c int, k int")


def path_distance(trace: DataFrame, dx: float) -> DataFrame:
    """Adds ``dist_m`` along each trace (a window per path)."""
    w = Window.partitionBy("run_id", "start_id").orderBy("k")
    dr, dc = F.col("r") - F.lag("r").over(w), F.col("c") - F.lag("c").over(w)
    step = F.coalesce(F.sqrt((dr * dr + dc * dc).cast("double")) * dx, F.lit(0.0))
    return trace.withColumn("step_m", step).withColumn(
        "dist_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step_m")


def trace_profile(trace: DataFrame, cells: DataFrame, dx: float, *values: str) -> DataFrame:
    """The cells of each trace with their distance along it and what ``cells`` say about them."""
    return path_distance(trace, dx).join(cells.select(*grid.CELL, *values), grid.CELL, "left")


def bed_drop(profile: DataFrame) -> DataFrame:
    """Per trace its cells, its length, and how far the bed ``z`` drops along it, in all and per kilometre."""
    drop = F.min_by("z", "k") - F.max_by("z", "k")
    return profile.groupBy("run_id", "start_id").agg(
        F.count("*").alias("steps"), F.max("dist_m").alias("length_m"), drop.alias("drop_m"),
        (1000.0 * drop / F.greatest(F.max("dist_m"), F.lit(1.0))).alias("drop_per_km"))


def confluences(trace: DataFrame, area: DataFrame, samples: int = 20, ratio: float = 1.6) -> DataFrame:
    """Sampled cells of each trace where ``area_km2`` is over ``ratio`` times that of the sample before.

    A trace is sampled at every cell whose step is a multiple of a ``samples``-th of its cells.
    """
    path = Window.partitionBy("run_id", "start_id")
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(path) / samples))
    sampled = trace.withColumn("stride", stride).where(F.col("k") % F.col("stride") == 0)
    prev = F.lag("area_km2").over(path.orderBy("k"))
    found = sampled.join(area.select(*grid.CELL, "area_km2"), grid.CELL).withColumn("prev", prev)
    return found.where(F.col("area_km2") > ratio * F.col("prev")).select(
        "run_id", "start_id", "k", F.col("area_km2").alias("area"), "prev")


def _window_cells(points: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """Pairs of a point and the cells of its square window (offsets, then an equi-join)."""
    base = points.withColumn("pr", F.col("r")).withColumn("pc", F.col("c"))
    return grid.spread_box(base, radius).hint("merge").join(cells, grid.CELL)  # many times the points: never broadcast


def snap_to_stream(points: DataFrame, flow: DataFrame, dx: float, radius: int = 8,
                   trunk_fraction: float = 0.5, suspect_ratio: float = 5.0,
                   min_area_km2: float | None = None) -> DataFrame:
    """Nearest cell of the main channel around each ``(run_id, point_id, r, c)``.

    The channel is every window cell with at least ``trunk_fraction`` of the window's
    largest area; the nearest wins, then the larger area, then row and column.
    ``suspect`` says that twice the radius holds a far larger channel.
    """
    k = ["run_id", "point_id"]
    near = _window_cells(points.select(*k, "r", "c"), flow.select(*grid.CELL, "area_km2"), radius)
    d2 = (F.col("r") - F.col("pr")) ** 2 + (F.col("c") - F.col("pc")) ** 2
    near = near.withColumn("d2", d2)
    if min_area_km2 is not None:
        near = near.where(F.col("area_km2") >= min_area_km2)
    peak = F.max("area_km2").over(Window.partitionBy(*k))
    trunk = near.withColumn("peak", peak).where(F.col("area_km2") >= trunk_fraction * F.col("peak"))
    best = trunk.groupBy(*k, "pr", "pc").agg(F.min(F.struct(
        "d2", (-F.col("area_km2")).alias("na"), "r", "c")).alias("b"))
    wide = _window_cells(points.select(*k, "r", "c"), flow.select(*grid.CELL, "area_km2"), 2 * radius)
    wide = wide.groupBy(*k).agg(F.max(F.struct("area_km2", (-F.col("r")).alias("r"),
                                               (-F.col("c")).alias("c"))).alias("w"))
    out = points.select(*k).join(best, k, "left").join(wide, k, "left")
    return out.select(
        *k, F.col("b.r").alias("snap_r"), F.col("b.c").alias("snap_c"),
        (F.sqrt(F.col("b.d2").cast("double")) * dx).alias("moved_m"),
        (-F.col("b.na")).alias("area_km2"), F.col("w.area_km2").alias("best_nearby_km2"),
        F.coalesce((-F.col("b.na") > 0) & (F.col("w.area_km2") > suspect_ratio * -F.col("b.na")),
                   F.lit(False)).alias("suspect"),
        F.greatest(F.abs(-F.col("w.r") - F.col("pr")), F.abs(-F.col("w.c") - F.col("pc")))
         .alias("wide_radius_cells"),
        F.col("b").isNull().alias("not_found"))


def injection_cell(dams: DataFrame, cells: DataFrame, dx: float, radius: int,
                   trunk_fraction: float = 0.5, suspect_ratio: float = 5.0) -> DataFrame:
    """Channel cell just below each dam ``(run_id, point_id, r, c)``.

    Candidates lie outside the ``pool`` and no higher than the dam's own cell.
    """
    k = ["run_id", "point_id"]
    at = dams.select(*k, "r", "c").join(cells.select(*grid.CELL, F.col("z").alias("z_dam")),
                                        grid.CELL, "left")
    body = cells.select(*grid.CELL, "z", "area_km2", "pool")

    def candidates(rad):
        near = _window_cells(at, body, rad).where(~F.col("pool") & (F.col("z") <= F.col("z_dam")))
        return near.withColumn("d2", (F.col("r") - F.col("pr")) ** 2 + (F.col("c") - F.col("pc")) ** 2)

    near = candidates(radius).withColumn("best", F.max("area_km2").over(Window.partitionBy(*k)))
    pick = (near.where((F.col("best") > 0) & (F.col("area_km2") >= trunk_fraction * F.col("best")))
                .groupBy(*k).agg(F.min(F.struct("d2", "r", "c", "area_km2", "z")).alias("b"),
                                 F.first("best").alias("best")))
    wide = candidates(2 * radius).groupBy(*k).agg(F.max("area_km2").alias("best_wide"))
    out = dams.select(*k).join(pick, k, "left").join(wide, k, "left")
    return out.select(*k, F.col("b.r").alias("inj_r"), F.col("b.c").alias("inj_c"),
                      (F.sqrt(F.col("b.d2").cast("double")) * dx).alias("moved_m"),
                      F.col("b.area_km2").alias("area_km2"), "best_wide",
                      F.coalesce(F.col("best_wide") > suspect_ratio * F.col("b.area_km2"), F.lit(False))
                       .alias("suspect"),
                      F.when(F.col("b").isNull(), "no cell below the dam outside the pool")
                       .alias("problem"))


def injection_footprint(trace: DataFrame, pool: DataFrame, n: int, dx: float) -> DataFrame:
    """First ``n`` trace cells outside the pool, with reach length and flow direction."""
    kept = path_distance(trace, dx).join(pool.select(*grid.CELL), grid.CELL, "left_anti")
    w = Window.partitionBy("run_id", "start_id").orderBy("k")
    ranked = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    first = trace.where("k <= 1").groupBy("run_id", "start_id").agg(
        (F.max_by("c", "k") - F.min_by("c", "k")).alias("di"),
        (F.max_by("r", "k") - F.min_by("r", "k")).alias("dj"))
    norm = F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double"))
    first = first.select("run_id", "start_id", F.when(norm > 0, F.col("di") / norm).alias("dir_x"),
                         F.when(norm > 0, F.col("dj") / norm).alias("dir_y"))
    return ranked.join(first, ["run_id", "start_id"])


def routing_checks(flow: DataFrame) -> DataFrame:
    """Per run: interior cells without receiver, outlet total, lowered cells, negative HAND."""
    size = grid.grid_sizes(flow)
    f = flow.join(size, "run_id")
    inner = ((F.col("r") > 0) & (F.col("r") < F.col("ny") - 1)
             & (F.col("c") > 0) & (F.col("c") < F.col("nx") - 1))
    return f.groupBy("run_id").agg(
        F.count_if(inner & F.col("down_r").isNull()).alias("interior_orphans"),
        F.sum(F.when(F.col("down_r").isNull(), F.col("acc"))).alias("outlet_total"),
        F.count("*").alias("cells"),
        F.count_if(F.col("zr") < F.col("z") - 1e-9).alias("lowered"),
        F.count_if(F.col("hand") < -1e-6).alias("negative_hand"))


def analyse_flow(dem: DataFrame, dx: float, stream_km2: float, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Fill, route, accumulate, and measure heights above drainage for every run."""
    filled = cut(fill_depressions(dem.select(*grid.CELL, "z"), tile), "filled")
    flow = cut(flow_direction(routing_surface(filled, tile=tile), "zr", dx), "flow")
    acc = with_stream(flow_accumulation(flow, tile), dx, stream_km2)
    return height_above_drainage(cut(acc, "acc"), tile)
