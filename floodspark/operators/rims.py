"""Tiles united level by level through what their rims need to know.

A kernel has reduced every tile to a few rows about the cells on its rim.  ``FAN`` by ``FAN`` tiles are united in one
task: what happens between them is settled there, and only rows about the rim of the united tile go up a level.  From
the top, where one tile holds the grid, answers come down the same way.  A task holds the rims of ``FAN ** 2`` tiles,
so the rows in a task follow the width of the grid, the levels its logarithm, and the levels' tables shrink upwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.session import cut

#: Tiles united per level and axis.
FAN = 8
OCEAN = -1
# cell id: row * WIDE + column, so ids order cells row by row
WIDE = 1 << 31


@dataclass(frozen=True)
class Pyramid:
    """United tiles over a grid of tiles: ``tile`` cells wide, the first at ``(r0, c0)``."""
    tile: int
    r0: int
    c0: int
    levels: int
    fan: int

    @classmethod
    def over(cls, rows: DataFrame, tile: int) -> Pyramid:
        """From rows with the tile indices ``tr, tc``; there is a level above the tiles even if there is one tile."""
        lo_r, hi_r, lo_c, hi_c = rows.agg(F.min("tr"), F.max("tr"), F.min("tc"), F.max("tc")).first()
        if lo_r is None:
            return cls(tile, 0, 0, 1, FAN)
        levels, width = 1, FAN
        while width <= max(hi_r - lo_r, hi_c - lo_c):
            levels, width = levels + 1, width * FAN
        return cls(tile, lo_r, lo_c, levels, FAN)

    def home(self, ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the united tiles of a level that hold the cells."""
        span = self.fan ** level
        return (ids // WIDE // self.tile - self.r0) // span, (ids % WIDE // self.tile - self.c0) // span

    def inside(self, ids: np.ndarray, level: int, at: tuple[int, int]) -> np.ndarray:
        r, c = self.home(ids, level)
        return (r == at[0]) & (c == at[1])

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``gr, gc`` in place of the tile indices ``tr, tc``."""
        return rows.withColumn("gr", F.col("tr") - self.r0).withColumn("gc", F.col("tc") - self.c0).drop("tr", "tc")

    def raised(self, rows: DataFrame) -> DataFrame:
        """The same rows keyed by the united tile one level up."""
        up = lambda name: F.floor(F.col(name) / self.fan).cast("int")
        return rows.withColumn("gr", up("gr")).withColumn("gc", up("gc"))

    def tiles(self, rows: DataFrame, *columns: Column) -> DataFrame:
        """``run_id, tr, tc`` and ``columns`` of rows keyed by tile."""
        return rows.select("run_id", (F.col("gr") + self.r0).alias("tr"), (F.col("gc") + self.c0).alias("tc"), *columns)


def group(rows: DataFrame, kernel: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.groupBy("run_id", "gr", "gc").applyInPandas(kernel, schema)


# --- lowest passes -----------------------------------------------------------------------------------

def joined_passes(a: np.ndarray, b: np.ndarray, w: np.ndarray, keep: np.ndarray) -> list[tuple[int, int, float]]:
    """A forest over the ``keep`` nodes with the same lowest passes between them as the whole graph.

    Edges are taken from the lowest up; a set of nodes is known by one kept node it holds, and an edge that unites two
    such sets is one between those nodes.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    known = np.where(np.isin(nodes, keep), np.arange(len(nodes)), -1).tolist()
    parent = list(range(len(nodes)))
    order = np.argsort(w, kind="stable")
    out = []
    for i, j, height in zip(ends[:len(a)][order].tolist(), ends[len(a):][order].tolist(), w[order].tolist()):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i == j:
            continue
        if known[i] < 0:
            i, j = j, i
        parent[j] = i
        if known[j] >= 0:
            out.append((known[i], known[j], height))
    return [(int(nodes[i]), int(nodes[j]), height) for i, j, height in out]


def drained(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the lowest level at which each reaches ``OCEAN``."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    level = np.full(len(nodes), np.inf)
    parent, members = list(range(len(nodes))), [[k] for k in range(len(nodes))]
    sea = int(np.searchsorted(nodes, OCEAN))
    if sea == len(nodes) or nodes[sea] != OCEAN:
        return nodes, level
    order = np.argsort(w, kind="stable")
    for i, j, height in zip(ends[:len(a)][order].tolist(), ends[len(a):][order].tolist(), w[order].tolist()):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i == j:
            continue
        if j == sea or (i != sea and len(members[i]) < len(members[j])):
            i, j = j, i
        parent[j] = i
        if i == sea:  # all that hangs on j drains at this height
            level[members[j]] = height
        else:
            members[i] += members[j]
        members[j] = []
    return nodes, level


def spill_levels(edges: DataFrame, tile: int, run: str) -> DataFrame:
    """``run_id, tr, tc, node, level``: the lowest level at which rim cells drain, from passes between them.

    ``edges`` is ``run_id, tr, tc, a, b, w``: heights ``w`` at which rim cell ``a`` of the tile meets ``b``, another one
    of the same tile, one of a tile beside it, or ``OCEAN``.
    """
    first = cut(edges, "passes")
    pyramid = Pyramid.over(first, tile)
    levels = [pyramid.keyed(first)]
    schema = f"run_id {run}, gr int, gc int, a long, b long, w double"

    def unite(level: int):
        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            a, b, w = (pdf[c].to_numpy() for c in ("a", "b", "w"))
            own = (b == OCEAN) | pyramid.inside(b, level, key[1:])
            rim = np.unique(a[~own])
            rows = joined_passes(a[own], b[own], w[own], np.append(rim, OCEAN))
            low = [(y, x, h) if x == OCEAN else (x, y, h) for x, y, h in rows]
            inner = pd.DataFrame(low, columns=["a", "b", "w"]).astype({"a": "int64", "b": "int64", "w": "float64"})
            out = pd.concat([inner, pdf.loc[~own, ["a", "b", "w"]]])
            return out.assign(run_id=key[0], gr=key[1], gc=key[2])[["run_id", "gr", "gc", "a", "b", "w"]]
        return kernel

    for level in range(1, pyramid.levels):
        levels.append(cut(group(pyramid.raised(levels[-1]), unite(level), schema), "passes"))

    def settle(level: int):
        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            a, b, w = (pdf[c].to_numpy() for c in ("a", "b", "w"))
            own = (b == OCEAN) | pyramid.inside(b, level, key[1:])
            nodes, height = drained(a[own], b[own], w[own])
            height, nodes = height[nodes != OCEAN], nodes[nodes != OCEAN]
            r, c = pyramid.home(nodes, level - 1)
            return pd.DataFrame({"run_id": key[0], "gr": r.astype(np.int32), "gc": c.astype(np.int32), "a": nodes, "b": OCEAN, "w": height})
        return kernel

    known = None  # levels of rim cells come down as passes to the ocean
    for level in range(pyramid.levels, 0, -1):
        rows = pyramid.raised(levels[level - 1])
        known = group(rows if known is None else rows.unionByName(known), settle(level), schema)
    return pyramid.tiles(known, F.col("a").alias("node"), F.col("w").alias("level"))


# --- what flows in, and where it ends -------------------------------------------------------------------------

def _chained(entry: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Place in ``entry`` (sorted) of each target, ``len(entry)`` if it is none of them."""
    if not len(entry):
        return np.zeros(len(to), np.int64)
    at = np.searchsorted(entry, to)
    at = np.minimum(at, len(entry) - 1)
    return np.where(entry[at] == to, at, len(entry))


def last_of(nxt: np.ndarray) -> np.ndarray:
    """Where each path ends; ``len(nxt)`` means nowhere further."""
    n = len(nxt)
    last, jump = np.arange(n + 1), np.append(nxt, n)
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return last[:n]


def down_sums(nxt: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of ``start`` over each place and everything upstream of it."""
    n = len(nxt)
    acc, jump = np.append(start.astype(float), 0.0), np.append(nxt, n)
    while (jump[:n] < n).any():
        live = jump < n
        acc = acc + np.bincount(jump[live], weights=acc[live], minlength=n + 1)
        jump = jump[jump]
    return acc[:n]


def down_depth(nxt: np.ndarray) -> np.ndarray:
    """Steps from each place to where its path ends, and one more: the steps out of the tile."""
    n = len(nxt)
    depth, jump = np.append(np.ones(n, np.int64), 0), np.append(nxt, n)
    while (jump[:n] < n).any():
        depth = depth + np.where(jump < n, depth[jump], 0)
        jump = jump[jump]
    return depth[:n]


# rows about a tile: cells that something flows into, with the tile it comes from and the cell it leaves to;
# what leaves for a cell; what came down about a cell
ENTRY, EXIT, KNOWN = 0, 1, 2
_FLOW = "gr int, gc int, kind int, a long, p long, v double, src long"


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf[pdf["kind"] == ENTRY]
    return rows.drop_duplicates("a").sort_values("a")


def inflows(links: DataFrame, tile: int, run: str) -> DataFrame:
    """``run_id, tr, tc, a, v``: what flows into rim cells from beyond their tile.

    ``links`` is ``run_id, tr, tc, kind, a, p, v, src``: ``ENTRY`` rows say that cell ``a`` takes water from the tile
    of cell ``src`` and that its water leaves the tile for cell ``p`` (-1: it stays), ``EXIT`` rows that ``v`` of the
    tile's own water leaves for cell ``a``.
    """
    first = cut(links, "links")
    pyramid = Pyramid.over(first, tile)
    levels = [pyramid.keyed(first)]
    schema = f"run_id {run}, {_FLOW}"

    def network(pdf: pd.DataFrame):
        entry = _entries(pdf)
        ids, to = entry["a"].to_numpy(), entry["p"].to_numpy()
        nxt = _chained(ids, to)
        leaving = pdf[pdf["kind"] == EXIT]
        goal, v = leaving["a"].to_numpy(), leaving["v"].to_numpy()
        at = _chained(ids, goal)
        start = np.bincount(at, weights=v, minlength=len(ids) + 1)[:len(ids)]
        return ids, to, nxt, goal, v, at, start

    def unite(level: int):
        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, to, nxt, goal, v, at, start = network(pdf)
            total, last = down_sums(nxt, start), last_of(nxt)
            gone = np.flatnonzero((nxt == len(ids)) & (to >= 0))
            out = pd.DataFrame({"a": np.concatenate([goal[at == len(ids)], to[gone]]),
                                "v": np.concatenate([v[at == len(ids)], total[gone]])}).groupby("a", as_index=False)["v"].sum()
            out = out.assign(kind=EXIT, p=-1, src=-1)
            rows = pdf[pdf["kind"] == ENTRY]
            rows = rows[~pyramid.inside(rows["src"].to_numpy(), level, key[1:])]
            end = to[last][np.searchsorted(ids, rows["a"].to_numpy())]
            both = pd.concat([out, rows.assign(p=end)[["a", "v", "kind", "p", "src"]]])
            return _flow_rows(both, key[0], key[1], key[2])
        return kernel

    for level in range(1, pyramid.levels):
        levels.append(cut(group(pyramid.raised(levels[-1]), unite(level), schema), "links"))

    def settle(level: int):
        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, _, nxt, _, _, _, start = network(pdf)
            down = pdf[pdf["kind"] == KNOWN]
            np.add.at(start, np.searchsorted(ids, down["a"].to_numpy()), down["v"].to_numpy())
            r, c = pyramid.home(ids, level - 1)
            out = pd.DataFrame({"a": ids, "v": down_sums(nxt, start), "kind": KNOWN, "p": -1, "src": -1})
            return _flow_rows(out, key[0], r, c)
        return kernel

    known = None
    for level in range(pyramid.levels, 0, -1):
        rows = pyramid.raised(levels[level - 1])
        known = group(rows if known is None else rows.unionByName(known), settle(level), schema)
    return pyramid.tiles(known, F.col("a"), F.col("v"))


def _flow_rows(rows: pd.DataFrame, run, gr, gc) -> pd.DataFrame:
    out = rows.assign(run_id=run, gr=gr, gc=gc)[["run_id", "gr", "gc", "kind", "a", "p", "v", "src"]]
    return out.astype({"gr": "int32", "gc": "int32", "kind": "int32", "a": "int64", "p": "int64", "v": "float64", "src": "int64"})


def far_values(links: DataFrame, tile: int, run: str) -> DataFrame:
    """``run_id, tr, tc, a, v``: for cells ``a`` that paths of a tile leave to, the value at the end of their path.

    ``links`` is ``run_id, tr, tc, kind, a, p, v, src``: ``ENTRY`` rows say that the path from cell ``a`` leaves its
    tile for cell ``p``, or ends in it (``p`` -1) at value ``v``; ``src`` is as for ``inflows``.  ``EXIT`` rows name
    the cells that other paths of the tile leave to.
    """
    first = cut(links, "links")
    pyramid = Pyramid.over(first, tile)
    levels = [pyramid.keyed(first)]
    schema = f"run_id {run}, {_FLOW}"

    def network(pdf: pd.DataFrame):
        entry = _entries(pdf)
        ids, to = entry["a"].to_numpy(), entry["p"].to_numpy()
        return ids, to, entry["v"].to_numpy(), last_of(_chained(ids, to))

    def unite(level: int):
        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, to, v, last = network(pdf)
            rows = pdf[pdf["kind"] == ENTRY]
            rows = rows[~pyramid.inside(rows["src"].to_numpy(), level, key[1:])]
            end = last[np.searchsorted(ids, rows["a"].to_numpy())]
            rows = rows.assign(p=to[end], v=v[end])
            goals = np.unique(np.concatenate([to[to >= 0], pdf.loc[pdf["kind"] == EXIT, "a"].to_numpy()]))
            goals = goals[~pyramid.inside(goals, level, key[1:])]
            out = pd.DataFrame({"a": goals, "v": np.nan, "kind": EXIT, "p": -1, "src": -1})
            return _flow_rows(pd.concat([out, rows[["a", "v", "kind", "p", "src"]]]), key[0], key[1], key[2])
        return kernel

    for level in range(1, pyramid.levels):
        levels.append(cut(group(pyramid.raised(levels[-1]), unite(level), schema), "links"))

    def settle(level: int):
        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            ids, to, v, last = network(pdf)
            down = pdf[pdf["kind"] == KNOWN].sort_values("a")
            far = np.append(down["v"].to_numpy(), np.nan)
            end = to[last] if len(ids) else to
            value = np.where(end < 0, v[last], far[_chained(down["a"].to_numpy(), end)]) if len(ids) else v
            # every tile below is told about the cells that its paths leave to
            asks = pdf[(pdf["kind"] == EXIT) | ((pdf["kind"] == ENTRY) & (pdf["p"] >= 0))]
            goal = np.where(asks["kind"] == EXIT, asks["a"], asks["p"])
            got = np.append(value, np.nan)[_chained(ids, goal)]
            got = np.where(np.isin(goal, ids), got, far[_chained(down["a"].to_numpy(), goal)])
            out = pd.DataFrame({"a": goal, "v": got, "kind": KNOWN, "p": -1, "src": -1, "gr": asks["cr"], "gc": asks["cc"]})
            out = out.drop_duplicates(["a", "gr", "gc"])
            return _flow_rows(out, key[0], out["gr"], out["gc"])
        return kernel

    known = None
    for level in range(pyramid.levels, 0, -1):
        rows = pyramid.raised(levels[level - 1].withColumn("cr", F.col("gr")).withColumn("cc", F.col("gc")))
        if known is not None:
            rows = rows.unionByName(known.withColumn("cr", F.col("gr")).withColumn("cc", F.col("gc")))
        known = group(rows, settle(level), schema)
    return pyramid.tiles(known, F.col("a"), F.col("v"))


# --- connected parts --------------------------------------------------------------------------------

def united_labels(rim: DataFrame, tile: int, run: str, diagonal: bool) -> DataFrame:
    """``run_id, label, root``: the labels of tiles' parts that are connected across rims, and the least of each set.

    ``rim`` is ``run_id, tr, tc, a, label``: masked rim cells and the label of their part of the tile.
    """
    first = cut(rim, "rims")
    pyramid = Pyramid.over(first, tile)
    rows = pyramid.keyed(first)
    schema = f"run_id {run}, gr int, gc int, a long, label long, root long"
    steps = [1, WIDE] + ([WIDE + 1, WIDE - 1] if diagonal else [])
    low_r, low_c = pyramid.r0 * tile, pyramid.c0 * tile

    def unite(width: int):
        def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("a")
            ids, label = pdf["a"].to_numpy(), pdf["label"].to_numpy()
            names, place = np.unique(label, return_inverse=True)
            pairs = []
            for step in steps:
                at = _chained(ids, ids + step)
                hit = at < len(ids)
                pairs.append(np.column_stack([place[hit], place[at[hit]]]))
            root = names[least_connected(len(names), np.vstack(pairs))]
            r, c = ids // WIDE - low_r - key[1] * width, ids % WIDE - low_c - key[2] * width
            outer = (r == 0) | (c == 0) | (r == width - 1) | (c == width - 1)
            up = pd.DataFrame({"a": ids[outer], "label": root[place[outer]], "root": -1})
            told = pd.DataFrame({"a": -1, "label": names, "root": root})
            out = pd.concat([up, told]).astype("int64").assign(run_id=key[0], gr=key[1], gc=key[2])
            return out[["run_id", "gr", "gc", "a", "label", "root"]]
        return kernel

    maps = []
    for level in range(1, pyramid.levels + 1):
        step = cut(group(pyramid.raised(rows), unite(pyramid.fan ** level * tile), schema), "rims")
        maps.append(step.where("root >= 0").select("run_id", "label", "root"))
        rows = step.where("a >= 0").drop("root")
    out = maps[0]
    for above in maps[1:]:
        up = above.select("run_id", F.col("label").alias("root"), F.col("root").alias("up"))
        out = out.join(up, ["run_id", "root"], "left").select("run_id", "label", F.coalesce("up", "root").alias("root"))
    return out.where("label <> root")


def least_connected(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest place connected with each of ``n`` places."""
    parent = np.arange(n)
    a, b = pairs[:, 0], pairs[:, 1]
    while len(a):
        pa, pb = parent[a], parent[b]
        if (pa == pb).all():
            break
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            nxt = parent[parent]
            if (nxt == parent).all():
                break
            parent = nxt
    return parent
