"""Geometry against cells: rings of masks, features in the flood, flooded lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark import grid
from floodspark.operators.components import WIDE
from floodspark.operators.graph import connected, forest_sums
from floodspark.session import cut


def boundary_edges(classed: DataFrame) -> DataFrame:
    """Directed unit edges around each class of ``(run_id, r, c, cls)``, interior ones cancelled.

    An edge is kept when the cell on its other side has another class or is missing;
    its own cell lies to its left, so ``edge_id`` (start corner and side) is unique.
    """
    sides = ((0, "n_", (0, 1, 0, 0)), (1, "w_", (0, 0, 1, 0)), (2, "s_", (1, 0, 1, 1)), (3, "e_", (1, 1, 0, 1)))
    at = [F.when(F.col(other).isNull() | (F.col(other) != F.col("cls")), F.struct(
        F.lit(side).alias("side"), *[(F.col(axis) + step).alias(name) for axis, name, step in zip("rcrc", ("r0", "c0", "r1", "c1"), steps)]))
        for side, other, steps in sides]
    open_ = grid.neighbours4(classed.select(*grid.CELL, "cls"), "cls").select(
        "run_id", "cls", F.explode(F.array_compact(F.array(*at))).alias("s"))
    return open_.select("run_id", "cls", "s.*").withColumn(
        "edge_id", (F.col("r0").cast("long") * WIDE + F.col("c0")) * 4 + F.col("side"))


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of one tile, by start corner, in chains: rings that close within it, and pieces that leave it.

    The surround of one corner tells the edge after and the edge before every edge of the tile.
    """
    after = pdf[["cls", "r", "c", "r1", "c1", "edge_id", "side"]]
    after = after.assign(nr=after["r1"] - after["r"], nc=after["c1"] - after["c"])
    m = after.merge(after, left_on=["cls", "r1", "c1"], right_on=["cls", "r", "c"], suffixes=("", "_n"))
    # two edges leave a corner shared by two cells: keep to the cell being followed
    m = m.assign(turn=m["nr"] * m["nc_n"] - m["nc"] * m["nr_n"]).sort_values("turn").drop_duplicates("edge_id", keep="last")
    core = pdf[pdf["core"]].sort_values("edge_id")
    ids = core["edge_id"].to_numpy()
    next_id = m.set_index("edge_id")["edge_id_n"].reindex(ids).to_numpy()
    place = np.minimum(np.searchsorted(ids, next_id), len(ids) - 1)
    to = np.where(ids[place] == next_id, place, -1)
    corner = core["edge_id"].isin(m.loc[m["side"] != m["side_n"], "edge_id_n"]).to_numpy()
    entered = np.zeros(len(ids), dtype=bool)
    entered[to[to >= 0]] = True
    step, walk = [0] * len(ids), to.tolist()
    heads = np.flatnonzero(~entered).tolist()
    head = [-1] * len(ids)
    for first in (*heads, *range(len(ids))):  # what no piece holds is in rings, met at their least edge first
        at, k = first, 0
        while at >= 0 and head[at] < 0:
            head[at], step[at], at, k = first, k, walk[at], k + 1
    chain = ids[np.array(head, dtype=int)]
    return core[["run_id", "cls", "side", "r", "c", "r1", "c1", "edge_id"]].rename(columns={"r": "r0", "c": "c0"}).assign(
        corner=corner, chain=chain, step=np.array(step, dtype="int64"), open=~entered[np.array(head, dtype=int)], next_id=next_id)


def traced_rings(classed: DataFrame, tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Boundary edges with the ring they are on: adds ``ring, place, corner``.

    Every edge knows the one after it; a ring is named by its least edge, from which the places of its edges are
    counted.  Rings inside a tile are followed there; of those that cross tiles, the pieces within tiles are the nodes
    of a graph on which components name the rings and path sums place the pieces, so no task ever holds a long
    outline.  ``corner`` says that the edge before has another direction.
    """
    edges = boundary_edges(classed)
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    halo = grid.with_halo(edges.withColumnRenamed("r0", "r").withColumnRenamed("c0", "c"), tile, 1)
    names = ("run_id", "cls", "side", "r0", "c0", "r1", "c1", "edge_id")
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", corner boolean, chain long, step long, open boolean, next_id long"

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        return _chains(pdf)

    # a surround without edges of its own has nothing to follow
    near = halo.withColumn("_own", F.max("core").over(Window.partitionBy("run_id", "tr", "tc"))).where("_own").drop("_own")
    found = cut(near.groupBy("run_id", "tr", "tc").applyInPandas(follow, schema), "chains")
    out = [*names, "ring", "place", "corner"]
    closed = found.where("NOT open").withColumn("ring", F.col("chain")).withColumn("place", F.col("step") + 1).select(*out)
    pieces = found.where("open")
    if pieces.isEmpty():
        return closed
    last = F.max_by("next_id", "step")
    piece = cut(pieces.groupBy("run_id", "chain").agg(F.count("*").alias("n"), F.min(F.struct("edge_id", "step")).alias("least"),
                                                      last.alias("to")), "pieces")
    root = connected(piece.select("run_id", F.col("chain").alias("a"), F.col("to").alias("b"))).select(
        "run_id", F.col("node").alias("chain"), "root")
    named = cut(piece.join(root, ["run_id", "chain"]), "pieces")
    first = named.groupBy("run_id", "root").agg(F.min(F.struct("least", "chain", "n")).alias("f"), F.sum("n").alias("total")).select(
        "run_id", "root", "total", F.col("f.least.edge_id").alias("ring"), F.col("f.least.step").alias("s0"), F.col("f.chain").alias("c0_"))
    named = cut(named.join(first, ["run_id", "root"]), "pieces")
    sums = forest_sums(named.select("run_id", F.col("chain").alias("a"), F.when(F.col("to") != F.col("c0_"), F.col("to")).alias("p"),
                                    F.col("n").cast("double").alias("v"))).select("run_id", F.col("a").alias("chain"), F.col("v").cast("long").alias("upto"))
    placed = named.join(sums, ["run_id", "chain"]).select("run_id", "chain", "ring", "total", (F.col("upto") - F.col("n") - F.col("s0") + 1).alias("base"))
    place = F.col("base") + F.col("step")
    crossing = pieces.join(placed, ["run_id", "chain"]).withColumn(
        "place", F.when(place < 1, place + F.col("total")).otherwise(place)).select(*out)
    return closed.unionByName(crossing)


def ring_areas(rings: DataFrame) -> DataFrame:
    """``run_id, cls, ring, signed_cells`` of traced rings: partial sums of edges, holes are negative."""
    return rings.groupBy("run_id", "cls", "ring").agg(
        (F.sum(F.col("r0") * F.col("c1") - F.col("r1") * F.col("c0")) / 2.0).alias("signed_cells"))


def ring_vertices(rings: DataFrame, transform: list[float]) -> DataFrame:
    """The corners of traced rings, a row each: ``run_id, cls, ring, place, x, y``."""
    a, b, x0, d, e, y0 = (float(v) for v in transform)
    x, y = a * F.col("c0") + b * F.col("r0") + x0, d * F.col("c0") + e * F.col("r0") + y0
    return rings.where("corner").select("run_id", "cls", "ring", "place", x.alias("x"), y.alias("y"))


def ring_text(vertices: DataFrame, per: int = 4096) -> DataFrame:
    """Closed rings as text in blocks of at most ``per`` places: ``run_id, cls, ring, block, points``.

    The blocks of a ring, in order and joined by commas, are what stands in the brackets of its well-known text; a
    ring of any length is many rows.
    """
    k = ["run_id", "cls", "ring"]
    home = vertices.groupBy(*k).agg(F.min_by(F.struct("x", "y"), "place").alias("v"), (F.max("place") + 1).alias("place"))
    closed = vertices.unionByName(home.select(*k, "place", "v.x", "v.y"))
    point = F.struct("place", F.format_string("%s %s", "x", "y").alias("xy"))
    lines = closed.groupBy(*k, F.floor(F.col("place") / per).alias("block")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return lines.select(*k, "block", F.array_join(F.transform("p", lambda v: v["xy"]), ", ").alias("points"))


def ring_features(rings: DataFrame, transform: list[float], cell_km2: float, per: int = 4096) -> DataFrame:
    """Features of traced rings: ``run_id, cls, ring, part, km2, hole, kind, points``.

    A ring of up to ``per`` edges is one closed ``Polygon``; a longer one is parts, ``LineString`` rows that each begin
    where the one before ended.  ``km2`` is the ring's own area, ``hole`` says that it is to be taken off its class.
    """
    k = ["run_id", "cls", "ring"]
    vertices = ring_vertices(rings, transform)
    size = rings.groupBy(*k).agg(F.max("place").alias("edges"))
    home = vertices.groupBy(*k).agg(F.min_by(F.struct("x", "y"), "place").alias("v"), (F.max("place") + 1).alias("place"))
    closed = vertices.unionByName(home.select(*k, "place", "v.x", "v.y")).join(size, k)
    part = F.when(F.col("edges") > per, F.floor((F.col("place") - 1) / per)).otherwise(0)
    ends = closed.withColumn("part", part)
    # the last corner of a part begins the next one
    last = ends.groupBy(*k, "part").agg(F.max_by(F.struct("place", "x", "y"), "place").alias("v"), F.max("edges").alias("edges"))
    carried = last.where(F.col("edges") > per).select(*k, "v.place", "v.x", "v.y", "edges", (F.col("part") + 1).alias("part"))
    carried = carried.join(last.select(*k, "part"), [*k, "part"], "left_semi")
    point = F.struct("place", F.array("x", "y").alias("xy"))
    parts = ends.select(*k, "place", "x", "y", "edges", "part").unionByName(carried.select(*k, "place", "x", "y", "edges", "part")).groupBy(
        *k, "part").agg(F.array_sort(F.collect_list(point)).alias("p"), F.max("edges").alias("edges"))
    area = ring_areas(rings)
    return parts.join(area, k).select(
        *k, "part", (F.abs("signed_cells") * cell_km2).alias("km2"), (F.col("signed_cells") < 0).alias("hole"),
        F.when(F.col("edges") > per, "LineString").otherwise("Polygon").alias("kind"), F.transform("p", lambda v: v["xy"]).alias("points"))


def _crossings(a: Column, b: Column) -> Column:
    """Parameters in (0, 1) at which a segment passes integer grid lines along one axis."""
    lo, hi = F.floor(F.least(a, b)).cast("int") + 1, F.ceil(F.greatest(a, b)).cast("int") - 1
    none = F.array().cast("array<double>")
    return F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: (k - a) / (b - a))).otherwise(none)


def segments_to_cells(segments: DataFrame, dx: float, x0: float, y0: float) -> DataFrame:
    """Split segments at every grid line they cross: one row per cell visited, with its length.

    ``segments`` is ``(run_id, feature_id, xa, ya, xb, yb)``.
    """
    ca, cb = (F.col("xa") - x0) / dx, (F.col("xb") - x0) / dx
    ra, rb = (y0 - F.col("ya")) / dx, (y0 - F.col("yb")) / dx
    ends = F.array(F.lit(0.0), F.lit(1.0))
    cuts = F.array_sort(F.array_distinct(F.concat(ends, _crossings(ca, cb), _crossings(ra, rb))))
    s = segments.withColumn("_t", cuts).withColumn("ca", ca).withColumn("cb", cb).withColumn("ra", ra).withColumn("rb", rb)
    s = s.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_t") - 2)))
    t0, t1 = F.get("_t", F.col("_i")), F.get("_t", F.col("_i") + 1)
    mid = (t0 + t1) / 2.0
    full = F.sqrt((F.col("xb") - F.col("xa")) ** 2 + (F.col("yb") - F.col("ya")) ** 2)
    return s.select("run_id", "feature_id",
                    F.floor(F.col("ra") + (F.col("rb") - F.col("ra")) * mid).cast("int").alias("r"),
                    F.floor(F.col("ca") + (F.col("cb") - F.col("ca")) * mid).cast("int").alias("c"),
                    ((t1 - t0) * full).alias("length_m"))


def polygons_to_cells(polygons: DataFrame, dx: float, x0: float, y0: float) -> DataFrame:
    """Cells touched by each polygon ``(run_id, feature_id, ring ARRAY<STRUCT<x, y>>)``.

    The outline is split like any line; the inside comes from scanlines through the
    cell centres, one interval of columns per pair of crossings.
    """
    n = F.size("ring")
    seg = polygons.withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    p, q = F.get("ring", F.col("_i")), F.get("ring", (F.col("_i") + 1) % n)
    seg = seg.select("run_id", "feature_id", p["x"].alias("xa"), p["y"].alias("ya"), q["x"].alias("xb"), q["y"].alias("yb"))
    rim = segments_to_cells(seg, dx, x0, y0).select("run_id", "feature_id", "r", "c")
    ra, rb = (y0 - F.col("ya")) / dx, (y0 - F.col("yb")) / dx
    lo, hi = F.ceil(F.least(ra, rb) - 0.5).cast("int"), F.ceil(F.greatest(ra, rb) - 0.5).cast("int") - 1
    hit = seg.withColumn("ra", ra).withColumn("rb", rb).where(lo <= hi).withColumn("r", F.explode(F.sequence(lo, hi)))
    x = F.col("xa") + (F.col("xb") - F.col("xa")) * ((F.col("r") + 0.5 - F.col("ra")) / (F.col("rb") - F.col("ra")))
    rows = hit.groupBy("run_id", "feature_id", "r").agg(F.array_sort(F.collect_list((x - x0) / dx)).alias("xs"))
    pair = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))))
    a, b = F.ceil(F.get("xs", F.col("_k")) - 0.5).cast("int"), F.ceil(F.get("xs", F.col("_k") + 1) - 0.5).cast("int") - 1
    inner = pair.where(a <= b).select("run_id", "feature_id", "r", F.explode(F.sequence(a, b)).alias("c"))
    return rim.union(inner).distinct()


def features_in_flood(touched: DataFrame, flood: DataFrame) -> DataFrame:
    """Features of each run with any touched cell flooded, counted once each; a run without one has 0."""
    hit = touched.join(flood.select(*grid.CELL, F.lit(True).alias("wet")).distinct(), grid.CELL, "left")
    return hit.groupBy("run_id").agg(F.count_distinct(F.when(F.col("wet"), F.col("feature_id"))).alias("features"))


def flooded_length(visited: DataFrame, flood: DataFrame) -> DataFrame:
    """Kilometres of each run inside flooded cells; a run without any has 0.

    The pieces are added to the micrometre: a sum does not depend on their order or on where lines were split.
    """
    hit = visited.join(flood.select(*grid.CELL, F.lit(True).alias("wet")).distinct(), grid.CELL, "left")
    return hit.groupBy("run_id").agg((F.sum(F.when(F.col("wet"), F.col("length_m")).otherwise(0.0).cast("decimal(18,6)")).cast("double") / 1000.0).alias("km"))
