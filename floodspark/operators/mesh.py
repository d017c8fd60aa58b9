"""Quad meshes of grids and face-value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(sizes: DataFrame, dx: float, x0: float, y_top: float) -> DataFrame:
    n = (sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny")))).repartition("run_id", "j")
              .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx")))))
    return n.select("run_id", (F.col("j").cast("long") * (F.col("nx") + 1) + F.col("i")).alias("node_id"),
                    (x0 + F.col("i") * dx).alias("x"), (y_top - F.col("j") * dx).alias("y"))


def faces(cells: DataFrame, sizes: DataFrame, dx: float, x0: float, y_top: float) -> DataFrame:
    """One quad per cell, wound counter-clockwise: SW, SE, NE, NW."""
    w = F.col("nx") + 1
    r, c = F.col("r").cast("long"), F.col("c")
    return cells.join(sizes, "run_id").select(
        "run_id", (r * F.col("nx") + c).alias("face_id"),
        F.array((r + 1) * w + c, (r + 1) * w + c + 1, r * w + c + 1, r * w + c).alias("node_ids"),
        (x0 + (c + 0.5) * dx).alias("x"), (y_top - (F.col("r") + 0.5) * dx).alias("y"), "z")


def mesh_quality(face: DataFrame, node: DataFrame) -> DataFrame:
    """Index range, winding and bed checks per run; faces meet nodes by an equi-join."""
    n = node.groupBy("run_id").agg(F.count("*").alias("n_nodes"))
    f = face.select("run_id", "face_id", "z", F.posexplode("node_ids").alias("k", "node_id"))
    # the nodes are many times the sizes they come from, by which the planner would broadcast them
    xy = f.join(node.hint("merge"), ["run_id", "node_id"], "left").groupBy("run_id", "face_id").agg(
        F.max("z").alias("z"), F.count("x").alias("found"), F.min("node_id").alias("lo"), F.max("node_id").alias("hi"),
        F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("p"))
    twice = F.lit(0.0)
    for k in range(4):
        a, b = F.get("p", F.lit(k)), F.get("p", F.lit((k + 1) % 4))
        twice = twice + a["x"] * b["y"] - b["x"] * a["y"]
    return xy.withColumn("twice", twice).join(n, "run_id").groupBy("run_id").agg(
        F.bool_and((F.col("lo") >= 0) & (F.col("hi") < F.col("n_nodes"))).alias("indices_in_range"),
        F.bool_and(F.col("twice") > 0).alias("faces_ccw"),
        F.bool_and(F.col("z").isNotNull()).alias("bed_finite"),
        F.count("*").alias("n_faces"), F.max("n_nodes").alias("n_nodes"))


# fixed values: the names, or parts of names, by which map files call a quantity, in order of preference
MAP_NAMES = {
    "depth": ("mesh2d_waterdepth", "waterdepth", "water_depth"),
    "wl": ("mesh2d_s1", "s1", "waterlevel"),
    "bed": ("mesh2d_bl", "bedlevel", "bl"),
}


def read_map(frames: DataFrame) -> DataFrame:
    """Map output as ``face_id, t_s`` and those of ``depth, wl, bed`` that it has, whatever it calls them.

    The first listed part of a name that any column has decides; a quantity without one is absent from the result.
    """
    found = {}
    for quantity, parts in MAP_NAMES.items():
        hits = [c for part in parts for c in frames.columns if part in c.lower()]
        if hits:
            found[quantity] = F.col(hits[0]).cast("double").alias(quantity)
    return frames.select("face_id", "t_s", *found.values())


def face_maxima(frames: DataFrame) -> DataFrame:
    """Per face the largest depth and level, the bed and the times, as far as there are such columns."""
    have = {"depth": F.max("depth").alias("max_depth"), "wl": F.max("wl").alias("max_wl"), "bed": F.min("bed").alias("bed")}
    return frames.groupBy("face_id").agg(*[v for k, v in have.items() if k in frames.columns], F.count("*").alias("times"))
