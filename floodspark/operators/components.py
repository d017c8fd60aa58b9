"""Connected components on cell masks, tile by tile and then across tile borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import grid
from floodspark.operators.rims import WIDE, least_connected, united_labels
from floodspark.session import cut


def cell_id(r="r", c="c") -> Column:
    return F.col(r).cast("long") * WIDE + F.col(c).cast("long")


def _label_block(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Smallest flat index of each cell's component in one block (runs, then unions)."""
    ny, nx = mask.shape
    start = mask.copy()
    start[:, 1:] &= ~mask[:, :-1]
    run = np.where(mask, np.cumsum(start.ravel()).reshape(ny, nx), 0)
    pairs = []
    for shift in ((-1, 0, 1) if diagonal else (0,)):
        lo, hi = max(0, -shift), nx - max(0, shift)
        up, down = run[:-1, lo:hi], run[1:, lo + shift:hi + shift]
        both = (up > 0) & (down > 0)
        pairs.append(np.column_stack([up[both], down[both]]))
    pairs = np.unique(np.vstack(pairs), axis=0) if pairs else np.empty((0, 2), int)
    parent = least_connected(int(run.max(initial=0)) + 1, pairs)
    first = np.flatnonzero(start.ravel())           # run k starts at first[k-1]
    root = parent[run]
    return np.where(mask, first[np.maximum(root, 1) - 1] if len(first) else 0, -1)


def components(cells: DataFrame, mask: str, diagonal: bool = False,
               tile: int = grid.DEFAULT_TILE) -> DataFrame:
    """Masked cells with ``piece`` (their part inside one tile) and ``component``.

    A component's id is its smallest cell id.  ``piece`` never spans tiles, so it
    stays a bounded join key even when one component holds most of the cells.
    """
    kept = grid.with_tile(cells.where(F.col(mask)).select(*grid.CELL), tile)

    def label(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        rr, cc = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        block = np.zeros((rr.max() + 1, cc.max() + 1), dtype=bool)
        block[rr, cc] = True
        flat = _label_block(block, diagonal)[rr, cc].astype(np.int64)
        nx = block.shape[1]
        piece = (flat // nx + r0) * WIDE + (flat % nx + c0)
        return pd.DataFrame({"run_id": pdf["run_id"], "r": pdf["r"], "c": pdf["c"], "piece": piece})

    run_type = cells.schema["run_id"].dataType.simpleString()
    pieces = cut(kept.groupBy("run_id", "tr", "tc").applyInPandas(
        label, f"run_id {run_type}, r int, c int, piece long"), "pieces")

    rim = grid.with_tile(pieces.where((F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1)), tile)
    roots = united_labels(rim.select("run_id", "tr", "tc", cell_id().alias("a"), F.col("piece").alias("label")), tile, run_type, diagonal)
    return pieces.join(roots.withColumnRenamed("label", "piece"), ["run_id", "piece"], "left").select(
        *grid.CELL, "piece", F.coalesce("root", "piece").alias("component"))


def per_component(labelled: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregate over each component (one row per ``run_id, component``)."""
    return labelled.groupBy("run_id", "component").agg(*[v.alias(k) for k, v in aggs.items()])


def home_verdict(ledger: DataFrame, labelled: DataFrame, points: DataFrame, most: float = 0.02) -> DataFrame:
    """Per run whether one component holds the water: the component of the masked cell nearest its point.

    ``ledger`` is ``run_id, component, volume``, ``points`` a cell ``(run_id, r, c)`` per run; ties of distance go to
    the smaller row, then column.  ``stray`` is the share of the volume in all other components; above ``most`` the
    mask leaks.
    """
    p = points.select("run_id", F.col("r").alias("_r"), F.col("c").alias("_c"))
    d2 = (F.col("r") - F.col("_r")) ** 2 + (F.col("c") - F.col("_c")) ** 2
    near = labelled.join(p, "run_id").groupBy("run_id").agg(F.min(F.struct(d2.alias("d2"), "r", "c", "component")).alias("m"))
    own = near.select("run_id", F.col("m.component").alias("home"))
    total = ledger.join(own, "run_id").groupBy("run_id", "home").agg(
        F.sum("volume").alias("total"), F.sum(F.when(F.col("component") == F.col("home"), F.col("volume")).otherwise(0.0)).alias("home_volume"))
    stray = F.when(F.col("total") > 0, 1.0 - F.col("home_volume") / F.col("total")).otherwise(0.0)
    return total.withColumn("stray", stray).withColumn("leaks", F.col("stray") > most)


def attach(labelled: DataFrame, facts: DataFrame) -> DataFrame:
    """Join per-component facts to cells through their pieces, which stay small keys."""
    by_piece = (labelled.select("run_id", "piece", "component").distinct()
                        .join(facts, ["run_id", "component"]).drop("component"))
    return labelled.join(by_piece, ["run_id", "piece"])


def component_sizes(labelled: DataFrame) -> DataFrame:
    return per_component(labelled, size=F.count("*"))


def drop_small(labelled: DataFrame, least: int) -> DataFrame:
    """Cells of components with at least ``least`` cells."""
    big = component_sizes(labelled).where(F.col("size") >= least)
    return attach(labelled, big)
