"""Registry of runnable queries and the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.operators import exposure
from floodspark.operators.accumulate import field_accumulator
from floodspark.sources.tables import VIEWS, setup_columns, view

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

# derived tables of the SQL side: name -> (needs, text)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "pop": (("pop_raw",), "SELECT r, CAST(c_ AS INT) AS c, pop FROM pop_raw"),
    "frames_v": (("frames",), """
        SELECT *, sqrt(u * u + v * v) AS speed FROM (
          SELECT *, CASE WHEN den <= 0 THEN 0 ELSE 2.0 * h * hu / den END AS u,
                    CASE WHEN den <= 0 THEN 0 ELSE 2.0 * h * hv / den END AS v
          FROM (SELECT *, h * h + greatest(h * h, CAST(0.000001 AS DOUBLE)) AS den FROM frames))"""),
    "cells": (("frames_v",), """
        SELECT run_id, r, c, max(h) AS max_depth,
               coalesce(max(CASE WHEN h > 0.001 THEN speed END), 0) AS max_speed,
               coalesce(max(CASE WHEN h > 0.001 THEN h * speed END), 0) AS max_dv,
               min(CASE WHEN h >= 0.1 THEN t_s END) AS arrival_s, r < 4 AS initially_wet
        FROM frames_v GROUP BY run_id, r, c"""),
    "cells_h": (("cells", "pop"), """
        SELECT k.*, CASE WHEN dry THEN -1 WHEN rating < 0.75 THEN 0 WHEN rating < 1.25 THEN 1
                         WHEN rating < 2.5 THEN 2 ELSE 3 END AS defra_class,
               CASE WHEN dry THEN -1
                    WHEN max_dv <= 0.3 AND max_depth <= 0.3 AND max_speed <= 2 THEN 0
                    WHEN max_dv <= 0.6 AND max_depth <= 0.5 AND max_speed <= 2 THEN 1
                    WHEN max_dv <= 0.6 AND max_depth <= 1.2 AND max_speed <= 2 THEN 2
                    WHEN max_dv <= 1.0 AND max_depth <= 2.0 AND max_speed <= 2 THEN 3
                    WHEN max_dv <= 4.0 AND max_depth <= 4.0 AND max_speed <= 4 THEN 4 ELSE 5 END AS aidr_class,
               CASE WHEN initially_wet THEN -2 WHEN arrival_s IS NULL THEN -1 WHEN arrival_s / 60.0 < 15 THEN 0
                    WHEN arrival_s / 60.0 < 30 THEN 1 WHEN arrival_s / 60.0 < 60 THEN 2
                    WHEN arrival_s / 60.0 < 120 THEN 3 ELSE 4 END AS band,
               arrival_s / 60.0 AS arrival_min, NOT dry AS flood, NOT dry AND NOT initially_wet AS new_flood,
               arrival_s IS NOT NULL AND NOT initially_wet AS newly_flooded, coalesce(p.pop, 0.0) AS pop
        FROM (SELECT *, max_depth < 0.1 AS dry,
                     CASE WHEN max_depth < 0.1 THEN 0.0 ELSE max_dv + 0.5 * max_depth
                       + CASE WHEN max_depth >= 0.75 OR max_speed > 2 THEN 1.0 WHEN max_depth >= 0.25 THEN 1.0
                         ELSE 0.0 END END AS rating
              FROM cells) k LEFT JOIN pop p USING (r, c)"""),
    "poi_c": (("poi",), """
        SELECT *, NOT (pr BETWEEN 0 AND 63 AND pc BETWEEN 0 AND 63) AS outside,
               CASE WHEN pr BETWEEN 0 AND 63 AND pc BETWEEN 0 AND 63 THEN pr END AS r,
               CASE WHEN pr BETWEEN 0 AND 63 AND pc BETWEEN 0 AND 63 THEN pc END AS c
        FROM (SELECT *, CAST(floor((5760 - y) / 90) AS INT) AS pr, CAST(floor(x / 90) AS INT) AS pc FROM poi)"""),
    "risk": (("poi_c", "cells_h"), """
        SELECT p.run_id, p.poi_id, coalesce(p.name, 'unnamed_' || p.poi_id) AS name,
               CASE WHEN new_flood AND arrival_min IS NOT NULL THEN round_even(arrival_min, 1) ELSE -1.0 END AS arr_min,
               coalesce(new_flood, false) AS flooded,
               CASE WHEN new_flood THEN round_even(max_depth, 2) ELSE 0.0 END AS depth_m,
               CASE WHEN new_flood THEN round_even(max_speed, 2) ELSE 0.0 END AS speed_ms,
               CASE WHEN new_flood THEN defra_class ELSE -1 END AS haz_class,
               CASE WHEN new_flood THEN band ELSE -1 END AS band, population AS pop, outside
        FROM poi_c p LEFT JOIN cells_h USING (run_id, r, c)"""),
    "hz": ((), "SELECT * FROM (VALUES (0, 'Low'), (1, 'Moderate'), (2, 'Significant'), (3, 'Extreme')) AS t(idx, label)"),
    "aidr": ((), "SELECT * FROM (VALUES (0,'H1'),(1,'H2'),(2,'H3'),(3,'H4'),(4,'H5'),(5,'H6')) AS t(idx, label)"),
    "bd": ((), """SELECT * FROM (VALUES (0, '0-15 min'), (1, '15-30 min'), (2, '30-60 min'), (3, '60-120 min'),
              (4, '>120 min')) AS t(idx, label)"""),
    "runs": (("cells",), "SELECT DISTINCT run_id FROM cells"),
    "flow": (("dem",), """
        SELECT *, CASE WHEN dir IS NULL THEN NULL ELSE r + [0,1,1,1,0,-1,-1,-1][dir + 1] END AS down_r,
               CASE WHEN dir IS NULL THEN NULL ELSE c + [1,1,0,-1,-1,-1,0,1][dir + 1] END AS down_c
        FROM (SELECT d.run_id, d.r, d.c, any_value(d.z) AS z,
                     CASE WHEN count(n.z) = 8 AND max((d.z - n.z) / o.dist) > 0
                          THEN arg_min(o.k, struct_pack(s := -(d.z - n.z) / o.dist, k := o.k)) END AS dir
              FROM dem d CROSS JOIN (VALUES (0,0,1,90.0::DOUBLE),(1,1,1,90.0::DOUBLE*sqrt(2.0)),(2,1,0,90.0::DOUBLE),
                (3,1,-1,90.0::DOUBLE*sqrt(2.0)),(4,0,-1,90.0::DOUBLE),(5,-1,-1,90.0::DOUBLE*sqrt(2.0)),(6,-1,0,90.0::DOUBLE),
                (7,-1,1,90.0::DOUBLE*sqrt(2.0))) AS o(k, dr, dc, dist)
              LEFT JOIN dem n ON n.run_id = d.run_id AND n.r = d.r + o.dr AND n.c = d.c + o.dc
              GROUP BY d.run_id, d.r, d.c)"""),
    "acc": (("flow",), """
        SELECT run_id, r, c, CAST(count(*) AS DOUBLE) AS acc FROM (
          WITH RECURSIVE walk AS (
            SELECT run_id, r, c, down_r, down_c FROM flow
            UNION ALL
            SELECT f.run_id, f.r, f.c, f.down_r, f.down_c FROM walk w JOIN flow f
              ON f.run_id = w.run_id AND f.r = w.down_r AND f.c = w.down_c)
          SELECT run_id, r, c FROM walk) GROUP BY run_id, r, c"""),
    "drain": (("flow", "acc"), """
        SELECT f.*, a.acc, a.acc * 8100.0 / 1e6 AS area_km2, a.acc >= 0.08 * 1e6 / 8100.0 AS stream
        FROM flow f JOIN acc a USING (run_id, r, c)"""),
}


def oracle(final: str, needs: tuple[str, ...]) -> str:
    """One WITH statement holding just the views a query needs, in dependency order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name in DERIVED:
            deps, text = DERIVED[name]
            for d in deps:
                add(d)
            done[name] = text
        else:
            key = "pop" if name == "pop_raw" else name
            done[name] = VIEWS[key].format_map({t: t for t in TABLES})

    for n in needs:
        add(n)
    head = ", ".join(f"{n} AS ({t})" for n, t in done.items())
    return _doubles(f"WITH {head} {final}" if head else final)


def _doubles(sql: str) -> str:
    """Write decimal literals as doubles, outside quoted text: results then hold no DECIMAL."""
    parts = sql.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in parts[::2]]
    return "'".join(parts)


def query(name: str, ids: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register ``name``; ``ids`` are the rows of the operator inventory it covers."""
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(ids, fn, None if sql is None else oracle(sql, needs))
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def cells(spark: SparkSession, d: str) -> DataFrame:
    return setup_columns(field_accumulator(view(spark, d, "frames")))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return exposure.enrich(cells(spark, d), view(spark, d, "pop"))
