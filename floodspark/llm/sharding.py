"""Consistent hashing with virtual nodes and bounded loads.

Shards own points on a ring; a key belongs to the first point at or after its hash, and if that shard
is full it goes on clockwise to the next one with room.  The walk is planned on counts per arc (as many
rows as there are points, whatever the input); rows then find their place by their rank on the arc.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodspark.llm.common import whole
from floodspark.session import cut

RING = 1 << 32
POINTS = 128
#: Equal parts of the ring, so that a row finds its arc by an equality join.
SLICES = 1 << 12
#: Parts of an arc that are ranked apart.
CELLS = 512


def _place(*values: Column) -> Column:
    """A place on the ring."""
    return F.shiftrightunsigned(F.xxhash64(*values), 32)


def ring(spark: SparkSession, shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """``(place, shard)`` of every virtual node, clockwise: ``shards * points`` rows."""
    ids = spark.range(shards * points).select(F.expr(f"id div {points}").alias("shard"), F.expr(f"id % {points}").alias("id"))
    rows = ids.select(_place(F.lit("node"), F.col("shard"), F.col("id")).alias("at"), "shard").collect()
    return sorted((r["at"], r["shard"]) for r in rows)


def _arcs(spark: SparkSession, places: Sequence[int]) -> DataFrame:
    """Per slice of the ring the arcs that reach into it: ``slice, ends (list of [end, arc])``."""
    per = RING // SLICES
    rows, k = [], 0
    for s in range(SLICES):
        low, high = s * per, (s + 1) * per - 1
        while k < len(places) and places[k] < low:
            k += 1
        ends, j = [], k
        while j < len(places) and places[j] <= high:
            ends.append((places[j], j))
            j += 1
        ends.append((RING, j % len(places)))
        rows.append((s, ends))
    return spark.createDataFrame(rows, "slice long, ends array<struct<end: long, arc: int>>")


def plan(counts: dict[int, int], points: Sequence[tuple[int, int]], room: Sequence[int]) -> list[tuple]:
    """Where the keys of each arc go: ``(arc, low, high, shard, slot)``, ranks ``low`` to ``high`` (excluded).

    Arcs are taken clockwise.  On each, the shard's own keys come before those that overflowed into it,
    so a key moves only when its own shard is full.  Pure arithmetic on as many numbers as points.
    """
    left, used, out = list(room), [0] * len(room), []
    waiting: list[tuple[int, int, int]] = []

    def put(arc: int, low: int, high: int, shard: int) -> int:
        """Places what fits and returns the first rank that doesn't."""
        n = min(high - low, left[shard])
        if n > 0:
            out.append((arc, low, low + n, shard, used[shard]))
            left[shard] -= n
            used[shard] += n
        return low + max(n, 0)

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        at = put(arc, 0, n, shard)
        if at < n:
            waiting.append((arc, at, n))
    for arc, low, high in waiting:  # clockwise from each full arc
        step = 1
        while low < high:
            low = put(arc, low, high, points[(arc + step) % len(points)][1])
            step += 1
    return out


def assign(rows: DataFrame, key: Sequence[str], shards: int, points: int = POINTS, slack: float = 0.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    With ``slack`` zero the shards' capacities are the total divided with the remainder spread, so
    counts differ by one at most; with slack, each holds up to ``(1 + slack)`` times the mean and fewer
    keys move.  ``rows`` must be cheap to read twice (a written table).  Null keys are keys like any
    other; equal rows are ranked among themselves; an empty table stays empty.  A key that fills a
    large part of the table is one place of the ring: its rows are ranked by cells of ``salt``.
    """
    spark = rows.sparkSession
    nodes = ring(spark, shards, points)
    at = _place(*[F.col(k) for k in key])
    placed = rows.withColumn("_at", at).withColumn("_slice", F.expr(f"_at div {RING // SLICES}"))
    arcs = F.broadcast(_arcs(spark, [p for p, _ in nodes]))  # SLICES rows and shards * points ends
    placed = placed.join(arcs, placed["_slice"] == arcs["slice"]).withColumn(
        "_arc", F.filter("ends", lambda e: e["end"] >= F.col("_at"))[0]["arc"]).drop("slice", "ends", "_slice")
    sized = placed.groupBy("_arc", "_cell").agg(F.count("*").alias("n"))
    sized = cut(sized, "arcs")
    counts = {r["_arc"]: r["n"] for r in sized.groupBy("_arc").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    even = [total // shards + (s < total % shards) for s in range(shards)]
    room = even if not slack else [int(-(-total * (1 + slack) // shards))] * shards
    steps = spark.createDataFrame(plan(counts, nodes, room) or [(-1, 0, 0, 0, 0)],
                                  "_arc int, low long, high long, shard int, base long")
    prior = F.sum("n").over(Window.partitionBy("_arc").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = sized.select("_arc", "_cell", F.coalesce(prior, F.lit(0)).alias("_start"))
    order = [c for c in rows.columns if c != "_cell"]
    ranked = placed.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_arc", "_cell").orderBy("_at", *order)) - 1)
    ranked = ranked.join(starts, ["_arc", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    steps = F.broadcast(steps)  # at most two rows a point and a shard
    found = ranked.join(steps, (ranked["_arc"] == steps["_arc"]) & (F.col("_rank") >= F.col("low")) &
                        (F.col("_rank") < F.col("high")))
    return found.select(*order, F.col("shard"), (F.col("base") + F.col("_rank") - F.col("low")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, points: int = POINTS, slack: float = 0.0,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row; the key on the ring is ``doc_id``.

    Size is the UTF-8 bytes plus one, a null text has none.  What stays per document is four numbers,
    written once with the cell that ranks it; texts are read once and never moved.
    """
    body = whole(text)
    salt = F.pmod(F.xxhash64(F.lit("cell"), F.col(doc_id), F.monotonically_increasing_id()), F.lit(CELLS)).cast("int")
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                           F.crc32(body.cast("binary")).alias("text_crc32"), salt.alias("_cell")), "shards")
    return assign(rows, ["doc_id"], shards, points, slack)
