"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``(u, v)`` long pairs to ``(node, root)`` for every node but the roots.

    The root is the smallest node of its component.  Each round keeps components and never has more
    links than before; it ends when a round changes nothing, after about log^2 rounds at most.
    Nulls and loops are ignored; an empty table gives an empty one.  A hub costs a partial minimum and
    a join that adaptive execution splits, never a collected group.
    """
    state = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                "links")
    mark = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        state = cut(_small_star(_large_star(state)), "links")
