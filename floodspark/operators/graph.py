"""Forests and label graphs as DataFrames: pointer jumping and contraction.

One way for graphs of every size: each loop works on a table that shrinks or whose unfinished part
shrinks, stops on an emptiness test, and cuts its lineage through the shared folder each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.session import cut


def resolve_roots(parents: DataFrame) -> DataFrame:
    """``(run_id, a, p)`` to ``(run_id, a, root)`` by pointer jumping.

    A root points at itself; a pointer that has no row of its own counts as a root.  Settled rows
    leave, so a popular root is joined once only.
    """
    settled = []
    live = cut(parents.select("run_id", "a", "p"), "roots")
    while True:
        up = live.select("run_id", F.col("a").alias("p"), F.col("p").alias("pp"))
        step = cut(live.join(up, ["run_id", "p"], "left"), "roots")
        done = F.col("pp").isNull() | (F.col("pp") == F.col("p")) | (F.col("p") == F.col("a"))
        settled.append(step.where(done).select("run_id", "a", F.col("p").alias("root")))
        rest = step.where(~done).select("run_id", "a", F.col("pp").alias("p"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        known = reduce(DataFrame.unionByName, settled).select(
            "run_id", F.col("a").alias("p"), F.col("root"))
        jumped = rest.join(known, ["run_id", "p"], "left").select(
            "run_id", "a", F.coalesce("root", "p").alias("p"), F.col("root").isNotNull().alias("fin"))
        jumped = cut(jumped, "roots")
        settled.append(jumped.where("fin").select("run_id", "a", F.col("p").alias("root")))
        live = jumped.where(~F.col("fin")).select("run_id", "a", "p")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, settled)


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph ``(run_id, a, b)`` as ``(run_id, node, root)``.

    By contraction: every node hooks to its smallest neighbour, hooks are followed to
    their roots, and the edges are relabelled; edges inside a component vanish, so a
    giant component costs less every round instead of becoming a hot key.
    """
    e = edges.where("a <> b")
    e = cut(e.select("run_id", "a", "b").union(e.select("run_id", "b", "a")).distinct(), "graph")
    rounds = []
    while not e.isEmpty():
        hook = e.groupBy("run_id", "a").agg(F.least(F.first("a"), F.min("b")).alias("p"))
        roots = cut(resolve_roots(hook), "graph")
        rounds.append(roots)
        to = roots.select("run_id", "a", F.col("root").alias("ra"))
        e = (e.join(to, ["run_id", "a"])
              .join(to.select("run_id", F.col("a").alias("b"), F.col("ra").alias("rb")),
                    ["run_id", "b"])
              .where("ra <> rb").select("run_id", F.col("ra").alias("a"), F.col("rb").alias("b"))
              .distinct())
        e = cut(e, "graph")
    if not rounds:
        return edges.select("run_id", F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    out = rounds[0].select("run_id", F.col("a").alias("node"), "root")
    for nxt in rounds[1:]:
        out = (out.join(nxt.select("run_id", F.col("a").alias("root"), F.col("root").alias("up")),
                        ["run_id", "root"], "left")
                  .select("run_id", "node", F.coalesce("up", "root").alias("root")))
    return out


def forest_sums(nodes: DataFrame) -> DataFrame:
    """Subtree sums of a forest ``(run_id, a, p, v)`` (``p`` NULL at a root).

    By path doubling: after k rounds a node holds the sum over descendants closer
    than 2^k, so the rounds are the logarithm of the depth.
    """
    cur = cut(nodes.select("run_id", "a", "p", "v"), "forest")
    while True:
        live = cur.where("p IS NOT NULL")
        if live.isEmpty():
            return cur.select("run_id", "a", "v")
        gain = live.groupBy("run_id", F.col("p").alias("a")).agg(F.sum("v").alias("g"))
        up = cur.where("p IS NOT NULL").select("run_id", F.col("a").alias("p"), F.col("p").alias("pp"))
        cur = (cur.join(gain, ["run_id", "a"], "left")
                  .join(up, ["run_id", "p"], "left")
                  .select("run_id", "a", F.col("pp").alias("p"),
                          (F.col("v") + F.coalesce("g", F.lit(0.0))).alias("v")))
        cur = cut(cur, "forest")
