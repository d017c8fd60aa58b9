"""Benchmark decontamination with DataFrame functions only.

Every window of a document as long as an item that could be similar to it, by the count of shingles they share, gets a
SimHash.  A multi-index over blocks of the fingerprint finds every item of that length within the radius; the weighted
overlap of the shingles then decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import BROADCAST_ROWS, WORD, bounded, whole
from floodspark.llm.spans import matches
from floodspark.session import cut

SHINGLE = 5
SIMILAR = 0.8
#: Within BLOCKS * (REACH + 1) - 1 bits, some block differs in at most REACH.  Fingerprints of shingle sets that
#: overlap by 0.8 differ in 10 of 64 bits on average, with a deviation of 3: the radius has all of them.
BLOCKS, REACH = 8, 2
RADIUS = BLOCKS * (REACH + 1) - 1
WIDTH = 64 // BLOCKS
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in lower case (A-Z only)."""
    return F.translate(text, CAPITALS, SMALL)


def shingled(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Adds ``n`` (words) and ``h`` (a hash per shingle; one of all words if they are fewer) to rows with ``t``."""
    parts = ", ".join(f"get(w, i + {k})" for k in range(size))
    return (rows.withColumn("w", matches("t", WORD))
            .withColumn("n", F.size("w"))
            .withColumn("h", F.expr(f"IF(n = 0, CAST(array() AS array<bigint>), "
                                    f"transform(sequence(0, greatest(n - {size}, 0)), i -> xxhash64({parts})))")).drop("w"))


def simhash(h: str) -> str:
    """SQL: bit b is set if more than half of the hashes in ``h`` have it."""
    return (f"aggregate(sequence(0, 63), 0L, (acc, b) -> IF(2 * size(filter({h}, x -> (shiftrightunsigned(x, b) & 1L) = 1L))"
            f" > size({h}), acc | shiftleft(1L, b), acc))")


def weighted(h: str) -> str:
    """SQL: the k-th occurrence of a shingle as an element of its own: set overlap then weighs by count."""
    return f"transform({h}, (x, i) -> xxhash64(x, size(filter(slice({h}, 1, i + 1), y -> y = x))))"


def block(fp: str, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, n, h, y (h weighted by count), fp`` of every item with a word."""
    rows = shingled(benchmark.select(F.col(item_id).alias("item_id"), words(whole(text)).alias("t"))).where("n > 0")
    return rows.select("item_id", "n", "h", F.expr(weighted("h")).alias("y"), F.expr(simhash("h")).alias("fp"))


def windows(docs: DataFrame, bench: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, body (hash of the text), start, size, h``: item-sized windows that hold enough of an item's shingles.

    A window and an item that overlap by ``similar`` share at least that part of ``(1 + similar)`` of their shingles
    together; every start at which a window has so many of an item's is listed.  A shorter document is one window.
    Items of fewer than ``SHINGLE`` words are looked for word by word: a window is one shingle then.  Only places of
    shared shingles are gathered; texts are read again where there are any.
    """
    body = whole(text)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("body"), words(body).alias("t"))
    small = [r["n"] for r in bench.where(F.col("n") < SHINGLE).select("n").distinct().collect()]  # at most four sizes
    parts, found = [], []
    for k in [*small, SHINGLE]:
        mine = bench.where(F.col("n") == k if k < SHINGLE else F.col("n") >= SHINGLE)
        at = cut(mine.select("item_id", F.col("n").alias("size"), F.explode("h").alias("hash")).distinct(), "shingles")
        known = bounded(at, at.count())
        # The outer form keeps the optimiser from testing the array's size, which would compute the words anew.
        each = shingled(texts, k).select("doc_id", "body", "n", F.posexplode_outer("h").alias("p", "hash"))
        parts.append(each.join(known, "hash").drop("hash").withColumn("k", F.lit(k)))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    per = hits.groupBy("doc_id", "body", "item_id", "n", "size", "k").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    per = per.withColumn("all_", F.col("size") - F.col("k") + 1).withColumn(
        "here", F.least("all_", F.col("n") - F.col("k") + 1))
    least = F.ceil(F.lit(similar) * (F.col("all_") + F.col("here")) / (1 + similar) - 1e-9).cast("int")
    per = per.withColumn("m", F.greatest(least, F.lit(1))).where((F.size("ps") >= F.col("m")) & (F.col("here") > 0))
    starts = F.expr("""flatten(transform(
        filter(sequence(0, size(ps) - m), i -> get(ps, i + m - 1) - get(ps, i) < here),
        i -> sequence(greatest(get(ps, i + m - 1) - here + 1, 0), least(get(ps, i), greatest(n - size, 0)))))""")
    places = cut(per.select("doc_id", "body", "size", "k", F.explode(starts).alias("start")).distinct(), "places")
    n = places.count()
    lists = places.groupBy(F.col("doc_id").alias("_d"), F.col("body").alias("_b"), "k").agg(
        F.collect_list(F.struct("start", "size")).alias("at"))  # of one document
    for k in [*small, SHINGLE]:
        wanted = bounded(lists.where(F.col("k") == k), n)
        here = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body") == F.col("_b"))).drop("_d", "_b", "k")
        cut_out = shingled(here, k).select("doc_id", "body", "h", F.explode("at").alias("at"))
        found.append(cut_out.select("doc_id", "body", "at.start", "at.size", F.slice(
            "h", F.col("at.start") + 1, F.greatest(F.col("at.size") - k + 1, F.lit(1))).alias("h")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, body, item_id, start, n_words, similarity``: each item a document holds, at its best window.

    Similarity is the overlap of the five-word shingles weighted by their counts (of all words, for items of fewer); all
    windows as long as the item count, ties go to the first.  Null and blank texts hold nothing and are held by nothing;
    repeated rows give one result; documents without an item have no row; either table may be empty.
    """
    bench = cut(items(benchmark, item_id, item_text), "items")
    known = bench.count()
    found = windows(docs, bench, similar, doc_id, text)
    found = cut(found.select("doc_id", "body", "start", "size", F.expr(simhash("h")).alias("fp"),
                             F.expr(weighted("h")).alias("y")), "windows")
    flips = [sum(1 << b for b in bits) for r in range(REACH + 1) for bits in combinations(range(WIDTH), r)]
    near = F.explode(F.array(*[F.lit(x) for x in flips]))
    probes = bench.select("item_id", F.col("n").alias("size"), F.col("fp").alias("item_fp"),
                          F.posexplode(F.array(*[block("fp", b) for b in range(BLOCKS)])).alias("block", "value"))
    probes = probes.select("item_id", "size", "item_fp", "block", "value", near.alias("flip")).withColumn(
        "value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    probes = bounded(probes, known * BLOCKS * len(flips))
    # fingerprints meet without the shingles, which are fetched for the pairs that remain
    blocks = F.posexplode(F.array(*[block("fp", b) for b in range(BLOCKS)])).alias("block", "value")
    key = ["doc_id", "body", "start", "size"]
    met = found.select(*key, "fp", blocks).join(probes, ["size", "block", "value"])
    # the pair is kept at the first block that joins it, so nothing has to be made distinct
    first = F.lit(False)
    earlier = [F.bit_count(block("fp", b).bitwiseXOR(block("item_fp", b))) <= REACH for b in range(BLOCKS)]
    for b in reversed(range(BLOCKS)):
        first = F.when(earlier[b], F.col("block") == b).otherwise(first)
    met = met.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & first)
    met = met.select(F.col("doc_id").alias("_d"), F.col("body").alias("_b"), F.col("start").alias("_s"), F.col("size").alias("_n"), "item_id")
    same = (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body") == F.col("_b")) & (F.col("start") == F.col("_s"))
            & (F.col("size") == F.col("_n")))
    theirs = bounded(bench.select(F.col("item_id").alias("_i"), F.col("y").alias("item_y")), known, BROADCAST_ROWS // 100)
    pairs = met.join(found.select(*key, "y"), same).join(theirs, F.col("item_id").eqNullSafe(F.col("_i")))
    scored = pairs.withColumn("shared", F.size(F.array_intersect("y", "item_y"))).withColumn(
        "similarity", F.col("shared") / (F.size("y") + F.size("item_y") - F.col("shared")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"))).alias("best")
    out = (scored.where(F.col("similarity") >= similar)
           .groupBy("doc_id", "body", "item_id").agg(best, F.first("size").alias("size")))
    return out.select("doc_id", "body", "item_id", (-F.col("best.at")).cast("long").alias("start"),
                      F.col("size").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, that hold no item of ``benchmark``."""
    found = cut(contaminated(docs, benchmark, similar, doc_id, text).select(
        F.col("doc_id").alias("_d"), F.col("body").alias("_b")).distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_i"), F.xxhash64(whole(text)).alias("_t"))
    return rows.join(bounded(found, found.count()), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_b")),
                     "left_anti").select("_row.*")
