"""Near duplicates by the overlap of word shingles: MinHash bands find candidates, the sets decide.

Texts whose sets of five-word shingles overlap by 0.8 have equal values in one of ``BANDS`` bands of ``ROWS`` with a
probability of 1 - (1 - 0.8 ** ROWS) ** BANDS: one such pair in 7 million meets nowhere.  A band's value is a
bucket, cut into tiles; pairs of tiles are compared in a task, set by set, so no bucket has to fit into one.
Bands come in rounds, and a bucket is left out once all of it is connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm import simhash
from floodspark.llm.common import bounded, whole
from floodspark.llm.components import connected
from floodspark.session import cut

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 30, 4
#: First band of each round (and the end).
ROUNDS = (0, 6, BANDS)
TILE = 512
SEED = 42
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
FACTORS = np.random.default_rng(80).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text; of all its words if they are fewer.

    A-Z is lower-cased; a text without words has none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in words], np.uint64)
    width = min(shingle, len(words))
    grams = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        grams = grams * ODD + hashes[k:k + len(grams)]
    return np.unique(_mixed(grams))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A value for each band: the least products of a set with the factors of the band, mixed."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[None, at:at + (1 << 12)] * FACTORS[:, None]).min(1), out=least)
    out = np.arange(BANDS).astype(np.uint64)
    for k in range(ROWS):
        out = _mixed(out * ODD + least.reshape(BANDS, ROWS)[:, k])
    return out.view(np.int64)


def _sketch(text: Column) -> Column:
    """``node`` (the hash of a text's set) and ``bands`` (none without words)."""
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = shingle_set(t)
            node = np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)
            out.append((node, bands(hashes) if len(hashes) else np.zeros(0, np.int64)))
        return pd.DataFrame(out, columns=["node", "bands"])

    return F.pandas_udf(sketch, "node long, bands array<long>")(text)


def _sets(text: Column) -> Column:
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view(np.int64) for t in texts], dtype=object)

    return F.pandas_udf(sets, "array<long>")(text)


def _linked(values: np.ndarray, lengths: np.ndarray, side: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the pairs of sets that overlap by ``similar``: between the two sides, or within a single one.

    What a set reaches is not compared again, so sets that are all alike are compared with the first only.
    """
    n = len(lengths)
    codes = np.unique(values, return_inverse=True)[1]
    begins = np.cumsum(lengths) - lengths
    marked = np.zeros(len(values), bool)
    single = side.min() == side.max()
    fresh, us, vs = np.ones(n, bool), [], []
    for first in range(n):
        if not fresh[first]:
            continue
        fresh[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            open_ = fresh if single else fresh & (side != side[x])
            if not open_.any():
                continue
            own = codes[begins[x]:begins[x] + lengths[x]]
            marked[own] = True
            shared = np.add.reduceat(marked[codes], begins, dtype=np.int64)
            marked[own] = False
            met = np.flatnonzero(open_ & (shared >= similar * (lengths + lengths[x] - shared) - 1e-9))
            fresh[met] = False
            us += met.tolist()
            vs += [x] * len(met)
            queue += met.tolist()
    return np.array(us, np.int64), np.array(vs, np.int64)


def _verified(similar: float):
    """Links within each group of ``bucket, i, j`` (rows sorted by them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        current = None

        def solve() -> pa.RecordBatch:
            side, node, lengths, values = (np.concatenate(x) for x in zip(*held))
            held.clear()
            u, v = _linked(values, lengths, side, similar)
            return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]])
            side, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns[3:5])
            lists = batch.column(5)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lengths))
            edges = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys)).tolist()
            for a, b in zip(edges, edges[1:]):
                key = tuple(keys[a].tolist())
                if held and key != current:
                    yield solve()
                current = key
                held.append((side[a:b], node[a:b], lengths[a:b], values[ends[a]:ends[b]]))
        if held:
            yield solve()
    return run


def overlap_links(marked: DataFrame, docs: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id",
                  text: str = "text", tile: int = TILE) -> DataFrame:
    """``(u, v)`` nodes (sets) that connect just what overlaps of at least ``similar`` connect.

    ``marked`` has ``doc_id, body, node, bands`` of the rows of ``docs``.
    """
    one = F.min(F.struct("body", "doc_id", "bands")).alias("at")
    nodes = cut(marked.where(F.size("bands") > 0).groupBy("node").agg(one), "sets")
    banded = nodes.select("node", F.posexplode("at.bands").alias("band", "bucket"))
    live = cut(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "live")
    banded = cut(banded.join(bounded(live, live.count()), "bucket"), "banded")
    wanted = nodes.join(banded.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("at.body").alias("_b"), F.col("at.doc_id").alias("_d"))
    wanted = cut(wanted, "wanted")
    rows = docs.select(F.col(doc_id).cast("long").alias("_i"), F.xxhash64(whole(text)).alias("_t"), whole(text).alias("_x"))
    met = rows.join(bounded(wanted, wanted.count()), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_b")))
    sets = cut(met.select("node", _sets(F.col("_x")).alias("h")).dropDuplicates(["node"]), "hashes")
    links = None
    for low, high in zip(ROUNDS, ROUNDS[1:]):
        part = banded.where((F.col("band") >= low) & (F.col("band") < high)).select("bucket", "node")
        root = F.col("node")
        if links is not None:
            part = part.join(connected(links), "node", "left")
            root = F.coalesce("root", "node")
        sizes = part.groupBy("bucket").agg(F.count("*").alias("n"), F.min(root).alias("a"), F.max(root).alias("b"))
        sizes = cut(sizes.where("a <> b").select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "sizes")
        placed = part.select("bucket", "node").join(bounded(sizes, sizes.count()), "bucket").select(
            "bucket", "node", "tiles", F.pmod(F.xxhash64("node", "bucket"), F.col("tiles")).cast("int").alias("tile"))
        paired = placed.join(sets, "node").select(
            "bucket", "tile", "node", "h", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        dealt = (paired.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                               "tile", "node", "h")
                 .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
        found = cut(dealt.mapInArrow(_verified(similar), "u long, v long"), "overlaps")
        links = found if links is None else links.union(found)
    return links


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, radius: int = 3, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, body, fp, root`` per row: rows with one root are connected by near fingerprints or overlaps.

    Texts without words have no overlap with any; their fingerprints are equal.
    """
    prints = simhash.fingerprints(docs, 3, doc_id, text, _sketch(whole(text)).alias("s"))
    marked = cut(prints.select("doc_id", "body", "fp", "s.node", "s.bands"), "sketches")
    overlaps = overlap_links(marked, docs, similar, doc_id, text)
    pairs = marked.select("node", "fp").distinct()
    of_set = cut(pairs.groupBy("node").agg(F.min("fp").alias("f")), "of_set")
    same = pairs.join(of_set, "node").where("fp <> f").select(F.col("fp").alias("u"), F.col("f").alias("v"))
    over = (overlaps.join(of_set.select(F.col("node").alias("u"), F.col("f").alias("fu")), "u")
            .join(of_set.select(F.col("node").alias("v"), F.col("f").alias("fv")), "v")
            .select(F.col("fu").alias("u"), F.col("fv").alias("v")))
    fps = cut(marked.select("fp").distinct(), "fps")
    near = simhash.hamming_links(fps.select(F.col("fp").alias("node"), "fp"), radius)
    roots = connected(near.union(same).union(over))
    return marked.join(roots, marked["fp"] == roots["node"], "left").select(
        "doc_id", "body", "fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, similar: float = SIMILAR, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, as ``simhash.keep_one``."""
    return simhash.keep_first(docs, near_duplicates(docs, similar, radius, doc_id, text), doc_id, text)
