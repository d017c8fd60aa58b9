"""Near duplicates by SimHash: tiles of fingerprints compared exactly.

Fingerprints within ``radius`` bits agree in at least one of ``radius + 1`` blocks, so each block value
is a bucket.  A bucket is laid out by population count and cut into tiles; two tiles meet only if
their counts can lie within the radius, and are then compared whole: exclusive-or, bit count.  No
bucket has to fit into a task, only two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm.common import bounded, whole
from floodspark.llm.components import connected
from floodspark.session import cut

BITS = 64
SEED = 42
TILE = 1024
#: Groups up to this many rows are compared together, shift by shift; larger ones as matrices.
SMALL = 48


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash over the XXH64 of word shingles, as a signed 64-bit value; zero without words.

    A-Z is lower-cased; a text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        h = hashes[part:part + (1 << 14)]
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """``doc_id, body (hash of the text), fp`` and ``more`` per row of ``docs``; a null text counts as empty."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole(text)).alias("body"),
                       simhash(whole(text)).alias("fp"), *more)


def _labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each item's component under the links ``u - v``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        if (label[u] == low).all() and (label[v] == low).all():
            return label
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]


def _matrix(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links between the two tiles of a pair, or within one tile."""
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    us, vs = [], []
    for at in range(0, len(left), 256):  # rows of the tile at a time: bounded memory
        own = left[at:at + 256]
        near = np.bitwise_count(fp[own][:, None] ^ fp[right][None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = own[i], right[j]
        keep = i != j
        i, j = i[keep], j[keep]
        if len(i):
            label = _labels(len(fp), i, j)  # a star per component: at most a link a row
            k = np.flatnonzero(label != np.arange(len(fp)))
            us.append(k)
            vs.append(label[k])
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _compare(keys: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by ``keys`` (whole groups)."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    size = np.diff(np.append(start, n))
    group = np.repeat(np.arange(len(start)), size)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = size[group] <= SMALL
    same_tile = keys[:, 1] == keys[:, 2]
    for d in range(1, int(min(SMALL, size.max(initial=0)))):
        near = (group[d:] == group[:-d]) & small[d:] & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius)
        near &= same_tile[d:] | (side[d:] != side[:-d])
        k = np.flatnonzero(near)
        us.append(k + d)
        vs.append(k)
    for g in np.flatnonzero(size > SMALL):
        a, b = start[g], start[g] + size[g]
        if not same_tile[a] and side[a:b].min() == side[a:b].max():
            continue
        u, v = _matrix(fp[a:b], side[a:b], radius)
        us.append(u + a)
        vs.append(v + a)
    return np.concatenate(us), np.concatenate(vs)


def _pairs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(rows: np.ndarray) -> pa.RecordBatch:
            keys, side, fp, node = rows[:, :3], rows[:, 3], rows[:, 4], rows[:, 5]
            u, v = _compare(keys, side, fp.astype(np.uint64), radius)
            label = _labels(len(rows), u, v)
            k = np.flatnonzero(label != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(node[k]), pa.array(node[label[k]])], names=["u", "v"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64)
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            cut_at = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut_at:
                yield links(rows[:cut_at])
            held = rows[cut_at:]
        if held is not None and len(held):
            yield links(held)
    return run


def hamming_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """``(u, v)`` node pairs that connect just what links of at most ``radius`` bits connect.

    ``fps`` is ``node, fp`` with distinct ``fp``.
    """
    blocks = radius + 1
    width = BITS // blocks
    masks = [(1 << (width if b < blocks - 1 else BITS - width * b)) - 1 for b in range(blocks)]
    bucket = F.array(*[F.xxhash64(F.lit(b), F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit(masks[b])))
                       for b in range(blocks)])
    rows = fps.select("node", "fp", F.bit_count("fp").cast("int").alias("pc"), F.explode(bucket).alias("bucket"))
    counts = rows.groupBy("bucket", "pc").agg(F.count("*").alias("n"))  # at most 65 rows a bucket
    by_bucket = Window.partitionBy("bucket")
    before = F.sum("n").over(by_bucket.orderBy("pc").rowsBetween(Window.unboundedPreceding, -1))
    laid = (counts.withColumn("total", F.sum("n").over(by_bucket)).withColumn("before", F.coalesce(before, F.lit(0)))
            .where(F.col("total") > tile)
            .select("bucket", "pc", F.floor(F.col("before") / tile).cast("int").alias("t0"),
                    F.ceil(F.col("n") / tile).cast("int").alias("span")))
    by_count = by_bucket.orderBy("pc")
    laid = laid.select("bucket", "pc", "t0", "span",
                       F.min("t0").over(by_count.rangeBetween(-radius, 0)).alias("low"),
                       F.max(F.col("t0") + F.col("span") - 1).over(by_count.rangeBetween(0, radius)).alias("high"))
    placed = rows.join(laid, ["bucket", "pc"], "left").select(
        "bucket", "node", "fp",
        F.coalesce(F.col("t0") + F.pmod(F.hash("fp"), F.col("span")), F.lit(0)).alias("tile"),
        F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(0)).alias("high"))
    paired = placed.select("bucket", "tile", "node", "fp", F.explode(F.sequence("low", "high")).alias("other"))
    dealt = (paired.select("bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
                           "tile", "fp", "node")
             .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"))
    return dealt.mapInArrow(_pairs(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, body, fp, component_id, root`` per row: the smallest ``doc_id`` reachable over near fingerprints.

    ``root`` names the component also where no row of it has an id.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other.  Repeated
    rows each get a row; rows without a ``doc_id`` take part, and a component in which no row has one
    has a null ``component_id``.  An empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle, doc_id, text), "simhash")
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected(hamming_links(fps.select(F.col("fp").alias("node"), "fp"), radius))
    of_fp = cut(fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"), "roots")
    least = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(of_fp.drop("least").join(least, "root"), "fp").select("doc_id", "body", "fp", "component_id", "root")


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest ``doc_id``; columns as in ``docs``."""
    return keep_first(docs, near_duplicates(docs, radius, shingle, doc_id, text), doc_id, text)


def keep_first(docs: DataFrame, of_rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest ``doc_id`` of each ``root``; ``of_rows`` has ``doc_id, body, root`` of the rows of ``docs``.

    Of repeated rows one stays.  Texts aren't moved: the ids that go are few or are joined.
    """
    alike = cut(of_rows.groupBy("root", "doc_id", "body").agg(F.count("*").alias("n")), "groups")
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "body")).alias("first"))
    marked = alike.join(first, "root").select(
        F.col("doc_id").alias("_d"), F.col("body").alias("_b"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))).alias("_stays"),
        (F.col("n") > 1).alias("_again"))
    changed = cut(marked.where("NOT _stays OR _again"), "changed")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).cast("long").alias("_i"),
                       F.xxhash64(whole(text)).alias("_t"))
    met = rows.join(bounded(changed, changed.count()), F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_b")), "left")
    single = met.where("_stays IS NULL").select("_row.*")
    repeated = met.where("_stays").dropDuplicates(["_i", "_t"]).select("_row.*")
    return single.unionByName(repeated)


def fingerprint_hex(fp: str = "fp"):
    """The fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
