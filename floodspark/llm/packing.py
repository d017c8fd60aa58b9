"""Best-fit packing planned on a histogram of lengths.

Texts become token pieces; their lengths are counted; best-fit decreasing runs over the counts (at most
``capacity`` different lengths); each planned step then takes the pieces of one length by rank.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm.common import whole
from floodspark.session import cut

CAPACITY = 1024
END_ID = 2
#: Parts in which pieces of one length are ranked.
CELLS = 256
#: Characters on whose classes every regular-expression library agrees; other texts take the slow way.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]*")


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str | None = None):
    """A function from text to token ids: ``tokenizers`` on the vocabulary file.

    ``ranks`` names the same vocabulary as a rank file.  Plain texts then go through ``tiktoken``, seven
    times as fast with the same ids; those with the strings of special tokens or unusual characters don't.
    """
    from tokenizers import Tokenizer
    full = Tokenizer.from_file(vocabulary)

    def slow(text: str) -> np.ndarray:
        return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    special = [t.content for t in full.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or not PLAIN.fullmatch(text):
            return slow(text)
        return fast.encode_to_numpy(text, disallowed_special=())
    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: all but the first are full."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))] if n > capacity else [(0, n)]


def _tokenized(vocabulary: str, ranks: str | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for k, (at, n) in enumerate(cuts(len(ids), capacity)):
                    piece = ids[at:at + n]
                    row = (doc_id, k, at, n, zlib.crc32(piece.tobytes()), piece.astype(np.int64) if with_ids else None)
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)][:6 if with_ids else 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(arrays)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY,
           with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``); a null text is an empty one: just the end id."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(_tokenized(vocabulary, ranks, capacity, with_ids), schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: steps ``(length, low, high, sequence, per, offset)``.

    Pieces of ``length`` with rank ``low`` to ``high`` (excluded) go ``per`` to a sequence, from
    ``sequence`` on, the first at ``offset``.  Sequences alike are one group ``(first, how many)``, so the
    steps number with the lengths and not with the pieces.
    """
    space: dict[int, list[tuple[int, int]]] = {}  # room left -> groups
    steps, fresh = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            space.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        total, at = counts[length], 0
        while at < total:
            room = min((r for r in space if r >= length), default=0)
            if room:
                first, n = space[room].pop()
                if not space[room]:
                    del space[room]
            else:
                room = capacity
                first, n = fresh, -(-(total - at) // (capacity // length))
                fresh += n
            per = room // length
            full = min(n, (total - at) // per)
            if full:
                steps.append((length, at, at + full * per, first, per, capacity - room))
                at += full * per
                leave(room - per * length, first, full)
            if full < n:
                rest = min(total - at, per)
                if rest:
                    steps.append((length, at, at + rest, first + full, rest, capacity - room))
                    at += rest
                    leave(room - rest * length, first + full, 1)
                    full += 1
                leave(room, first + full, n - full)
    return steps


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (a written table with ``length``) with ``sequence_id`` and ``offset``.

    Ranks within a length come from parts of it, so a length that most pieces share is never one task's;
    histogram and plan hold one number per length and per step.
    """
    spark = rows.sparkSession
    # the written row's own values deal it out: equal rows are alike, whichever goes first
    cell = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "ids"]), F.lit(CELLS)).cast("int")
    dealt = rows.withColumn("_cell", cell)
    sized = cut(dealt.groupBy("length", "_cell").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = spark.createDataFrame(best_fit(counts, capacity) or [(0, 0, 0, 0, 1, 0)],
                                  "length long, low long, high long, first long, per long, base long")
    by_length = (steps.groupBy("length").agg(F.array_sort(F.collect_list(
        F.struct("low", "high", "first", "per", "base"))).alias("steps")))  # a plan's steps, not the rows
    prior = F.sum("n").over(Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = sized.select("length", "_cell", F.coalesce(prior, F.lit(0)).alias("_start"))
    order = [c for c in rows.columns if c not in ("ids", "length")]
    ranked = dealt.withColumn("_rank", F.row_number().over(
        Window.partitionBy("length", "_cell").orderBy(*order)) - 1)
    ranked = ranked.join(starts, ["length", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    step = F.filter("steps", lambda s: (s["low"] <= F.col("_rank")) & (F.col("_rank") < s["high"]))[0]
    found = ranked.join(F.broadcast(by_length), "length").withColumn("_step", step)
    nth = F.col("_rank") - F.col("_step.low")
    return found.select(
        *rows.columns,
        (F.col("_step.first") + F.floor(nth / F.col("_step.per"))).cast("long").alias("sequence_id"),
        (F.col("_step.base") + F.pmod(nth, F.col("_step.per")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY,
         with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Documents longer than ``capacity`` are cut into full pieces, the first may be shorter; nothing is
    dropped or padded.  Equal lengths are interchangeable and ranked by what is in their rows; repeated
    documents are packed as often as they occur; an empty table gives an empty result.
    """
    return place(cut(pieces(docs, vocabulary, ranks, capacity, with_ids, doc_id, text), "pieces"), capacity)
