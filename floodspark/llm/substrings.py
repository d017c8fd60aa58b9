"""Removal of repeated passages: every word in a window that also starts elsewhere.

A window of ``WINDOW`` words is known by its least hashed ``GRAM`` words (the leftmost of equals).  Runs of
windows that share this place are segments; equal windows lie in segments with the same least hash, so
segments are dealt out by it, equal ones counted first.  Each shard gets an FM-index of its segments, and
matching statistics of the segments against it give the repeated stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import bounded, whole
from floodspark.llm.fmindex import repeated_spans
from floodspark.session import cut

WINDOW = 35
GRAM = 8
#: Words an index should have, and different segments of one least hash from which its windows are dealt one by one.
SHARD_WORDS = 400_000
HOT = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.random.default_rng(35).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text and rows that are worked on at a time.
CHUNK = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Powers:
    """Powers of ``ODD`` and of its inverse, as many as were needed so far."""
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(ODD, n), _powers(INVERSE, n)
        return cls.up, cls.down


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after the other, and where each text's begin (and the end).

    A word's hash is the sum of its letters' numbers times powers of the place, shifted to its own start.
    """
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]  # a text's first letter begins a word, whatever the text before ended in
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * up[:len(data)], out=sums[1:])
    hashes = _mixed(((sums[last] - sums[first]) * down[first]) ^ ((last - first).astype(np.uint64) * MIX))
    return hashes, np.searchsorted(first, offsets)


def segments(words: np.ndarray, edges: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """``(text, least hash, content hash, first window, windows, first word here)`` of the segments of texts.

    ``words`` are the hashes of all texts' words and ``edges`` where each text's begin (and the end).
    """
    gram = min(GRAM, window)
    counts = np.maximum(np.diff(edges) - window + 1, 0)
    none = np.zeros(0, np.int64)
    if not counts.sum():
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * ODD + words[k:k + len(grams)]
    grams = _mixed(grams)
    best, least, size, width = np.arange(len(grams)), grams, 1, window - gram + 1
    while size < width:  # where the least gram of ever longer stretches lies, the leftmost of equals
        step = min(size, width - size)
        later = least[step:] < least[:-step]
        best = np.where(later, best[step:], best[:-step])
        least = np.where(later, least[step:], least[:-step])
        size += step
    text = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = edges[:-1][text] + nth  # windows that lie in one text
    place = best[at]
    fresh = np.flatnonzero((nth == 0) | np.concatenate([[True], place[1:] != place[:-1]]))
    many = np.diff(np.append(fresh, len(at)))
    start = at[fresh]
    up, down = Powers.of(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    content = (sums[start + many + window - 1] - sums[start]) * down[start]
    content = _mixed(content ^ (many.astype(np.uint64) * MIX))
    return text[fresh], least[start], content, nth[fresh], many, start


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in parts of ``CHUNK`` bytes of text, with the hashes of their words and where each text's begin."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK, side="right")))
        part = batch.slice(at, to - at)
        offsets = np.concatenate([[0], sizes[at:to] - before])
        at = to
        texts = pa.concat_arrays([part.column(column)]).cast(pa.large_binary())
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        data = data[np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]:][:offsets[-1]]
        yield part, *word_hashes(data, offsets)


def _cut_up(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch, words, edges in _pieces(whole_batch, 2):
                text, least, content, first, count, _ = segments(words, edges, window)
                row = pa.array(text)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(least.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["doc_id", "body", "least", "content", "first", "windows"])
                for part in range(0, out.num_rows, 10_000):
                    yield out.slice(part, 10_000)
    return run


def document_segments(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Segments of ``doc_id, body, t`` rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut_up(window), f"doc_id {kind}, body long, least long, content long, first int, windows int")


def _standing(window: int):
    """The words (32 bits of their hashes) of the segments that a text stands for, as its list says."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch, words, edges in _pieces(whole_batch, 0):
                lists = pa.concat_arrays([batch.column(1)])
                named = lists.flatten()
                field = lambda name: named.field(named.type.get_field_index(name))  # noqa: E731, B023
                text = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                lengths = np.asarray(field("windows")).astype(np.int64) + window - 1
                start = edges[:-1][text] + np.asarray(field("first"))
                inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                flat = words.astype(np.uint32).view(np.int32)[np.repeat(start, lengths) + inner]
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
                names = ["least", "content", "times", "hot", "windows"]
                out = pa.RecordBatch.from_arrays([*[field(n) for n in names], held], names=[*names, "words"])
                for part in range(0, out.num_rows, 10_000):
                    yield out.slice(part, 10_000)
    return run


def _indexed(window: int):
    """Per shard (rows sorted by it) the repeated stretches of each segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            lists = table.column("words").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            lengths = np.asarray(lists.value_lengths())
            seq, low, high = repeated_spans(np.asarray(lists.flatten()), lengths, np.asarray(table.column("times")), window)
            row = pa.array(seq)
            pick = lambda name: table.column(name).take(row).combine_chunks()
            flat = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            return pa.RecordBatch.from_arrays(
                [flat(pick("least")), flat(pick("content")), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                names=["least", "content", "low", "high"])

        current = None
        for batch in batches:
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
            for a, b in zip(edges, [*edges[1:], len(shards)]):
                if held and shards[a] != current:
                    yield solve(pa.concat_tables(held))
                    held = []
                current = shards[a]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield solve(pa.concat_tables(held))
    return run


def repeated(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, body, low, high``: stretches of words (ends excluded) whose every window also starts elsewhere."""
    kept = cut(document_segments(rows, window), "segments")
    live = cut(kept.groupBy("least").agg(F.count("*").alias("n")).where("n > 1"), "least")
    wanted = bounded(live.select("least"), live.count())
    # one occurrence stands for all segments that are equal
    alike = cut(kept.join(wanted, "least", "left_semi").groupBy("least", "content").agg(
        F.count("*").alias("times"), F.min(F.struct("body", "doc_id", "first")).alias("at"), F.max("windows").alias("windows")), "alike")
    hot = cut(alike.groupBy("least").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("least"), "hot")
    n_hot = hot.count()
    crowded = bounded(hot.withColumn("hot", F.lit(True)), n_hot)
    # each text is told which segments it stands for; it moves once, whatever the size, and only their words go on
    told = alike.join(crowded, "least", "left").groupBy(F.col("at.body").alias("_b"), F.col("at.doc_id").alias("_d")).agg(
        F.collect_list(F.struct(F.col("at.first").alias("first"), "windows", "least", "content", "times", "hot")).alias("want"))
    here = (F.col("body") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    shown = rows.join(told, here).select("t", "want").mapInArrow(
        _standing(window), "least long, content long, times long, hot boolean, windows int, words array<int>")
    if not kept.where("first = 0").groupBy("doc_id", "body").count().where("count > 1").isEmpty():
        shown = shown.dropDuplicates(["least", "content"])  # the row that stands for a segment is itself repeated
    shown = cut(shown, "shown")
    indexed = shown.where("hot IS NULL").select("least", "content", "times", "words")
    if n_hot:
        # One place with very many surroundings: its windows by their own content, counted before they move.
        each = F.explode_outer(F.transform(F.sequence(F.lit(1), F.col("windows")), lambda i: F.struct(
            (i - 1).alias("nth"), F.slice("words", i, window).alias("words"))))
        single = shown.where("hot").select("least", "content", "times", each.alias("w")).select(
            F.col("least").alias("whole_least"), F.col("content").alias("whole"), "times", "w.nth", "w.words",
            F.xxhash64("w.words").alias("content"))
        one = (single.groupBy("content").agg(F.sum("times").alias("times"), F.first("words").alias("words"))
               .where("times > 1").select(F.col("content").alias("least"), "content", "times", "words"))
        indexed = indexed.unionByName(one)
    indexed = cut(indexed, "indexed") if n_hot else indexed
    total = indexed.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    shards = int(-(-total // SHARD_WORDS)) or 1
    dealt = (indexed.select(F.pmod(F.xxhash64("least"), F.lit(shards)).alias("shard"), "least", "content", "times", "words")
             .repartition("shard").sortWithinPartitions("shard"))
    spans = cut(dealt.mapInArrow(_indexed(window), "least long, content long, low int, high int"), "spans")
    if n_hot:  # back from windows to the segments they are of
        own = single.join(spans.select("content"), "content").select(
            F.col("whole_least").alias("least"), F.col("whole").alias("content"), F.col("nth").alias("low"),
            (F.col("nth") + window).alias("high"))
        spans = spans.unionByName(own)
    return (kept.join(wanted, "least", "left_semi").join(spans, ["least", "content"])
            .select("doc_id", "body", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
            .distinct())


def kept_words(text: str, low: np.ndarray, high: np.ndarray) -> tuple[int, int, str]:
    """Words, words removed, and the kept ones joined by one space."""
    words = text.encode().split()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    gone = np.cumsum(edge)[:-1] > 0
    left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if len(low) else b" ".join(words)
    return len(words), int(gone.sum()), left.decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                   digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the ``kept`` text (its SHA-256 as ``kept_sha256`` with ``digest``) per row.

    Windows are judged on the input.  Null, empty and short texts lose nothing; repeated rows are copies
    of each other and lose all if they are long enough; a window that overlaps its own repetition counts;
    rows without a ``doc_id`` take part; an empty table gives an empty result.  Words are compared by
    64-bit hashes when segments are counted, by 32 bits of them inside an index.
    """
    body = whole(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("body"), body.alias("t"))
    found = (repeated(rows, window).groupBy(F.col("doc_id").alias("d"), F.col("body").alias("b"))
             .agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")))  # of one document
    together = rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["body"] == found["b"]), "left")

    def clean(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        out = [kept_words(t, none if a is None else a, none if b is None else b) for t, a, b in zip(texts, lows, highs)]
        table = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
        if digest:
            table["kept"] = [hashlib.sha256(k.encode()).hexdigest() for k in table["kept"]]
        return table

    cleaned = F.pandas_udf(clean, "n_words long, n_removed long, kept string")("t", "low", "high")
    out = together.select("doc_id", cleaned.alias("c"))
    return out.select("doc_id", "c.n_words", "c.n_removed", F.col("c.kept").alias("kept_sha256" if digest else "kept"))
