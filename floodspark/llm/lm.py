"""Scoring of whole documents by a gated recurrent language model learnt from the corpus.

Word counts cover all training documents.  Training covers them too: in every round each task learns from its
own documents, starting at the mean of the last round's models, and the round ends with their mean,
weighted by tokens.  Words are looked up in a dictionary of fixed size; what is rarer meets its
counts by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm import gru
from floodspark.llm.common import whole
from floodspark.session import cut

#: Words the model tells apart, and words whose counts every task holds.
MODEL_WORDS = 1024
DICTIONARY = 300_000
#: Sixteenths of the training documents that each round ends at.
ROUNDS = (1, 6, 16)
END = ""
#: Tokens scored or learnt from side by side, and bytes of text taken apart at once.
CHUNK = 1_000_000
PIECE = 4 << 20
WIDTH = 256
SMOOTH = 0.1


@dataclass
class Vocabulary:
    """The most frequent words with their counts, most frequent first, and the totals of all words."""
    words: pa.Array
    counts: np.ndarray
    tokens: int
    distinct: int
    rest: float  # smoothed mass of the words the model doesn't tell apart
    known: int  # words the model tells apart


def held_out(doc_id: Column) -> Column:
    """One document in ten, by the CRC-32 of its id as text (a null id counts as an empty one)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at a time as have ``PIECE`` bytes of text (``t``), one at least."""
    ends = np.cumsum(pc.binary_length(batch.column("t")).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield batch.slice(low, high - low)
        low = high


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of all texts, each text's followed by the end, and where each text begins (and the last ends)."""
    ended = pc.ascii_ltrim_whitespace(pc.binary_join_element_wise(texts.cast(pa.string()), "", " "))  # what follows the last space is the end
    lists = pc.ascii_split_whitespace(pc.ascii_lower(ended))
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch):
            words, n = pc.value_counts(tokens(piece.column("t"))[0]).flatten()
            yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])


def word_counts(rows: DataFrame) -> DataFrame:
    """``word, n`` over the training documents of ``rows`` (``t``, ``held_out``)."""
    texts = rows.where(~F.col("held_out")).select("t")
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What of the counts (a written table) every task holds: ``DICTIONARY`` words at most."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    step = F.floor(8 * F.log2("n"))  # a few hundred steps: the first whose words fit says from which count on
    by_step = sorted(((r["s"], r["k"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, None
    for at, k in by_step:
        if held + k > DICTIONARY:
            break
        held, least = held + k, at
    top = counts.where(step >= least if least is not None else F.lit(False)).toPandas()
    top = top.sort_values(["n", "word"], ascending=[False, True])
    n = top["n"].to_numpy(np.int64)
    n_all, v_all = total[0] or 0, total[1]
    known = min(MODEL_WORDS, len(n))
    rest = (n_all - int(n[:known].sum())) + SMOOTH * (v_all - known) + SMOOTH
    return Vocabulary(pa.array(top["word"].tolist(), pa.string()), n, n_all, v_all, rest, known)


def numbers(words: pa.Array, table: pa.Array) -> np.ndarray:
    """Places of words in a table; -1 for the others."""
    return pc.fill_null(pc.index_in(words, value_set=table), -1).to_numpy(zero_copy_only=False)


def _model_ids(ids: np.ndarray, known: int) -> np.ndarray:
    return np.where((ids >= 0) & (ids < known), ids, known).astype(np.int32)


def _first(vocab: Vocabulary) -> int:
    """What the model takes for the word before each text: the end."""
    return int(_model_ids(numbers(pa.array([END]), vocab.words), vocab.known)[0])


def _learn(shared, hidden: int):
    """One task's share of a round: its weights after its documents, times its tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, starts, weights = shared.value
        table = vocab.words[:vocab.known]
        weights = {k: v.copy() for k, v in weights.items()}
        squares = {k: np.full_like(v, 1e-3) for k, v in weights.items()}
        model, first, n, held, texts = gru.Model(weights, starts), _first(vocab), 0, 0, []
        for batch in batches:
            for piece in _pieces(batch):
                words, begin = tokens(piece.column("t"))
                for ids in np.split(_model_ids(numbers(words, table), vocab.known), begin[1:-1]):
                    texts.append(ids)
                    held += len(ids)
                    if held >= CHUNK:
                        model.fit(texts, first, width=WIDTH, squares=squares)
                        n, held, texts = n + held, 0, []
        if texts:  # fewer lanes for fewer tokens: as many updates
            model.fit(texts, first, width=max(8, min(WIDTH, WIDTH * held // CHUNK)), squares=squares)
            n += held
        if n:
            for name, w in weights.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * w.size), pa.array(np.arange(w.size, dtype=np.int32)),
                     pa.array(w.ravel().astype(np.float64) * n), pa.array(np.full(w.size, n))], names=["name", "at", "x", "n"])
    return run


def train(rows: DataFrame, vocab: Vocabulary, hidden: int = gru.HIDDEN, rounds: tuple[int, ...] = ROUNDS
          ) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Class starts and weights.  Each number of the model is summed over tasks where they are; as many sums
    as the model has numbers reach the driver."""
    spark = rows.sparkSession
    starts = gru.classes(vocab.counts[:vocab.known])
    weights = gru.initial(vocab.known, len(starts) - 1, hidden)
    mass = np.concatenate([vocab.counts[:vocab.known] + SMOOTH, [vocab.rest]])  # begin at the words' frequencies
    weights["bw"][:] = np.log(mass[:-1])
    weights["bc"][:] = np.log(np.add.reduceat(mass, starts))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(rounds[-1]))
    low = 0
    for high in rounds:
        shared = spark.sparkContext.broadcast((vocab, starts, weights))
        texts = rows.where(~F.col("held_out") & (part >= low) & (part < high)).select("t")
        learnt = texts.mapInArrow(_learn(shared, hidden), "name string, at int, x double, n long")
        sums = learnt.groupBy("name", "at").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        for name, own in sums.groupby("name"):
            flat = weights[name].ravel().copy()
            flat[own["at"].to_numpy()] = own["x"].to_numpy()
            weights[name] = flat.reshape(weights[name].shape).astype(np.float32)
        low = high
    return starts, weights


def _score(shared, base: float, rest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, starts, weights = shared.value
        logs = np.append(np.log10(vocab.counts + SMOOTH), 0.0)
        model, first = gru.Model(weights, starts), _first(vocab)
        ids, parts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            scores, low = model.score(ids, first) / math.log(10), 0
            for part in parts:
                own = pa.array(scores[low:low + part.num_rows])
                low += part.num_rows
                yield part.set_column(3, "score", pc.add(part.column("score"), own))
            ids.clear()
            parts.clear()

        for batch in batches:
            for piece in _pieces(batch):
                words, begin = tokens(piece.column("t"))
                number = numbers(words, vocab.words)
                known = logs[number]  # the last entry stands for words outside the dictionary
                other = number < 0
                rare = other | (number >= vocab.known)
                n = np.diff(begin)
                summed = lambda x: np.add.reduceat(x.astype(np.float64), begin[:-1])
                n_other = summed(other).astype(np.int64)
                others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_other)), pa.int32()), words.filter(pa.array(other)))
                parts.append(pa.RecordBatch.from_arrays(
                    [pa.array(n), pa.array(n - n_other), pa.array(summed(known) - base * n),
                     pa.array(summed(known * rare) - rest * summed(rare)), others, piece.column("held_out"), piece.column("doc_id")],
                    names=["n_tokens", "n_known", "base", "score", "others", "held_out", "doc_id"]))
                ids.extend(np.split(_model_ids(number, vocab.known), begin[1:-1]))
                held += len(words)
                if held >= CHUNK:
                    yield from flush()
                    held = 0
        if parts:
            yield from flush()
    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hidden: int = gru.HIDDEN,
          rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row, in log10.

    A rarer word's probability is that of its class times its smoothed share among the words the model
    doesn't tell apart; one share is left for words never seen, as in the base score.  Null texts are
    empty (just the end); repeated rows are scored and learnt from as often as they occur; rows
    without a ``doc_id`` are held out; without training documents all words are unseen.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), whole(text).alias("t"))
    counts = cut(word_counts(rows), "counts")
    vocab = vocabulary(counts)
    starts, weights = train(rows, vocab, hidden, rounds)
    base = math.log10(vocab.tokens + SMOOTH * (vocab.distinct + 1))
    shared = spark.sparkContext.broadcast((vocab, starts, weights))
    kind = docs.schema[doc_id].dataType.simpleString()
    scored = rows.select("doc_id", "held_out", "t").mapInArrow(
        _score(shared, base, math.log10(vocab.rest)), "n_tokens long, n_known long, base double, score double, "
        f"others array<string>, held_out boolean, doc_id {kind}")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # numbered once, as written
    # words outside the dictionary: their counts, or none
    others = scored.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    met = others.join(counts, "word", "left").select(
        "row", "k", F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("seen"),
        (F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("log"))
    more = met.groupBy("row").agg(F.sum("seen").alias("seen"), F.sum("log").alias("log"))
    out = scored.drop("others").join(more, "row", "left")
    gain = F.coalesce("log", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
                      F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"),
                      (F.col("score") + gain).alias("score"))
