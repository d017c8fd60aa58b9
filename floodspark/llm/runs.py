"""Runs of repeated words, caught online.

A sequence of words grows by appending.  At level ``B`` (a power of two) every completed block of ``H`` words gets a
catcher: as words are appended, the last ``H`` of them are compared with the block, for all distances ``q`` from ``B``
to ``2B - 1``.  Any square of half-length ``q`` has a block of its level inside its first half, so its catcher meets it
when the word ``q`` places after the block's end arrives.  Catches of one distance on neighbouring blocks merge; what
lies beyond the outer blocks is found by halving steps, and a merged stretch that is at least twice ``q`` long is a run.

Comparisons use sums of powers modulo 2 ** 64, and every run is compared word by word at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import whole

#: Least words of a run.
LEAST = 12
#: Words appended at a time, and words of documents that share a sequence.
CHUNK = 1 << 18
FACTORS = tuple(np.random.default_rng(11).integers(0, 1 << 62, 8, np.uint64) * np.uint64(2) + np.uint64(1))
MIX = np.uint64(0x9E3779B97F4A7C15)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _scattered(ids: np.ndarray) -> np.ndarray:
    """A different 64-bit number for every id."""
    x = ids.astype(np.uint64) * MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a factor and of its inverse, as many as were needed so far."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, factor: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = cls.held.get(int(factor), (np.ones(1, np.uint64),) * 2)
        if len(up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(factor), -1, 1 << 64))
            up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, f, np.uint64)])) for f in (factor, inverse))
            cls.held[int(factor)] = up, down
        return up, down


def block_size(level: int) -> int:
    """Words of a level's blocks: any stretch on which a run of the level repeats itself holds a whole block.

    Such a stretch has at least ``max(q, LEAST - q)`` words for the half-length ``q``, and a block of ``H`` lies in any
    ``2H - 1`` words.
    """
    shortest = min(max(q, LEAST - q) for q in range(level, 2 * level))
    size = 1
    while 4 * size - 1 <= shortest:
        size *= 2
    return size


class Catchers:
    """The catchers of one growing sequence; ``longest`` bounds the length of its runs."""

    def __init__(self, longest: int, factor: np.uint64 = FACTORS[0]):
        self.factor, self.n = factor, 0
        self.ids = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.levels = [1 << k for k in range(longest.bit_length()) if max(2 << k, LEAST) <= longest]
        none = np.zeros(0, np.int64)
        #: Per level the merged catches: distance, first block's start, last block's end.
        self.caught: dict[int, Runs] = {level: (none, none, none) for level in self.levels}

    def _same(self, a: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` words from ``a`` equal those ``q`` later."""
        up, _ = Powers.of(self.factor, self.n + 1)
        s = self.sums
        return (s[a + size] - s[a]) * up[q] == s[a + q + size] - s[a + q]

    def _grow(self, ids: np.ndarray) -> None:
        n = self.n + len(ids)
        if n > len(self.ids):
            room = n if not self.n else max(n, 2 * self.n)
            self.ids = np.concatenate([self.ids[:self.n], np.zeros(room - self.n, np.int64)])
            self.sums = np.concatenate([self.sums[:self.n + 1], np.zeros(room - self.n, np.uint64)])
        up, _ = Powers.of(self.factor, n + 1)
        self.ids[self.n:n] = ids
        np.cumsum(_scattered(ids) * up[self.n:n], out=self.sums[self.n + 1:n + 1])
        self.sums[self.n + 1:n + 1] += self.sums[self.n]
        self.n = n

    def append(self, ids: np.ndarray) -> None:
        """Append words; every level compares the suffixes that end in them with its completed blocks."""
        before = self.n
        self._grow(np.asarray(ids, np.int64))
        _, down = Powers.of(self.factor, self.n + 1)
        prints: dict[int, np.ndarray] = {}
        for level in self.levels:
            size = block_size(level)
            fresh = max(before - size + 1, 0)  # suffixes of a block's size that end in the new words
            count = self.n - size + 1 - fresh
            low = max(fresh - 2 * level, 0)  # where the blocks in reach begin
            if count <= 0:
                continue
            if size not in prints or len(prints[size]) < self.n - size + 1 - low:
                at = slice(low, self.n - size + 1)
                prints[size] = (self.sums[low + size:self.n + 1] - self.sums[at]) * down[at]
            held = prints[size][len(prints[size]) - (self.n - size + 1 - low):]
            ends = np.arange(fresh, fresh + count)
            block = (ends - level) // size * size
            found = []
            for _ in range(max(level // size, 1)):
                ok = np.flatnonzero((block >= 0) & (ends - block < 2 * level))
                at = ok if len(ok) < count else slice(None)
                hit = held[block[at] - low] == held[ends[at] - low]
                found.append((ends[at][hit], block[at][hit]))
                block = block - size
            suffix, start = (np.concatenate(x) for x in zip(*found))
            if len(start):
                self._merge(level, size, suffix - start, start)

    def _merge(self, level: int, size: int, q: np.ndarray, start: np.ndarray) -> None:
        """Join catches of one distance on neighbouring blocks with each other and with earlier ones."""
        old_q, old_first, old_last = self.caught[level]
        q, first = np.concatenate([old_q, q]), np.concatenate([old_first, start])
        last = np.concatenate([old_last, start + size])
        order = np.lexsort((first, q))
        q, first, last = q[order], first[order], last[order]
        head = np.concatenate([[True], (q[1:] != q[:-1]) | (first[1:] > last[:-1])])
        self.caught[level] = q[head], first[head], last[np.append(np.flatnonzero(head)[1:] - 1, len(q) - 1)]

    def _extended(self, level: int) -> Runs:
        """``start, end, q`` of the stretches with period ``q`` around the level's catches."""
        q, first, last = self.caught[level]
        left, right = first.copy(), last.copy()
        step = block_size(level)
        while step:
            ok = np.flatnonzero(left >= step)
            left[ok[self._same(left[ok] - step, q[ok], step)]] -= step
            ok = np.flatnonzero(right + q + step <= self.n)
            right[ok[self._same(right[ok], q[ok], step)]] += step
            step //= 2
        return left, right + q, q

    def runs(self) -> Runs:
        """``start, length, period`` of all runs of the words so far, by start and period."""
        parts = [self._extended(level) for level in self.levels]
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        start, end, q = (np.concatenate(x) for x in zip(*parts))
        long = end - start >= np.maximum(2 * q, LEAST)
        start, end, q = start[long], end[long], q[long]
        order = np.lexsort((q, end, start))  # multiples of a period span the same stretch: the least is the period
        start, end, q = start[order], end[order], q[order]
        head = np.ones(len(q), bool)
        head[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, q = start[head], end[head], q[head]
        for a, b, p in zip(start.tolist(), end.tolist(), q.tolist()):
            if not np.array_equal(self.ids[a:b - p], self.ids[a + p:b]):
                raise ArithmeticError("sums of different words agree")
        order = np.lexsort((q, start))
        return start[order], (end - start)[order], q[order]


def runs_of(ids: np.ndarray, longest: int | None = None, chunk: int = CHUNK) -> Runs:
    """All runs of a sequence, appended ``chunk`` words at a time; another factor is taken if sums deceive."""
    for factor in FACTORS:
        catchers = Catchers(len(ids) if longest is None else longest, factor)
        for at in range(0, len(ids), chunk):
            catchers.append(ids[at:at + chunk])
        try:
            return catchers.runs()
        except ArithmeticError:
            continue
    raise ArithmeticError("sums of different words agree for every factor")


def text_runs(texts: list[bytes], chunk: int = CHUNK) -> Iterator[tuple[int, list[bytes], Runs]]:
    """``(place, words, runs)`` of every text.

    Texts of like length follow each other in one sequence, with a word of its own after each: no run crosses it.
    """
    seen: dict[bytes, int] = {}
    kinds: dict[int, list[tuple[int, list[bytes]]]] = {}
    held: dict[int, int] = {}

    def solve(group: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, list[bytes], Runs]]:
        ids, edges = [], [0]
        for k, (_, words) in enumerate(group):
            ids += [seen.setdefault(w, len(seen)) for w in words]
            ids.append(-1 - k)
            edges.append(len(ids))
        start, length, period = runs_of(np.array(ids, np.int64), max(len(w) for _, w in group), chunk)
        at = np.searchsorted(start, edges)
        for k, (place, words) in enumerate(group):
            one = slice(at[k], at[k + 1])
            yield place, words, (start[one] - edges[k], length[one], period[one])

    for place, text in enumerate(texts):
        words = text.split()
        kind = len(words).bit_length()
        kinds.setdefault(kind, []).append((place, words))
        held[kind] = held.get(kind, 0) + len(words)
        if held[kind] >= chunk:
            held[kind] = 0
            yield from solve(kinds.pop(kind))
    for group in kinds.values():
        yield from solve(group)


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    start, length, period = runs
    if not len(start):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


#: Bytes of text whose words a task holds at a time; a longer text is held alone.
HELD = 1 << 22


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + HELD, side="right")))
            yield _rows(batch.slice(at, to - at))
            at = to


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = [None] * batch.num_rows
    for place, words, runs in text_runs(batch.column(1).cast(pa.large_binary()).to_pylist()):
        out[place] = (len(words), runs, collapsed(words, runs).decode())
    flat = [pa.array(np.concatenate([r[k] for _, r, _ in out])) for k in range(3)]
    edges = np.concatenate([[0], np.cumsum([len(r[0]) for _, r, _ in out])])
    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(flat, fields=list(RUN)))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([n for n, _, _ in out], pa.int64()), lists, pa.array([t for _, _, t in out], pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, runs array<struct<start, length, period>>, collapsed``.

    A run is a maximal stretch of at least ``LEAST`` words and two periods, under its smallest period; runs are listed
    by start and period.  ``collapsed`` keeps the words that lie in no run after its first period.  Null, empty and
    short texts have no runs; repeated rows get equal results; ids may be null or occur twice; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_found, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, "
                                   "collapsed string")
