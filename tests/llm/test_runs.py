"""Periodic runs against brute force: sequences, texts, the operator and its query."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from floodspark.llm import runs
from floodspark.llm.queries import QUERIES
from llm_rows import awkward, table, words

DATA = "/root/testdata/sf0.001"


def brute(w):
    """Every maximal stretch on which words ``q`` apart are equal, under the least ``q``."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x < len(w) - q:
            y = x
            while y < len(w) - q and w[y] == w[y + q]:
                y += 1
            if y > x and y + q - x >= max(runs.LEAST, 2 * q):
                out.setdefault((x, y + q), q)
            x = y + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def brute_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def sequence(rng):
    n, letters = rng.randrange(0, 150), rng.choice((1, 2, 2, 3, 5, 30))
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 9)
        w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
    return w


def listed(found):
    return [tuple(int(x[k]) for x in found) for k in range(len(found[0]))]


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_sequences(seed):
    rng = random.Random(seed)
    n = 0
    for _ in range(250):
        w = sequence(rng)
        want = brute(w)
        n += len(want)
        assert listed(runs.runs_of(np.array(w, np.int64), chunk=rng.choice((1, 3, 16, 1000)))) == want, w
    assert n > 100


def test_online_every_prefix_is_right():
    rng = random.Random(9)
    for _ in range(20):
        w = sequence(rng)
        catchers = runs.Catchers(max(len(w), 1))
        for k, x in enumerate(w):
            catchers.append(np.array([x]))
            if k % 7 == 0:
                assert listed(catchers.runs()) == brute(w[:k + 1])


def test_square_free_and_overlapping_words():
    thue = [0]
    while len(thue) < 3000:  # a word without squares
        thue = [y for x in thue for y in {0: (0, 1, 2), 1: (0, 2), 2: (1,)}[x]]
    assert listed(runs.runs_of(np.array(thue, np.int64))) == []
    fib = [0, 1]
    while len(fib) < 300:
        fib = [y for x in fib for y in ((0, 1) if x == 0 else (0,))]
    assert listed(runs.runs_of(np.array(fib, np.int64))) == brute(fib)


def test_long_repetitions_are_cheap():
    for w in (np.zeros(300_000, np.int64), np.arange(300_000) % 70_001):
        (start,), (length,), (period,) = runs.runs_of(w)
        assert (start, length, period) == (0, 300_000, int(w.max()) + 1)


def test_deceiving_sums_change_the_factor(monkeypatch):
    monkeypatch.setattr(runs, "FACTORS", (np.uint64(1), runs.FACTORS[1]))  # sums that ignore the order of words
    w = [1, 2, 3, 4, 5, 6, 7, 8, 8, 7, 6, 5, 4, 3, 2, 1] + [1, 2, 3] * 6
    assert listed(runs.runs_of(np.array(w * 2, np.int64))) == brute(w * 2)


def test_operator_on_awkward_tables(spark):
    rng = random.Random(4)
    rows = awkward() + [(100 + i, " ".join(f"w{x}" for x in sequence(rng))) for i in range(60)]
    rows += [(300, "a\x85b " * 9), (301, " x y\n" * 8), (302, "α β γ " * 5 + "α")]
    out = sorted(map(str, runs.find_runs(table(spark, rows)).collect()))
    want = []
    for i, t in rows:
        w = words(t)
        found = brute(w)
        want.append(str(spark_row(i, len(w), found, brute_collapsed(w, found))))
    assert out == sorted(want)
    assert runs.find_runs(table(spark, [])).count() == 0


def spark_row(i, n, found, text):
    from pyspark.sql import Row
    return Row(doc_id=i, n_words=n, runs=[Row(start=s, length=k, period=q) for s, k, q in found], collapsed=text)


def test_small_chunks_give_the_same():
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in sequence(rng)).encode() for _ in range(80)]
    want = {k: listed(r) for k, _, r in runs.text_runs(texts)}
    assert {k: listed(r) for k, _, r in runs.text_runs(texts, chunk=50)} == want
    assert sorted(want) == list(range(80))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    looped = 0
    for d in docs:
        w = words(d["text"])
        if len(w) > 1500:  # brute force is quadratic; the sequences above cover long texts
            continue
        h = zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            looped += 1
        found = brute(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[d["doc_id"]]
        assert r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == sha(brute_collapsed(w, found))
    assert len(got) == len(docs) and looped > 5
