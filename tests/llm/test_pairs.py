"""Near duplicates, decontamination and repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from floodspark.llm import common, components, decontam, fmindex, simhash, substrings
from pyspark.sql import functions as F
from llm_rows import awkward, prose, table, words


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(seed=2):
    rng = random.Random(seed)
    out = []
    for g in range(12):
        base = prose(rng, 150).split()
        for k in range(rng.choice((1, 2, 5))):
            copy = list(base)
            for _ in range(k % 3):
                copy[rng.randrange(len(copy))] = "changed"
            out.append((500 + 10 * g + k, " ".join(copy)))
    return out


def test_near_duplicates(spark):
    rows = awkward() + near_copies()
    got = Counter((r["doc_id"], r["f"], r["component_id"]) for r in simhash.near_duplicates(table(spark, rows)).select(
        "doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == Counter((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fps, root))
    kept = simhash.keep_one(table(spark, rows)).collect()
    assert len(kept) == len(set(root))
    assert simhash.near_duplicates(table(spark, [])).count() == 0 and simhash.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [4, 16, 1024])
def test_tiles_of_any_size_link_the_same(spark, tile):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 63, 40)
    fps = {int(s) for s in seeds}
    while len(fps) < 700:  # chains of near fingerprints around few centres: crowded buckets
        fps.add(int(rng.choice(list(seeds)[:3])) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(1, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    links = simhash.hamming_links(df, 3, tile)
    got = {r["node"]: r["root"] for r in components.connected(links).collect()}
    x = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    want = roots(len(fps), [(a, b) for a, b in zip(i.tolist(), j.tolist()) if a > b])
    assert [got.get(k, k) for k in range(len(fps))] == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 200 + k) for k in range(1, 50)] + [(300, 300)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, **{200 + k: 200 for k in range(1, 50)}}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_shingles(w):
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def grams(w, size):
    return Counter(tuple(w[p:p + size]) for p in range(len(w) - size + 1))


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_contamination(spark, broadcast, monkeypatch):
    monkeypatch.setattr(common.bounded, "__defaults__", (broadcast,))
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randrange(20, 45), 5000)) for k in range(12)] + [(12, "too short"), (13, None), (14, ""), (None, prose(rng, 30, 5000))]
    items += [(15, "la la la la la la la la la la"), (16, "w1 w2 w3"), (17, "solitary")]
    rows = awkward() + [(900, prose(rng, 50) + " w1 W2 w3 " + prose(rng, 50)), (901, "w1 w2 w3"), (902, "w1 w2"), (903, prose(rng, 9) + " Solitary x")]
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        for edits in range(4):
            copy = list(w)
            for _ in range(edits):
                if len(copy) > 3:
                    at = rng.randrange(len(copy))
                    copy[at:at + 1] = rng.choice(([], ["new"], ["other", "words"]))
            # both ends changed and words inserted in the middle: the best window lies between the places that line up
            if len(w) > 16:
                half = len(w) // 2
                moved = ["first", *w[1:half], *["in"] * edits, *w[half:-1], "last"]
                rows.append((3000 + 10 * k + edits, f"{prose(rng, 12)} {' '.join(moved)} {prose(rng, 12)}"))
            rows.append((1000 + 10 * k + edits, f"{prose(rng, 30)} {' '.join(copy).upper()} {prose(rng, 20)}"))
            rows.append((2000 + 10 * k + edits, " ".join(copy)))
    low = lambda t: [x.translate(str.maketrans(decontam.CAPITALS, decontam.SMALL)) for x in words(t)]
    want = {}
    for i, t in rows:
        w = low(t)
        for k, b in items:
            v = low(b)
            best = None
            for at in range(max(1, len(w) - len(v) + 1) if v else 0):  # every window
                size = min(5, len(v))
                x, y = grams(w[at:at + len(v)], size), grams(v, size)
                similar = sum((x & y).values()) / sum((x | y).values())
                if similar >= 0.8 and (best is None or similar > best[1]):
                    best = (at, similar)
            if best:
                want[i, t, k] = (best[0], len(v), round(best[1], 9))
    assert any(len(low(b)) in (1, 3) and k in {x[2] for x in want} for k, b in items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated(table(spark, rows), bench).collect()
    got = Counter((r["doc_id"], r["item_id"], r["start"], r["n_words"], round(r["similarity"], 9)) for r in found)
    assert got == Counter((i, k, *v) for (i, _, k), v in want.items())
    assert len({k for _, _, k in want}) >= 13
    clean = decontam.keep_clean(table(spark, rows), bench)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(i for i, t in rows if not any((i, t, k) in want for k, _ in items))
    assert decontam.contaminated(table(spark, []), bench).count() == 0
    assert decontam.contaminated(table(spark, rows), bench.limit(0)).count() == 0


def plain_removal(rows, window):
    all_words = [words(t) for _, t in rows]
    seen = Counter(tuple(w[k:k + window]) for w in all_words for k in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, all_words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window,hot,shard", [(35, 4096, 400_000), (35, 3, 2_000), (9, 2, 500), (3, 4096, 10_000)])
def test_repeated_passages(spark, monkeypatch, window, hot, shard):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    rng = random.Random(window)
    passages = [prose(rng, n, 3000) for n in (34, 35, 36, 50, 80)]
    rows = awkward()
    for i in range(60):
        parts = [prose(rng, rng.randrange(1, 40), 3000)]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 30), 3000)]
        rows.append((100 + i, "\n".join(parts)))
    rows += [(300, "pad " * 36), (301, "ab cd " * 40), (302, passages[0] + " once"), (303, "x " + passages[4])]
    got = Counter(tuple(r) for r in substrings.remove_repeats(table(spark, rows), window, digest=True).collect())
    assert got == plain_removal(rows, window)
    assert substrings.remove_repeats(table(spark, []), window).count() == 0


def test_index_counts_patterns():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 30, 40)
    text = rng.integers(0, 6, lengths.sum())
    weights = rng.integers(1, 4, 40)
    index = fmindex.Index(text, lengths, weights)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    pieces = [tuple(text[a:b].tolist()) for a, b in zip(edges, edges[1:])]
    for _ in range(200):
        pattern = tuple(rng.integers(0, 6, rng.integers(1, 6)).tolist())
        low, high = np.array([0]), np.array([index.size])
        for word in reversed(pattern):
            symbol = np.searchsorted(index.alphabet, [word]) + 1
            low, high = index.extend(symbol, low, high)
        want = sum(int(w) * sum(p[k:k + len(pattern)] == pattern for k in range(len(p))) for p, w in zip(pieces, weights))
        assert index.weight(low, high)[0] == want
