"""The pipeline's near duplicates against brute force over sets of five-word shingles."""

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from floodspark.llm import components, overlap, simhash
from floodspark.llm.common import whole
from llm_rows import awkward, prose, table, words
from test_pairs import near_copies, plain_fingerprint, plain_shingles, roots


def edited():
    """Copies with one to six changed words: more than 3 bits apart, overlaps around 0.8."""
    rng = random.Random(5)
    out = []
    for g in range(30):
        base = prose(rng, rng.choice((40, 150, 400)), 5000).split()
        out.append((3000 + 10 * g, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            for _ in range(rng.randrange(1, 7)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            out.append((3000 + 10 * g + k, " ".join(copy)))
    return out


def plain_set(text):
    return set(plain_shingles([w.lower() for w in words(text)]))


def alike(x, y):
    return bool(x and y) and 10 * len(x & y) >= 8 * len(x | y)


def test_pipeline_joins_all_texts_that_overlap(spark):
    rows = awkward() + near_copies() + edited()
    fps, sets = [plain_fingerprint(t) for _, t in rows], [plain_set(t) for _, t in rows]
    near = [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    over = [(i, j) for i, j in combinations(range(len(rows)), 2) if alike(sets[i], sets[j])]
    assert len(set(over) - set(near)) > 30
    root = roots(len(rows), near + over)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "").collect()
    assert len(kept) == len(set(root)) < len(set(roots(len(rows), near)))
    assert Counter(r["doc_id"] for r in kept) == Counter(least.get(r) for r in set(root))
    assert overlap.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [3, 512])
def test_tiles_and_rounds_link_the_same(spark, tile):
    rng = random.Random(6)
    base = prose(rng, 120, 5000).split()
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(i % 4 + 1):
            copy[rng.randrange(len(copy))] = f"new{rng.random()}"
        rows.append((i, " ".join(copy)))
    docs = table(spark, rows)
    marked = simhash.fingerprints(docs, 3, "doc_id", "text", overlap._sketch(whole("text")).alias("s"))
    marked = marked.select("doc_id", "body", "s.node", "s.bands").localCheckpoint()
    node = {r["doc_id"]: r["node"] for r in marked.collect()}
    links = overlap.overlap_links(marked, docs, tile=tile)
    root = {r["node"]: r["root"] for r in components.connected(links).collect()}
    sets = [plain_set(t) for _, t in rows]
    want = roots(40, [(i, j) for i, j in combinations(range(40), 2) if alike(sets[i], sets[j])])
    got = [root.get(node[i], node[i]) for i in range(40)]
    assert 1 < len(set(want)) or len(set(got)) == 1
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in combinations(range(40), 2))


def test_bands_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    hits = []
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 180, np.uint64)
        y = np.concatenate([x[:160], rng.integers(0, 1 << 63, 20, np.uint64)])  # 160 of 200
        hits.append((overlap.bands(x) == overlap.bands(y)).mean())
    assert abs(np.mean(hits) - 0.8 ** overlap.ROWS) < 0.02 and min(hits) > 0
