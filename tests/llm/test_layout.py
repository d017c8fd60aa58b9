"""Sharding and packing: laws that the results must keep, and plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from floodspark.llm import packing, sharding
from floodspark.llm.queries import RANKS, VOCABULARY
from pyspark.sql import functions as F
from llm_rows import awkward, prose, table
from tokenizers import Tokenizer


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(3)
    rows = awkward() + [(1000 + i, prose(rng, 3)) for i in range(300)] + [(7, "hot key")] * 150
    out = sharding.shard_documents(table(spark, rows), 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(table(spark, []), 8).count() == 0


def test_few_keys_move_to_a_new_shard(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    shard = lambda n, slack: {r["doc_id"]: r["shard"] for r in sharding.shard_documents(df, n, slack=slack).collect()}
    for slack, most in ((0.25, 0.2), (0.0, 0.35)):
        a, b = shard(8, slack), shard(9, slack)
        assert sum(a[k] != b[k] for k in a) < most * len(a)
        assert max(Counter(b.values()).values()) <= -(-4000 * (1 + slack) // 9) + 1


def test_plan_walks_clockwise():
    points = [(10, 0), (20, 1), (30, 0), (40, 2)]
    steps = sharding.plan({0: 3, 1: 5, 2: 1, 3: 0}, points, [3, 3, 3])
    assert steps == [(0, 0, 3, 0, 0), (1, 0, 3, 1, 0), (1, 3, 5, 2, 0), (2, 0, 1, 2, 2)]


def test_pieces_equal_the_tokenizer(spark):
    full = Tokenizer.from_file(VOCABULARY)
    rows = awkward() + [(90, "before <|endoftext|> after"), (91, "日本語 テキスト ١٢٣ \x1c\x85 ½ ²"), (92, "it's  we'll\n\n don’t — £5 Ünïcödé")]
    out = defaultdict(list)
    for r in packing.pieces(table(spark, rows), VOCABULARY, RANKS, 64, with_ids=True).collect():
        out[r["doc_id"]].append(r)
    want = defaultdict(Counter)
    for i, t in rows:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        first = len(ids) % 64 or 64 if len(ids) > 64 else len(ids)
        for k, at in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[at:first] if not k else ids[at:at + 64]
            want[i][k, at, len(part), tuple(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = {i: Counter((r["piece"], r["start"], r["length"], tuple(r["ids"]), r["ids_crc32"]) for r in rs) for i, rs in out.items()}
    assert got == dict(want)


def check_packed(out, capacity):
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    return len(by)


def test_packing_is_whole_and_dense(spark):
    rng = random.Random(6)
    rows = awkward() + [(1000 + i, prose(rng, rng.randrange(1, 60))) for i in range(300)]
    df = table(spark, rows)
    out = packing.pack(df, VOCABULARY, RANKS, 128).collect()
    cut_up = packing.pieces(df, VOCABULARY, RANKS, 128).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, out)) == Counter(map(key, cut_up))
    assert check_packed(out, 128) <= 1.02 * sum(r["length"] for r in out) / 128 + 2
    assert packing.pack(table(spark, []), VOCABULARY, RANKS).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_histogram_plan_equals_best_fit_over_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice((16, 50, 128))
    lengths = [rng.randrange(1, capacity + 1) for _ in range(400)] + [rng.randrange(1, 6)] * 300
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        k = min(fits, key=lambda k: room[k], default=None)
        if k is None:
            room.append(capacity - n)
        else:
            room[k] -= n
    steps = packing.best_fit(dict(Counter(lengths)), capacity)
    rows = [{"sequence_id": first + (r - low) // per, "offset": base + (r - low) % per * n, "length": n}
            for n, low, high, first, per, base in steps for r in range(low, high)]
    assert Counter(r["length"] for r in rows) == Counter(lengths)
    assert check_packed(rows, capacity) == len(room)
