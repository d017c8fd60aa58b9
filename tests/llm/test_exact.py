"""Exact duplicates: groups against plain counting, with and without colliding hashes, and the plan's hot groups."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from floodspark.llm import exact
from llm_rows import awkward, prose, table
from pyspark.sql import functions as F


def plain(rows, best, normal=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t or "")].append(i)
    out = Counter()
    for i, t in rows:
        body = normal(t or "")
        ids = [x for x in groups[body] if x is not None]
        keep = best(ids) if ids else None
        out[i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


def rows():
    rng = random.Random(7)
    out = awkward() + [(1000 + i, prose(rng, 2, 6)) for i in range(300)] + [(2000 + i, "hot group") for i in range(250)]
    return out + [(3000, "Hot Group"), (3001, "hot group "), (3002, "\0"), (3003, ""), (3004, None)]


def got(df):
    return Counter(tuple(r) for r in df.collect())


HASHES = {"128 bits": exact.content_hash, "4 bits": lambda b: F.unhex(F.substring(F.md5(b.cast("binary")), 1, 1)),
          "none": lambda b: F.when(b.isNull(), F.lit(b"")).otherwise(F.lit(b"x"))}


@pytest.mark.parametrize("hashed", list(HASHES))
@pytest.mark.parametrize("share", [512, 3])
def test_groups(spark, hashed, share, monkeypatch):
    monkeypatch.setattr(exact, "SHARE", share)
    df = table(spark, rows())
    assert got(exact.exact_groups(df, "largest", hashed=HASHES[hashed])) == plain(rows(), max)
    assert got(exact.exact_groups(df, hashed=HASHES[hashed])) == plain(rows(), min)


def test_normalised_texts_and_empty_tables(spark):
    lower = exact.exact_groups(table(spark, rows()), normalise=F.lower)
    assert got(lower) == plain(rows(), min, str.lower)
    assert exact.exact_groups(table(spark, [])).count() == 0
    text_ids = [(str(i), t) for i, t in rows() if i is not None]
    assert got(exact.exact_groups(table(spark, text_ids, kind="string"))) == plain(text_ids, min)


def test_drop_copies_keeps_one_row_of_each(spark):
    distinct = {(i, t or ""): (i, t) for i, t in rows() if i is not None}
    df = table(spark, list(distinct.values()))
    kept = exact.drop_copies(df, keep="largest")
    assert kept.columns == df.columns
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in distinct.values())
    want = {k for k in want if any(x[0] == k[0] and x[4] == k[1] and x[3] for x in plain(list(distinct.values()), max))}
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == Counter(want)


def test_no_python_on_the_path(spark, capsys):
    exact.exact_groups(table(spark, rows())).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
