"""Fill-in-middle: piece tables, whole results against slicing, exact round trips."""

import hashlib
import random
from collections import Counter

import pytest
from floodspark.llm import fim
from llm_rows import awkward, prose, table


def plain(i, text):
    t = text or ""
    key = "" if i is None else str(i)
    x = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h = [int(x[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, t
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def rows():
    rng = random.Random(2)
    out = awkward() + [(500 + i, prose(rng, rng.randrange(1, 9))) for i in range(150)]
    out += [(700 + i, x * 3) for i, x in enumerate(("<P>", "a<S>b", "<M", "<", "<P", "S>", "<<P", "P>", "🙂é", "<‍>", "\x00a"))]
    return out + [(800 + i, "<" * k) for i, k in enumerate(range(1, 30))]


def test_every_row_against_slicing(spark):
    got = fim.fill_in_middle(table(spark, rows())).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in rows():
        form, prefix, middle, out = plain(i, t)
        want[i, len(t or ""), form, prefix, middle, out, sha(out), sha(t or "")] += 1
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["output_sha256"],
                    r["restored_sha256"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(table(spark, [])).count() == 0


def test_restore_gives_every_text_back(spark):
    out = fim.fill_in_middle(table(spark, [(i, t) for i, t in rows() if i is not None]), fim.Recipe(seed=5, transformed=100, spm=50))
    back = fim.restore(out).collect()
    assert Counter((r["doc_id"], r["restored"]) for r in back) == Counter((i, t or "") for i, t in rows() if i is not None)
    for r in back:  # the descriptors describe the output
        assert sum(p["length"] for p in r["pieces"]) == len(r["output"].encode())
    nulls = spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string")
    assert [r["restored"] for r in fim.restore(nulls).collect()] == [None, None]


@pytest.mark.parametrize("form", list(fim.FORMS))
def test_pieces_split_permute_and_return(form):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("<>PSMa") for _ in range(rng.randrange(1, 12)))
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        raw = text.encode()
        table_ = fim.PieceTable(raw)
        for at in sorted((rng.randrange(len(raw) + 1), rng.randrange(len(raw) + 1))):
            table_.cut(at)
        assert table_.content() == raw and len(table_.pieces) == 3
        table_.arrange(fim.FORMS[form])
        out = table_.content()
        assert table_.sha256() == hashlib.sha256(out).hexdigest()
        assert fim.restored(out, form).content() == raw
        table_.restore(fim.FORMS[form])
        assert table_.content() == raw


def test_other_texts_are_refused():
    for bad in (b"", b"<P>a", b"<P>a<M>b<S>c"):
        with pytest.raises(ValueError):
            fim.restored(bad, "psm")
    with pytest.raises(IndexError):
        fim.PieceTable(b"ab").cut(3)
