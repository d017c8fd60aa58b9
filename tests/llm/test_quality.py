"""The quality ledger against a plain version."""

from collections import Counter

from floodspark.llm import quality
from llm_rows import awkward, table, words


def plain(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines),
            sum(c.isascii() and c.isalpha() for c in text), sum(c.isascii() and c.isupper() for c in text),
            sum(a == b for a, b in zip(w, w[1:])))


def test_measures_and_bits(spark):
    rows = awkward() + [(70, "SHOUT " * 30), (71, "a | b ### " * 9), (72, "x y\n" * 30)]
    out = quality.ledger(table(spark, rows)).collect()
    assert Counter((r["doc_id"], *[r[m] for m in quality.MEASURES]) for r in out) == Counter((i, *plain(t)) for i, t in rows)
    names = [n for n, _ in quality.RULES]
    for r in out:
        values = {m: r[m] for m in quality.MEASURES}
        bits = sum(1 << k for k, (_, c) in enumerate(quality.RULES)
                   if eval(c.replace("AND", "and").replace("OR", "or"), {}, values))
        assert r["failed_bits"] == bits, (values, names)


def test_policies_and_ablation_read_the_ledger(spark):
    rows = quality.ledger(table(spark, awkward() + [(70, "SHOUT " * 30)])).cache()
    kept = rows.where(quality.passes()).count()
    table_ = {r["rule"]: r for r in quality.ablation(rows).collect()}
    bits = [r["failed_bits"] for r in rows.collect()]
    for k, (name, _) in enumerate(quality.RULES):
        assert (table_.get(name) or {"fails": 0})["fails"] == sum(b >> k & 1 for b in bits)
        assert table_[name]["fails_alone"] == sum(b == 1 << k for b in bits)
        assert table_[name]["kept_without"] == kept + sum(b == 1 << k for b in bits)
    assert rows.where(quality.passes("base")).count() == sum(b & 3 == 0 for b in bits)


def test_keep_leaves_columns_alone(spark):
    rows = awkward()
    df = table(spark, rows)
    out = quality.keep(df)
    assert out.columns == df.columns
    ledger = quality.ledger(df)
    assert out.count() == ledger.where(quality.passes()).count()
    assert quality.keep(table(spark, [])).count() == 0 and quality.ledger(table(spark, [])).count() == 0
