"""Awkward tables and plain reference versions for the tests of the corpus operators."""

import random
import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("t", "n", "h", "fp", "body", "spans", "kind", "start", "length", "base", "root", "shard", "slot", "words",
            "row", "_m", "_row", "n_words", "kept", "score")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def awkward(seed=1):
    """``(doc_id, text)``: nulls, blanks, non-ASCII, repeated rows, ids that occur twice, short and long texts."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    out = [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (None, "no id here"), (None, None), (4, "one"), (5, "Zwei Wörter"),
           (6, " em space kept \U0001F600 x"), (7, "a " * 50), (8, "line one\nline one\n\nline two\nline one")]
    out += [(9, prose(rng, 120))] * 3
    out += [(10, prose(rng, 40)), (10, prose(rng, 45))]
    out += [(20 + i, prose(rng, 30) + "\n" + shared + " " + prose(rng, 25)) for i in range(4)]
    out += [(40, prose(rng, 6000)), (41, "x" * 5000), (42, "9" * 3000), (43, "1 2 " * 700), (44, "a@b.c" + ".d" * 3000)]
    return out


def table(spark, rows, extra=True, kind="long"):
    """A DataFrame of ``doc_id, text`` and, with ``extra``, columns named like the operators' own."""
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    if extra:
        for name in CLASHING:
            df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def words(text):
    return WORD.findall(text or "")
