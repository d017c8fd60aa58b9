"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps one bit per failed rule next to the
measurements; policies are versioned masks over those bits, so a new policy or an ablation reads the
ledger and never the text again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import whole

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper",
            "n_stutters")
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
WINDOW = 8

#: Rule name and the SQL condition under which a document fails; the bit is the position.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("capitals", "10 * n_upper > 4 * n_letters"),
    ("repeated_lines", "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
    ("stutters", "10 * n_stutters > 3 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of ``rules``."""
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in self.rules)


POLICIES = {p.version: p for p in (
    Policy("base", BASE),
    Policy("2026-1", tuple(name for name, _ in RULES)),
)}
CURRENT = "2026-1"


def _repeated(ids: np.ndarray, width: int) -> int:
    """Items covered by windows of ``width`` that occur twice or more, compared exactly.

    Ranks of windows double in length; a last step overlaps two of them.
    """
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, size = ids, 1
    while size < width:
        step = min(size, width - size)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[width:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The values of ``MEASURES`` of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    repeated = _repeated(ids, WINDOW) if len(seen) < len(words) else 0
    dropped = [len(raw) - len(raw.translate(None, chars)) for chars in (BLANKS, SYMBOLS, UPPER, LOWER)]
    return (len(words), len(text) - dropped[0], dropped[1], len(lines) - len(set(lines)), repeated, len(lines),
            dropped[2] + dropped[3], dropped[2], int((ids[1:] == ids[:-1]).sum()))


def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=list(MEASURES), dtype="int64")


def _bits(source: str = "") -> Column:
    """Failure bits from the measurements, which are fields of ``source`` or columns."""
    bits = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        condition = re.sub("|".join(MEASURES), lambda m: source + m[0], condition)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, the measurements and ``failed_bits`` of every row.

    A null text is an empty one (no words; it fails ``few_words``).  Repeated rows get a row each;
    an empty table gives an empty ledger; other columns of ``docs`` are left alone.
    """
    measured = F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))
    out = docs.select(*keep, measured(whole(text)).alias("_m"))
    out = out.select(*keep, *[F.col(f"_m.{m}").alias(m) for m in MEASURES])
    return out.withColumn("failed_bits", _bits())


def passes(policy: str = CURRENT) -> Column:
    """True where a ledger row fails no rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy].mask)) == 0


def keep(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that fail no rule of the policy."""
    measured = F.pandas_udf(_measured, ", ".join(f"{m} long" for m in MEASURES))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), measured(whole(text)).alias("_m"))
    return rows.where(_bits("_m.").bitwiseAND(F.lit(POLICIES[policy].mask)) == 0).select("_row.*")


def failed_names() -> Column:
    """Names of the failed rules in a ledger row."""
    return F.array_compact(F.array(*[
        F.when(F.col("failed_bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, (name, _) in enumerate(RULES)]))


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and kept if the rule were left out.

    The ledger is first counted by its bits: at most 2 ** len(RULES) rows meet, whatever the input.
    """
    mask = POLICIES[policy].mask
    names = [name for name, _ in RULES]
    counted = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                       for r in POLICIES[policy].rules])
    each = counted.select("bits", "n", F.explode(listed).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(hit).alias("fails"), count(F.col("bits") == F.col("r.bit")).alias("fails_alone"),
        count(without).alias("kept_without"), F.lit(policy).alias("policy"))
