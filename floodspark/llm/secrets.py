"""Secret scans: fixed shapes, and sliding-window entropy per character class over long runs.

DataFrame functions only.  A run's windows are visited left to right; the sum of c * log2(c) over the
window's character counts changes by the one count that falls and the one that rises.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import whole
from floodspark.llm.spans import BLOCK, below, cut_out, located, matches, running, tagged, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
#: A shorter match of these two can't be part of a longer one, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE_CHARS = 6


@dataclass(frozen=True)
class Class:
    """Runs of a character class; a window of ``window`` characters is suspect from ``bits`` bits on."""
    name: str
    pattern: str
    window: int
    bits: float


CLASSES = (Class("entropy_hex", "[0-9A-Fa-f]{20,}", 20, 3.0), Class("entropy_base64", "[A-Za-z0-9+/_=-]{20,}", 20, 3.7))
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
#: Runs that look random to a count but aren't secrets.
ALLOWED = (
    r"^[^0-9]*$", r"^[^A-Za-z]*$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567|abcdefg",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[a-z0-9]+([-_/][a-z0-9]+)+$",
)


def entropy_range(chars: str, window: int, bits: float) -> str:
    """SQL: ``lo, hi`` (characters, end excluded) from the first to the last suspect window, or -1."""
    gain = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(window + 2)) + ")"
    count = lambda of, at, n: f"size(filter(slice({chars}, {at}, {n}), c -> c = {of}))"
    out, inn = f"{chars}[i - {window} - 1]", f"{chars}[i - 1]"
    fall = f"""IF(i > {window}, element_at({gain}, {count(out, f'i - {window}', window)} + 1)
                  - element_at({gain}, {count(out, f'i - {window}', window)}), 0D)"""
    before = count(inn, f"greatest(i - {window} + 1, 1)", f"least(i - 1, {window - 1})")
    rise = f"element_at({gain}, {before} + 2) - element_at({gain}, {before} + 1)"
    high = f"i >= {window} AND {math.log2(window)!r}D - s / {window} >= {bits!r}D"
    return f"""aggregate(sequence(1, size({chars})), named_struct('s', 0D, 'lo', -1, 'hi', -1), (acc, i) ->
      transform(array(acc.s - {fall} + {rise}), s -> named_struct(
        's', s, 'lo', IF({high} AND acc.lo < 0, i - {window}, acc.lo), 'hi', IF({high}, i, acc.hi)))[0],
      acc -> named_struct('lo', acc.lo, 'hi', acc.hi))"""


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", keep_text: bool = False) -> DataFrame:
    """``keep`` and ``spans (list of start, kind, end)`` per row; ``kind`` numbers ``KINDS``.

    The first three kinds are the fixed shapes, whole; entropy adds the part of a run from its first to
    its last suspect window unless a fixed shape has the run already or the allow-list names it.  A
    null text is empty, a row without a secret has an empty list, repeated rows keep a row each.
    """
    rows = docs.select(F.struct(*keep).alias("_row"), whole(text).alias("t"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {c.name: c.pattern for c in CLASSES}
    rows = rows.select("_row", "t", *[matches("t", p).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select("_row", "t", *[located("t", f"m_{k}", p).alias(k) for k, p in patterns.items()])
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2))
    rows = rows.withColumn("assign", F.filter("assign", lambda s: value(s) >= VALUE_CHARS))
    base = F.concat(*[tagged(k, n) for n, k in enumerate(KINDS[:3])])
    rows = rows.withColumn("base", base)
    # a base span that holds another one begins no later and, of those that do, one ends no earlier
    rows = rows.withColumn("starts", F.expr("transform(array_sort(base), b -> b.start)")).withColumn(
        "reach", F.expr(running("transform(array_sort(base), b -> b.end)", "greatest(x, y)")))
    # named twice, so that the optimiser computes it once and not for every run
    inside = f"size(reach) > 0 AND coalesce(get(reach, {below('starts', 's.start', True)} - 1) >= s.end, false)"
    allowed = lambda s: F.array_contains(F.array(*[s["match"].rlike(p) for p in ALLOWED]), True)
    for c in CLASSES:
        rows = rows.withColumn(c.name, F.transform(
            F.filter(F.expr(f"filter({c.name}, s -> NOT ({inside}))"), lambda s: ~allowed(s)),
            lambda s: F.struct(s["start"].alias("start"), F.regexp_extract_all(s["match"], F.lit("(?s)."), F.lit(0)).alias("chars"))))
        ranges = F.expr(f"transform({c.name}, r -> named_struct('at', r.start, 'range', "
                        f"{entropy_range('r.chars', c.window, c.bits)}))")
        rows = rows.withColumn(c.name, ranges)
    added = [F.expr(f"transform(filter({c.name}, r -> r.range.lo >= 0), r -> named_struct("
                    f"'start', r.at + r.range.lo, 'kind', {k}, 'end', r.at + r.range.hi))") for k, c in enumerate(CLASSES, 3)]
    spans = F.array_sort(F.concat("base", *added))
    if keep_text:
        return rows.select("_row", "t", spans.alias("spans"))
    return rows.select("_row.*", spans.alias("spans"))


def mask(text: str, spans: str, by: str = "[SECRET]") -> Column:
    """``text`` with the union of its sorted spans replaced; overlapping spans become one.

    A span that begins at or after all earlier ends opens a stretch; the stretch ends where the next one opens, at the
    furthest end so far.  What lies between the stretches is cut out of blocks and joined once.
    """
    reach = running(f"transform({spans}, s -> s.end)", "greatest(x, y)")
    return F.expr(f"""
      IF(size({spans}) = 0, {text}, transform(array(named_struct('reach', {reach}, 'parts', regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0))), g ->
        transform(array(filter(sequence(0, size({spans}) - 1), i -> i = 0 OR get({spans}, i).start >= get(g.reach, i - 1))), opens ->
          concat(
            array_join(transform(opens, (i, k) -> concat(
              IF(k = 0, {cut_out('g.parts', '0', f'get({spans}, 0).start')},
                 {cut_out('g.parts', 'get(g.reach, i - 1)', f'(get({spans}, i).start - get(g.reach, i - 1))')}), '{by}')), ''),
            {cut_out('g.parts', f'get(g.reach, size({spans}) - 1)', f'(length({text}) - get(g.reach, size({spans}) - 1))')}))[0])[0])""")


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced and, where there is such a column, its length renewed.

    Null texts stay null; all rows and columns stay.
    """
    found = scan(docs, docs.columns, text, keep_text=True).withColumn("_text", mask("t", "spans", by))
    new = F.when(F.col(f"_row.{text}").isNotNull(), F.col("_text"))
    length = F.when(F.size("spans") > 0, F.length("_text").cast("long")).otherwise(
        F.col(f"_row.{n_chars}")) if n_chars in docs.columns else None
    return found.select(*[new.alias(c) if c == text else length.cast(docs.schema[c].dataType).alias(c) if c == n_chars
                          else F.col(f"_row.{c}").alias(c) for c in docs.columns])


def counted(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def base_digest() -> Column:
    """SHA-256 of the fixed shapes' spans, by start."""
    return F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3), KINDS), 256)
