"""Positions of regular-expression matches as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: int, end: int, match: string>"


def literal(pattern: str) -> str:
    """The pattern as a SQL string literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def matches(text: str, pattern: str) -> Column:
    """All leftmost, non-overlapping matches."""
    return F.expr(f"regexp_extract_all({text}, {literal(pattern)}, 0)")


def running(values: str, step: str = "x + y") -> str:
    """SQL: the running result of ``step`` (of an earlier ``x`` and a later ``y``, associative) over an array.

    Spans of one, two, four and more elements are united in turn: as many passes as the length has binary digits.
    """
    joined = step.replace("x", "get(acc, i - shiftleft(1, k))").replace("y", "v")
    return f"""transform(array({values}), a -> aggregate(sequence(0, CAST(ceil(log2(greatest(size(a), 1))) AS INT)), a, (acc, k) ->
      transform(acc, (v, i) -> IF(i >= shiftleft(1, k), {joined}, v))))[0]"""


def below(ordered: str, value: str, equal: bool = False) -> str:
    """SQL: how many elements of a sorted array are less than ``value`` (or equal), by halving."""
    sign = "<=" if equal else "<"
    return f"""aggregate(sequence(CAST(floor(log2(greatest(size({ordered}), 1))) AS INT), 0, -1), 0, (p, k) ->
      IF(p + shiftleft(1, k) <= size({ordered}) AND get({ordered}, p + shiftleft(1, k) - 1) {sign} {value}, p + shiftleft(1, k), p))"""


def located(text: str, found: str, pattern: str) -> Column:
    """``found`` (the matches of ``pattern`` in ``text``) as ``SPAN`` rows in code points, ends excluded.

    What ``split`` leaves between the matches has the lengths that lead from one match to the next: running sums of
    them are the ends.  Only texts with a match are split.
    """
    ends = running(f"""zip_with({found}, slice(split({text}, {literal(pattern)}, -1), 1, size({found})),
                       (m, gap) -> length(gap) + length(m))""")
    return F.expr(f"""
      CASE WHEN size({found}) = 0 THEN CAST(array() AS array<{SPAN}>) ELSE
        zip_with({found}, {ends}, (m, e) -> named_struct('start', e - length(m), 'end', e, 'match', m)) END""")


#: Code points of the blocks in which a text is looked up.
BLOCK = 4096


def blocks(text: str) -> Column:
    """A text in blocks of ``BLOCK`` code points, so that a place far inside it is near its block's beginning."""
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut_out(parts: str, start: str, length: str) -> str:
    """SQL: ``length`` code points from ``start`` (from 0) of the text whose blocks are ``parts``."""
    first, last = f"CAST({start} DIV {BLOCK} AS INT)", f"CAST(({start} + greatest({length}, 1) - 1) DIV {BLOCK} AS INT)"
    return f"substring(array_join(slice({parts}, {first} + 1, {last} - {first} + 1), ''), {start} - {first} * {BLOCK} + 1, {length})"


def tagged(spans: str, kind: int) -> Column:
    """Spans with their kind's number, in the order ``start, kind, end``."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"),
                                                 s["end"].alias("end")))


def written(spans: Column, kinds: tuple[str, ...], by_start: bool = True) -> Column:
    """Tagged spans as ``kind:start:end``, comma-joined, by start and kind or by kind and start."""
    names = F.array(*[F.lit(k) for k in kinds])
    key = ("start", "kind", "end") if by_start else ("kind", "start", "end")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(*[s[k].alias(k) for k in key])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
