"""Damage fractions and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark import fixed


def piecewise(x: Column, xs, ys) -> Column:
    """Linear between tabulated points and clamped at both ends, as one CASE."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        slope = round(y1 - y0, 10) / (x1 - x0)  # 0.53 - 0.32 is not 0.21
        out = out.when(x < x1, F.lit(float(y0)) + (x - x0) * slope)
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(ys[-1]))))


def damage_fraction(depth: Column, curve: str = "residential") -> Column:
    if curve not in fixed.DAMAGE_CURVES:
        raise ValueError(f"unknown damage curve {curve!r}; available: {sorted(fixed.DAMAGE_CURVES)}")
    return piecewise(depth, fixed.CURVE_DEPTHS, fixed.DAMAGE_CURVES[curve])


def damage_fraction_of(depth: Column, curve: Column) -> Column:
    """The curve's name comes from a column; an unknown name is an error."""
    out = None
    for name in fixed.DAMAGE_CURVES:
        branch = damage_fraction(depth, name)
        out = F.when(curve == name, branch) if out is None else out.when(curve == name, branch)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown damage curve "), curve)).cast("double"))


def around(central: Column, unit: str = "INR") -> Column:
    """Central value with its factor-of-two range; the range always travels along."""
    return F.struct(central.alias("central"), (central * fixed.RANGE_LOW).alias("low"),
                    (central * fixed.RANGE_HIGH).alias("high"), F.lit(unit).alias("unit"))


def in_crore(value: Column) -> Column:
    return value / fixed.CRORE


def round_significant(x: Column, digits: int = 2) -> Column:
    """Half-even rounding to significant figures; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x / scale, 0) * scale)


def _plain(x: Column) -> Column:
    """Thousands separators, decimals only where there are some."""
    whole = F.format_number(x, 0)
    return F.when(x == F.floor(x), whole).otherwise(
        F.regexp_replace(F.format_number(x, 4), r"0+$", ""))


def format_crore(low: Column, high: Column) -> Column:
    note = " (order-of-magnitude estimate)"
    return (F.when(in_crore(high) < 1.0, F.lit("under Rs 1 crore" + note))
             .otherwise(F.concat(F.lit("Rs "), _plain(round_significant(in_crore(low))), F.lit("-"),
                                 _plain(round_significant(in_crore(high))), F.lit(" crore" + note))))
