"""Open-channel and breach hydraulics as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark import fixed

G = fixed.GRAVITY


def velocity(h: Column, q: Column, h_min: float = fixed.H_MIN_M) -> Column:
    """Velocity from discharge, exact where the depth is resolved, damped below ``h_min``."""
    den = h * h + F.greatest(h * h, F.lit(h_min * h_min))
    return F.when(den <= 0, 0.0).otherwise(2.0 * h * q / den)


def speed(h: Column, hu: Column, hv: Column, h_min: float = fixed.H_MIN_M) -> Column:
    u, v = velocity(h, hu, h_min), velocity(h, hv, h_min)
    return F.sqrt(u * u + v * v)


def surface_fill(eta: Column, z: Column, where: Column) -> Column:
    return F.when(where, F.greatest(F.lit(0.0), eta - z)).otherwise(0.0)


# --- breach growth and weirs -----------------------------------------------------------

def growth_fraction(t: Column, formation_s: Column, mode: Column) -> Column:
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t / formation_s))
    return (F.when((mode == "instant") | (formation_s <= 0), 1.0)
             .when(mode == "linear", x)
             .when(mode == "erosion", x * x * (3.0 - 2.0 * x))
             .otherwise(F.raise_error(F.concat(F.lit("unknown growth mode "), mode)).cast("double")))


def breach_width(fraction: Column, bottom_width: Column) -> Column:
    return bottom_width * fraction


def breach_invert(fraction: Column, crest: Column, final_invert: Column) -> Column:
    return crest - (crest - final_invert) * fraction


def submergence_factor(head: Column, tail: Column) -> Column:
    ratio = tail / head
    return (F.when(head <= 0, 0.0).when(ratio <= fixed.SUBMERGENCE_LIMIT, 1.0)
             .when(ratio >= 1, 0.0).otherwise(F.pow(1.0 - F.pow(ratio, F.lit(1.5)), F.lit(0.385))))


def weir_outflow(level: Column, invert: Column, width: Column, side: Column,
                 tailwater: Column | None = None) -> Column:
    head = level - invert
    q = (fixed.C_WEIR * width * F.pow(head, F.lit(1.5))
         + F.when(side > 0, fixed.C_SIDE * side * F.pow(head, F.lit(2.5))).otherwise(0.0))
    if tailwater is not None:
        drowned = submergence_factor(head, F.greatest(tailwater - invert, F.lit(0.0)))
        q = q * F.when(tailwater.isNull(), 1.0).otherwise(drowned)
    return F.when((head <= 0) | (width <= 0), 0.0).otherwise(q)


def critical_velocity(head: Column) -> Column:
    return F.when(head <= 0, 0.0).otherwise(F.sqrt(2.0 * G * head / 3.0))


def breach_velocity(q: Column, head: Column, width: Column, side: Column) -> Column:
    depth = 2.0 * head / 3.0
    area = width * depth + side * depth * depth
    return F.when((q <= 0) | (head <= 0) | (width <= 0) | (area <= 0), 0.0).otherwise(q / area)


# --- empirical peaks ---------------------------------------------------------------------

def froehlich_peak(volume: Column, head: Column) -> Column:
    return F.when((volume <= 0) | (head <= 0), 0.0).otherwise(
        0.607 * F.pow(volume, F.lit(0.295)) * F.pow(head, F.lit(1.24)))


def usbr_peak(head: Column) -> Column:
    return F.when(head <= 0, 0.0).otherwise(19.1 * F.pow(head, F.lit(1.85)))


def mlm_peak(volume: Column, head: Column) -> Column:
    return F.when((volume <= 0) | (head <= 0), 0.0).otherwise(
        1.154 * F.pow(volume * head, F.lit(0.412)))


def froehlich_geometry(volume: Column, head: Column, mode: Column) -> Column:
    """``STRUCT<width_m, time_s>`` used when no breach geometry is given."""
    ko = F.when(mode == "overtopping", 1.4).otherwise(1.0)
    width = 0.1803 * ko * F.pow(volume, F.lit(0.32)) * F.pow(head, F.lit(0.19))
    hours = 0.00254 * F.pow(volume, F.lit(0.53)) * F.pow(head, F.lit(-0.90))
    ok = (volume > 0) & (head > 0)
    return F.struct(F.when(ok, width).alias("width_m"), F.when(ok, hours * 3600.0).alias("time_s"))


def peak_disagrees(routed: Column, low: Column, high: Column) -> Column:
    return (routed > high * 1.5) | (routed < low / 1.5)


# --- breach geometry and reservoir storage ---------------------------------------------------

def top_width(bottom: Column, head: Column, side: Column) -> Column:
    return bottom + 2.0 * side * F.greatest(head, F.lit(0.0))


def max_bottom_width(crest_length: Column, head: Column, side: Column) -> Column:
    return F.greatest(F.lit(0.0), crest_length - 2.0 * side * F.greatest(head, F.lit(0.0)))


def fits_crest(bottom: Column, head: Column, side: Column, crest_length: Column) -> Column:
    return crest_length.isNull() | (top_width(bottom, head, side) <= crest_length + 1e-9)


def widest_fit(crest_length: Column, head: Column, side: Column, fraction: Column) -> Column:
    """Bottom width of the widest breach that fits, scaled by top width; NULL if none fits."""
    bottom = max_bottom_width(crest_length * fraction, head, side)
    return F.when((fraction > 0) & (fraction <= 1) & (head > 0) & (bottom > 0), bottom)


def storage_exponent(area: Column, head: Column, volume: Column) -> Column:
    """``b = A H / V``; below 1 the two figures contradict each other."""
    b = area * head / volume
    return F.when(b < 1, F.raise_error(F.concat(
        F.lit("storage exponent below 1: "), b.cast("string"))).cast("double")).otherwise(b)


def power_area(level: Column, bed: Column, full: Column, volume: Column, b: Column) -> Column:
    depth = full - bed
    h = F.greatest(level - bed, F.least(F.lit(1.0), depth))
    return b * volume * F.pow(h, b - 1.0) / F.pow(depth, b)


def power_storage(level: Column, bed: Column, full: Column, volume: Column, b: Column) -> Column:
    return volume * F.pow(F.greatest(level - bed, F.lit(0.0)) / (full - bed), b)


def shape_word(b: Column) -> Column:
    return (F.when(b < 1.3, "near vertical-sided").when(b < 2.3, "wedge-shaped valley")
             .when(b < 3.3, "conical / steep valley").otherwise("deep narrow gorge"))


def blockage_geometry(deposit_m3: Column, valley_width: Column, dx: Column,
                      bulking: Column | None = None) -> Column:
    """Deposit height, impounded volume and lake area behind a landslide dam.

    ``bulking`` multiplies the deposit volume when given; nothing is assumed otherwise.
    """
    reach = F.lit(fixed.BLOCKAGE_REACH_M)
    volume = deposit_m3 if bulking is None else deposit_m3 * F.coalesce(bulking, F.lit(1.0))
    unclear = valley_width.isNull() | (valley_width < 3.0 * dx)
    width = F.when(unclear, F.greatest(F.lit(300.0), 4.0 * dx)).otherwise(valley_width)
    height = volume / reach / (0.65 * width)
    return F.struct(width.alias("width_m"), unclear.alias("width_assumed"), height.alias("height_m"),
                    (0.4 * height * width * reach).alias("impounded_m3"),
                    (width * reach).alias("lake_m2"), (0.3 * width).alias("bottom_m"))


def breach_section(crest: Column, mwl: Column, frl: Column, height: Column, depth: Column,
                   want_bottom: Column, side: Column, crest_length: Column) -> Column:
    """Crest, bed and invert of a dam breach and the bottom width the crest allows."""
    top = F.coalesce(crest, mwl, frl + 5.0)
    bed = top - height
    invert = F.greatest(top - F.coalesce(depth, height), bed)
    head = top - invert
    bottom = F.when(crest_length.isNull(), want_bottom).otherwise(
        F.least(want_bottom, max_bottom_width(crest_length, head, side)))
    return F.struct(top.alias("crest_m"), bed.alias("bed_m"), invert.alias("invert_m"),
                    head.alias("head_m"), bottom.alias("bottom_m"),
                    (bottom < want_bottom).alias("clamped"))


# --- analytical dam breaks ------------------------------------------------------------------------

def ritter_depth(x: Column, t: Column, h0: Column, x0: Column) -> Column:
    c0, xi = F.sqrt(G * h0), (x - x0) / t
    moving = (F.when(xi <= -c0, h0)
               .when(xi < 2.0 * c0, (2.0 * c0 - xi) * (2.0 * c0 - xi) / (9.0 * G)).otherwise(0.0))
    return F.when(t <= 0, F.when(x < x0, h0).otherwise(0.0)).otherwise(moving)


def ritter_velocity(x: Column, t: Column, h0: Column, x0: Column) -> Column:
    c0, xi = F.sqrt(G * h0), (x - x0) / t
    fan = (t > 0) & (xi > -c0) & (xi < 2.0 * c0)
    return F.when(fan, 2.0 / 3.0 * (xi + c0)).otherwise(0.0)


def ritter_front(t: Column, h0: Column, x0: Column) -> Column:
    return x0 + 2.0 * F.sqrt(G * h0) * t


def ritter_discharge(h0: Column) -> Column:
    return 8.0 / 27.0 * math.sqrt(G) * F.pow(h0, F.lit(1.5))


def stoker_state(hl: Column, hr: Column, steps: int = 60) -> Column:
    """Middle state of the wet-bed dam break: ``STRUCT<hm, u2, shock>``.

    Both branches are monotone between the two wave speeds, so a fixed number of
    bisections pins the root, for all rows of a batch together; run it once per
    scenario row, not per cell.  The fields are NULL unless ``hl > hr > 0``.
    """
    g = G

    def middle(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        hl, hr = left.to_numpy(dtype=float), right.to_numpy(dtype=float)
        wet = (hr > 0) & (hl > hr)
        hl, hr = np.where(wet, hl, 2.0), np.where(wet, hr, 1.0)
        cl = np.sqrt(g * hl)
        lo, hi = np.sqrt(g * hr), cl
        for _ in range(steps):
            mid = (lo + hi) / 2.0
            hm = mid * mid / g
            high = 2.0 * (cl - mid) > (hm - hr) * np.sqrt(0.5 * g * (1.0 / hm + 1.0 / hr))
            lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
        cm = (lo + hi) / 2.0
        hm = cm * cm / g
        with np.errstate(divide="ignore", invalid="ignore"):  # states closer than a double can tell
            out = pd.DataFrame({"hm": hm, "u2": 2.0 * (cl - cm), "shock": hm * 2.0 * (cl - cm) / (hm - hr)})
        out.loc[~wet] = np.nan
        return out

    return F.pandas_udf(middle, "hm double, u2 double, shock double")(hl.cast("double"), hr.cast("double"))


def stoker_depth(x: Column, t: Column, hl: Column, hr: Column, x0: Column, state: Column) -> Column:
    cl, cm, xi = F.sqrt(G * hl), F.sqrt(G * state["hm"]), (x - x0) / t
    moving = (F.when(xi <= -cl, hl)
               .when(xi <= state["u2"] - cm, (2.0 * cl - xi) * (2.0 * cl - xi) / (9.0 * G))
               .when(xi < state["shock"], state["hm"]).otherwise(hr))
    return F.when(t <= 0, F.when(x < x0, hl).otherwise(hr)).otherwise(moving)


def stoker_velocity(x: Column, t: Column, hl: Column, x0: Column, state: Column) -> Column:
    cl, cm, xi = F.sqrt(G * hl), F.sqrt(G * state["hm"]), (x - x0) / t
    moving = (F.when(xi <= -cl, 0.0).when(xi <= state["u2"] - cm, 2.0 / 3.0 * (xi + cl))
               .when(xi < state["shock"], state["u2"]).otherwise(0.0))
    return F.when(t <= 0, 0.0).otherwise(moving)


def inflow_speed(unit_q: Column) -> Column:
    """Critical speed of the head that passes ``unit_q`` per metre of width."""
    head = F.pow(unit_q * 27.0 / (8.0 * math.sqrt(G)), F.lit(2.0 / 3.0))
    return F.when(unit_q <= 0, 0.0).otherwise(F.sqrt(G * head))
