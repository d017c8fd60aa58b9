"""Names, labels, formats and JSON-safe values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark import fixed


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def digits(x: Column, n: int) -> Column:
    """``x`` with ``n`` decimals, no separators, as C prints it: the double itself rounded, halves to even.

    ``format_string`` rounds the shortest decimal of a double, halves up: 255780.0 / 3600 is 71.05, as a double a
    little less, and would print as 71.1.
    """
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * n if n else "0"))


def scientific(x: Column, n: int, plus: bool = False) -> Column:
    """``x`` as ``d.ddde+xx`` with ``n`` decimals, rounded like ``digits``; ``plus`` signs positive numbers too."""
    x, pattern = x.cast("double"), F.lit("0." + "0" * n + "E00")
    whole = F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x).cast("decimal(20,0)")  # as doubles their halves go up
    shown = F.coalesce(F.call_function("format_number", whole, pattern), F.call_function("format_number", x, pattern))
    shown = F.regexp_replace(F.regexp_replace(shown, r"E(\d)", "e+$1"), "E-", "e-")
    return F.when(~shown.startswith("-"), F.concat(F.lit("+"), shown)).otherwise(shown) if plus else shown


def two_figures(v: Column) -> Column:
    """Population to two significant figures, half to even; nothing below zero."""
    mag = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(v)) - 1.0))
    return F.when(v <= 0, 0).otherwise(F.bround(v / mag, 0) * mag).cast("long")


def kml_colour(web: Column, alpha: Column) -> Column:
    """``#rrggbb`` to ``aabbggrr``; anything else is an error."""
    h = F.lower(F.ltrim(web, F.lit("#")))
    aa = F.lpad(F.lower(F.hex(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)) * 255, 0)
                              .cast("long"))), 2, "0")
    swapped = F.concat(aa, F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.when(F.length(h) == 6, swapped).otherwise(
        F.raise_error(F.concat(F.lit("expected #rrggbb, got "), web)))


def settlement_name(name: Column, index: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("unnamed_"), index.cast("string")))


def run_id(area: Column, dx: Column, at: Column) -> Column:
    return F.concat(area, F.lit("_"), compact(dx), F.lit("m_"),
                    F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def compact(x: Column) -> Column:
    """A number without trailing zeros."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def scenario_label(mode: Column, kind: Column, width: Column, formation_s: Column) -> Column:
    return (F.when(mode.isNull(), F.concat(kind, F.lit(" (no breach hydrograph)")))
             .when(mode == "instantaneous", "instantaneous full breach")
             .otherwise(F.concat(mode, F.lit(" breach, "), digits(width, 0), F.lit(" m bottom width, "),
                                 digits(formation_s / 60.0, 0), F.lit(" min formation"))))


def area_text(km2: Column) -> Column:
    return F.when(km2 >= 10, F.format_number(F.bround(km2, 0), 0)).otherwise(
        digits(km2, 1))


def headline(scenario: Column, area_name: Column, km2: Column, first_min: Column,
             people: Column) -> Column:
    return F.concat(F.concat_ws(
        "; ",
        F.concat(scenario, F.lit(" at "), area_name),
        F.concat(F.lit("floods "), area_text(km2), F.lit(" km2")),
        F.when(first_min.isNotNull(), F.concat(F.lit("first arrival "), digits(first_min, 0), F.lit(" min after failure"))),
        F.when(people > 0, F.concat(F.lit("about "), F.format_number(people, 0),
                                    F.lit(" people exposed")))), F.lit("."))


# --- display formats ---------------------------------------------------------------

def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def show_arrival(minutes: Column) -> Column:
    return (F.when(minutes.isNull() | (minutes == -1), "not reached")
             .when(minutes <= 0, "< 1 min")
             .otherwise(F.concat(_half_up(minutes).cast("string"), F.lit(" min"))))


def show_area(km2: Column) -> Column:
    return F.when(km2 >= 10, F.concat(F.format_number(_half_up(km2), 0), F.lit(" km²"))).otherwise(
        F.concat(digits(km2, 1), F.lit(" km²")))


def show_population(n: Column) -> Column:
    return F.concat(F.lit("about "), F.format_number(n, 0), F.lit(" people"))


def show_depth(m: Column) -> Column:
    return F.concat(digits(m, 1), F.lit(" m"))


def show_speed(v: Column) -> Column:
    return F.concat(digits(v, 1), F.lit(" m/s"))


def show_wall_time(s: Column) -> Column:
    return F.when(s < 60, F.concat(digits(s, 1), F.lit(" s"))).otherwise(
        F.concat(F.floor(s / 60).cast("long").cast("string"), F.lit(" min "), digits(s % 60, 0), F.lit(" s")))


def show_duration(s: Column) -> Column:
    return F.concat(digits(s / 3600.0, 1), F.lit(" h"))


def show_volume_error(e: Column) -> Column:
    """Scientific notation with two decimals and a bare exponent."""
    text = F.regexp_replace(scientific(e, 2), r"e([+-])0*(\d)", "e$1$2")
    return F.when(F.abs(e) < 1e-12, "< 1×10⁻¹²").otherwise(text)


# --- paths and kinds -------------------------------------------------------------------

def _lookup(table: dict, key: Column, default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def suffix(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def artifact_kind(path: Column) -> Column:
    return _lookup(fixed.KIND_BY_SUFFIX, suffix(path), "other")


def content_type(path: Column) -> Column:
    return _lookup(fixed.CONTENT_TYPES, suffix(path), fixed.DEFAULT_CONTENT_TYPE)


def escapes(path: Column) -> Column:
    """A relative key that would leave its run folder."""
    steps = F.split(path, "/")
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, s: F.struct(
            (a["d"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(a["low"], a["d"] + F.when(s == "..", -1).when(s.isin("", "."), 0)
                    .otherwise(1)).alias("low")),
        lambda a: a["low"])
    return path.startswith("/") | (depth < 0)


def source_text(verified: Column, citation: Column, note: Column) -> Column:
    return F.concat(F.lit("["), F.when(verified, "verified").otherwise("UNVERIFIED"), F.lit("] "),
                    citation, F.when(F.coalesce(note, F.lit("")) != "",
                                     F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""))


# --- event windows --------------------------------------------------------------------------

def pre_window(event: Column, days: int = fixed.SAR_PRE_DAYS) -> Column:
    return F.struct(F.date_sub(event, days).alias("start"), event.alias("end"))


def post_window(event: Column, days: int = fixed.SAR_POST_DAYS) -> Column:
    return F.struct(event.alias("start"), F.date_add(event, days).alias("end"))


def vintage_text(vintage: Column, today: Column) -> Column:
    return F.format_string("Population surface of %d is %d years old.",
                           vintage, F.year(today) - vintage)
