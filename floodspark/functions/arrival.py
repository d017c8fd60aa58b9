"""Arrival-time columns: minutes, isochrone bands and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark import fixed


def to_minutes(seconds: Column) -> Column:
    """NULL (never reached) stays NULL."""
    return seconds / 60.0


def band_index(minutes: Column, initially_wet: Column | None = None,
               bands=fixed.ARRIVAL_BANDS_MIN) -> Column:
    """Closed below, open above; negative sentinels for cells without an arrival."""
    wet = F.lit(False) if initially_wet is None else F.coalesce(initially_wet, F.lit(False))
    out = (F.when(wet, fixed.INITIALLY_WET)
            .when(minutes.isNull() | F.isnan(minutes), fixed.NEVER_FLOODED))
    for i, edge in enumerate(bands):
        out = out.when(minutes < edge, i)
    return out.otherwise(len(bands)).cast("int")


def band_labels(bands=fixed.ARRIVAL_BANDS_MIN) -> list[str]:
    edges = [0.0, *bands]
    inner = [f"{lo:.0f}-{hi:.0f} min" for lo, hi in zip(edges, edges[1:])]
    return inner + [f">{edges[-1]:.0f} min"]


def band_label(index: Column, bands=fixed.ARRIVAL_BANDS_MIN) -> Column:
    labels = F.array(*[F.lit(t) for t in band_labels(bands)])
    return F.when(index >= 0, F.try_element_at(labels, index + 1))


def evacuation_action(index: Column) -> Column:
    actions = F.array(*[F.lit(t) for t in fixed.EVACUATION_ACTIONS])
    known = index.between(0, len(fixed.EVACUATION_ACTIONS) - 1)
    return F.when(known, F.try_element_at(actions, index + 1)).otherwise(fixed.EVACUATION_LATER)


def add_arrival(cells: DataFrame, bands=fixed.ARRIVAL_BANDS_MIN) -> DataFrame:
    """Adds ``arrival_min, band``."""
    return (cells.withColumn("arrival_min", to_minutes(F.col("arrival_s")))
                 .withColumn("band", band_index(F.col("arrival_min"), F.col("initially_wet"), bands)))
