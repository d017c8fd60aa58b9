"""Spherical cell areas, UTM projection and affine cell arithmetic as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodspark import fixed

# Krueger series of the transverse Mercator projection, from the third flattening.
_N = fixed.WGS84_F / (2.0 - fixed.WGS84_F)
_E = math.sqrt(fixed.WGS84_F * (2.0 - fixed.WGS84_F))
_RADIUS = fixed.WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def spherical_cell_area(lat: Column, res_lon: float, res_lat: float) -> Column:
    """Exact ground area of a longitude-latitude cell on the sphere, m^2."""
    half = res_lat / 2.0
    band = F.abs(F.sin(F.radians(lat + half)) - F.sin(F.radians(lat - half)))
    return F.lit(fixed.EARTH_RADIUS_M ** 2 * math.radians(abs(res_lon))) * band


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("EPSG:"),
                    (F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)).cast("string"))


def _central_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def utm_forward(lat: Column, lon: Column, zone: Column) -> Column:
    """``STRUCT<x, y>`` in metres; southern latitudes carry the false northing."""
    phi, lam = F.radians(lat), F.radians(lon - _central_meridian(zone))
    t = F.sinh(F.atanh(F.sin(phi)) - _E * F.atanh(_E * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_FORWARD, start=1):
        x = x + a * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        y = y + a * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    scale = fixed.UTM_K0 * _RADIUS
    return F.struct((500000.0 + scale * x).alias("x"),
                    (scale * y + F.when(lat < 0, 10_000_000.0).otherwise(0.0)).alias("y"))


def utm_inverse(x: Column, y: Column, zone: Column, north: Column) -> Column:
    """``STRUCT<lat, lon>`` in degrees."""
    scale = fixed.UTM_K0 * _RADIUS
    xi0 = (y - F.when(north, 0.0).otherwise(10_000_000.0)) / scale
    eta0 = (x - 500000.0) / scale
    xi, eta = xi0, eta0
    for j, b in enumerate(_INVERSE, start=1):
        xi = xi - b * F.sin(2.0 * j * xi0) * F.cosh(2.0 * j * eta0)
        eta = eta - b * F.cos(2.0 * j * xi0) * F.sinh(2.0 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_LATITUDE, start=1):
        phi = phi + d * F.sin(2.0 * j * chi)
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    return F.struct(F.degrees(phi).alias("lat"),
                    (F.degrees(lam) + _central_meridian(zone)).alias("lon"))


# --- affine grids: x = a*c + b*r + x0, y = d*c + e*r + y0 (array a, b, x0, d, e, y0) ----------

def affine_xy(transform: Column, r: Column, c: Column) -> Column:
    """Centre of a cell."""
    a, b, x0, d, e, y0 = (F.try_element_at(transform, F.lit(i)) for i in range(1, 7))
    cc, rr = c + 0.5, r + 0.5
    return F.struct((a * cc + b * rr + x0).alias("x"), (d * cc + e * rr + y0).alias("y"))


def affine_cell(transform: Column, x: Column, y: Column) -> Column:
    """Cell that holds a point: ``STRUCT<r, c>`` (floor of the inverse affine)."""
    a, b, x0, d, e, y0 = (F.try_element_at(transform, F.lit(i)) for i in range(1, 7))
    det = a * e - b * d
    u, v = x - x0, y - y0
    return F.struct(F.floor((a * v - d * u) / det).cast("int").alias("r"),
                    F.floor((e * u - b * v) / det).cast("int").alias("c"))
