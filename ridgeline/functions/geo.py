"""Geodesy and planar geometry as Column expressions (code generation) and, where iterative, vectorised kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ETRS89 / LAEA Europe (EPSG:3035) on GRS80, Snyder's ellipsoidal azimuthal equal-area projection.
SEMI_MAJOR = 6378137.0
E2 = 0.0066943800229
ORIGIN_LAT, ORIGIN_LON = math.radians(52), math.radians(10)
FALSE_EASTING, FALSE_NORTHING = 4321000.0, 3210000.0
_E = math.sqrt(E2)


def _authalic(phi: float) -> float:
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


_QP = _authalic(math.pi / 2)
_RQ = SEMI_MAJOR * math.sqrt(_QP / 2)
_BETA0 = math.asin(_authalic(ORIGIN_LAT) / _QP)
_SB, _CB = math.sin(_BETA0), math.cos(_BETA0)
_D = SEMI_MAJOR * math.cos(ORIGIN_LAT) / math.sqrt(1 - E2 * math.sin(ORIGIN_LAT) ** 2) / (_RQ * _CB)
#: Web-Mercator zoom of the explorer tiles.
TILE_ZOOM = 14


def js_round(value: Column, digits: int = 0) -> Column:
    """Halves towards plus infinity, as floor(v * 10^d + 1/2) / 10^d."""
    factor = float(10**digits)
    return F.floor(value * factor + 0.5) / F.lit(factor)


def sin_beta(lat: Column) -> Column:
    """Sine of the authalic latitude: the part of the projection worth computing once per point."""
    s = F.sin(F.radians(lat))
    return ((1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))) / _QP


def laea(sb: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres from ``sin_beta`` and the longitude."""
    cb = F.sqrt(1 - sb * sb)
    dl = F.radians(lon) - ORIGIN_LON
    b = _RQ * F.sqrt(2 / (1 + _SB * sb + _CB * cb * F.cos(dl)))
    return FALSE_EASTING + b * _D * cb * F.sin(dl), FALSE_NORTHING + b / _D * (_CB * sb - _SB * cb * F.cos(dl))


def laea_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) from metres."""
    dx, dy = x - FALSE_EASTING, y - FALSE_NORTHING
    rho = F.hypot(dx / _D, dy * _D)
    c = 2 * F.asin(rho / (2 * _RQ))
    beta = F.asin(F.cos(c) * _SB + _D * dy * F.sin(c) * _CB / rho)
    e4, e6 = E2**2, E2**3
    phi = (
        beta + (E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    )
    lon = ORIGIN_LON + F.atan2(dx * F.sin(c), _D * rho * _CB * F.cos(c) - _D**2 * dy * _SB * F.sin(c))
    near = rho < 1e-9
    return F.when(near, math.degrees(ORIGIN_LAT)).otherwise(F.degrees(phi)), F.when(near, math.degrees(ORIGIN_LON)).otherwise(F.degrees(lon))


def laea_arrays(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sin(np.radians(lat))
    sb = ((1 - E2) * (s / (1 - E2 * s * s) - np.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))) / _QP
    cb, dl = np.sqrt(np.maximum(0, 1 - sb * sb)), np.radians(lon) - ORIGIN_LON
    b = _RQ * np.sqrt(2 / (1 + _SB * sb + _CB * cb * np.cos(dl)))
    return FALSE_EASTING + b * _D * cb * np.sin(dl), FALSE_NORTHING + b / _D * (_CB * sb - _SB * cb * np.cos(dl))


def vincenty(lat1, lon1, lat2, lon2, rounds: int = 8) -> np.ndarray:
    """WGS84 inverse distance in metres; a fixed number of vectorised iterations is ample for points of one route."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(v, dtype=float)) for v in (lat1, lon1, lat2, lon2))
    u1, u2 = np.arctan((1 - f) * np.tan(lat1)), np.arctan((1 - f) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    length = lon2 - lon1
    lam = length
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, c1 * c2 * sl / ss, 0.0)
            c2a = 1 - sa * sa
            cm = np.where(c2a > 0, cs - 2 * s1 * s2 / c2a, 0.0)
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            lam = length + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
        u = c2a * (a * a - b * b) / (b * b)
        k = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        g = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = g * ss * (cm + g / 4 * (cs * (2 * cm * cm - 1) - g / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return np.where(ss > 0, b * k * (sigma - ds), 0.0)


def geodesic() -> Callable[[Column, Column, Column, Column], Column]:
    """Arrow UDF for the distance in metres of (lat1, lon1, lat2, lon2)."""

    @F.pandas_udf("double")
    def metres(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(vincenty(lat1, lon1, lat2, lon2))

    return metres


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth metres between neighbouring points."""
    k = F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(F.pow((lat2 - lat1) * 110540, 2) + F.pow((lon2 - lon1) * k * 111320, 2))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    k = F.cos(F.radians((lat1 + lat2) / 2))
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * k, lat2 - lat1)) + 360, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180, 360 - d).otherwise(d)


#: The sixteen points of the compass.
COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def compass(degrees: Column) -> Column:
    return F.array(*map(F.lit, COMPASS))[(F.floor(F.pmod(degrees, F.lit(360.0)) / 22.5 + 0.5) % 16).cast("int")]


def tile_x(lon: Column, zoom: int = TILE_ZOOM) -> Column:
    n = 2**zoom
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((lon + 180) / 360 * n))).cast("int")


def tile_y(lat: Column, zoom: int = TILE_ZOOM) -> Column:
    n = 2**zoom
    phi = F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat)))
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n))).cast("int")


def tile_x_exact(lon: Column, zoom: int = TILE_ZOOM) -> Column:
    """Place on the tile axis, with its fraction."""
    return (lon + 180) / 360 * 2**zoom


def tile_y_exact(lat: Column, zoom: int = TILE_ZOOM) -> Column:
    phi = F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat)))
    return (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * 2**zoom


def tile_lon(x: Column, zoom: int = TILE_ZOOM) -> Column:
    return x / F.lit(2**zoom) * 360 - 180


def tile_lat(y: Column, zoom: int = TILE_ZOOM) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.lit(2**zoom)))))


def point_in_polygon(lat: Column, lon: Column, polygon: Column) -> Column:
    """Even-odd rule; ``polygon`` is an array of (lat, lon), closed or not."""
    shifted = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    crosses = F.zip_with(
        polygon,
        shifted,
        lambda p, q: ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]),
    )
    return F.coalesce(F.size(F.filter(crosses, lambda c: c)) % 2 == 1, F.lit(False))


def closest_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """struct(t, d): clamped place on the segment and the distance; a segment without length is its point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(F.lit(0.0))
    return F.struct(t.alias("t"), F.hypot(px - (ax + t * dx), py - (ay + t * dy)).alias("d"))
