"""Longitude and latitude to Lambert-93 metres and back: conformal conic closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and the parameters of EPSG:2154.
_A, _F = 6378137.0, 1 / 298.257222101
_LAT1, _LAT2, _LAT0, _LON0 = np.radians([44.0, 49.0, 46.5, 3.0])
_X0, _Y0 = 700000.0, 6600000.0
_E = float(np.sqrt(2 * _F - _F * _F))


def _m(lat: np.ndarray) -> np.ndarray:
    return np.cos(lat) / np.sqrt(1 - (_E * np.sin(lat)) ** 2)


def _t(lat: np.ndarray) -> np.ndarray:
    s = _E * np.sin(lat)
    return np.tan(np.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


_N = np.log(_m(_LAT1) / _m(_LAT2)) / np.log(_t(_LAT1) / _t(_LAT2))
_C = _A * _m(_LAT1) / (_N * _t(_LAT1) ** _N)
_R0 = _C * _t(_LAT0) ** _N


def to_metres(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r, angle = _C * _t(np.radians(lat)) ** _N, _N * (np.radians(lon) - _LON0)
    return _X0 + r * np.sin(angle), _Y0 + _R0 - r * np.cos(angle)


def to_degrees(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = x - _X0, _R0 - (y - _Y0)
    t = (np.hypot(dx, dy) / _C) ** (1 / _N)
    lat = np.pi / 2 - 2 * np.arctan(t)
    for _ in range(8):
        s = _E * np.sin(lat)
        lat = np.pi / 2 - 2 * np.arctan(t * ((1 - s) / (1 + s)) ** (_E / 2))
    return np.degrees(np.arctan2(dx, dy) / _N + _LON0), np.degrees(lat)


def _column(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def lambert93(lon: Column | str, lat: Column | str) -> Column:
    """(x, y) in metres of (longitude, latitude), of built-in functions alone; null for what is no place on Earth."""
    lon, lat = _column(lon), _column(lat)
    phi = F.radians(lat)
    r = F.lit(float(_C)) * F.pow(F.tan(np.pi / 4 - phi / 2) * F.exp(_E * F.atanh(_E * F.sin(phi))), F.lit(float(_N)))
    angle = float(_N) * (F.radians(lon) - float(_LON0))
    place = F.struct((_X0 + r * F.sin(angle)).alias("x"), (float(_Y0 + _R0) - r * F.cos(angle)).alias("y"))
    return F.when(lon.between(-180, 180) & lat.between(-80, 89.9), place)


#: Steps of the inverse: each takes the error down by the squared eccentricity, so eight leave less than a double can tell.
STEPS = 8


def wgs84(x: Column | str, y: Column | str) -> Column:
    """(longitude, latitude) as (x, y) of metres, likewise. Each step of the iteration holds the one before only once, so the expression stays small."""
    x, y = _column(x), _column(y)
    dx, dy = x - _X0, float(_R0) - (y - _Y0)
    t = F.pow(F.hypot(dx, dy) / float(_C), F.lit(float(1 / _N)))
    lat = np.pi / 2 - 2 * F.atan(t)
    for _ in range(STEPS):
        lat = np.pi / 2 - 2 * F.atan(t * F.exp(-_E * F.atanh(_E * F.sin(lat))))
    place = F.struct(F.degrees(F.atan2(dx, dy) / float(_N) + float(_LON0)).alias("x"), F.degrees(lat).alias("y"))
    return F.when(x.between(-1e7, 1e7) & y.between(-1e7, 2e7), place)
