"""Coordinate systems by SRID: longitude and latitude, Mercator maps, UTM zones, and any that are registered.

Every system is a pair of functions from and to longitude and latitude in degrees over (n, 2) arrays, so any two are two steps apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .geodesic import MERCATOR_MAX_LAT, MERCATOR_RADIUS

#: WGS 84: the ellipsoid's larger half axis and flattening, and UTM's scale and shifts. Fixed values.
A, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series of the transverse Mercator map in the third flattening: to the map, from it, and back to latitude.
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_FROM = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)

Transform = Callable[[np.ndarray], np.ndarray]


def _web_mercator(c: np.ndarray) -> np.ndarray:
    lat = np.clip(c[:, 1], -MERCATOR_MAX_LAT, MERCATOR_MAX_LAT)
    return np.stack([np.radians(c[:, 0]) * MERCATOR_RADIUS, np.log(np.tan(math.pi / 4 + np.radians(lat) / 2)) * MERCATOR_RADIUS], axis=1)


def _from_web_mercator(c: np.ndarray) -> np.ndarray:
    return np.stack([np.degrees(c[:, 0] / MERCATOR_RADIUS), np.degrees(2 * np.arctan(np.exp(c[:, 1] / MERCATOR_RADIUS)) - math.pi / 2)], axis=1)


def _conformal(lat: np.ndarray) -> np.ndarray:
    """Tangent of the conformal latitude."""
    s = np.sin(lat)
    return np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))


def _world_mercator(c: np.ndarray) -> np.ndarray:
    lat = np.radians(np.clip(c[:, 1], -89.9, 89.9))
    return np.stack([A * np.radians(c[:, 0]), A * np.arcsinh(_conformal(lat))], axis=1)


def _geographic(t: np.ndarray) -> np.ndarray:
    """Latitude of a tangent of the conformal one, by Newton's steps."""
    lat = np.arctan(t)
    for _ in range(6):
        step = (np.arcsinh(t) - np.arcsinh(_conformal(lat))) * np.cos(lat) * (1 - (_E * np.sin(lat)) ** 2) / (1 - _E**2)
        lat = lat + step
    return lat


def _from_world_mercator(c: np.ndarray) -> np.ndarray:
    return np.stack([np.degrees(c[:, 0] / A), np.degrees(_geographic(np.sinh(c[:, 1] / A)))], axis=1)


def _utm(zone: int, south: bool) -> tuple[Transform, Transform]:
    middle, shift = math.radians(zone * 6 - 183), UTM_SOUTH if south else 0.0

    def to(c: np.ndarray) -> np.ndarray:
        lng, t = np.radians(c[:, 0]) - middle, _conformal(np.radians(c[:, 1]))
        xi, eta = np.arctan2(t, np.cos(lng)), np.arctanh(np.sin(lng) / np.sqrt(1 + t * t))
        x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_TO, 1))
        y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_TO, 1))
        return np.stack([UTM_EAST + UTM_SCALE * _RADIUS * x, shift + UTM_SCALE * _RADIUS * y], axis=1)

    def back(c: np.ndarray) -> np.ndarray:
        xi, eta = (c[:, 1] - shift) / (UTM_SCALE * _RADIUS), (c[:, 0] - UTM_EAST) / (UTM_SCALE * _RADIUS)
        x = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_FROM, 1))
        y = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(_FROM, 1))
        chi = np.arcsin(np.sin(x) / np.cosh(y))
        lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_LATITUDE, 1))
        return np.stack([np.degrees(middle + np.arctan2(np.sinh(y), np.cos(x))), np.degrees(lat)], axis=1)

    return to, back


_same: Transform = lambda c: c
_known: dict[int, tuple[Transform, Transform]] = {4326: (_same, _same), 3857: (_web_mercator, _from_web_mercator), 3395: (_world_mercator, _from_world_mercator)}


def register_srid(srid: int, from_degrees: Transform, to_degrees: Transform) -> None:
    """Adds a system; a job's tasks see it if the functions can be pickled with the job."""
    _known[srid] = (from_degrees, to_degrees)


def system(srid: int) -> tuple[Transform, Transform]:
    """(from longitude and latitude, to them) of a system: 4326, 3857, 3395, UTM zones (326zz north, 327zz south), or a registered one."""
    if srid in _known:
        return _known[srid]
    if srid // 100 in (326, 327) and 1 <= srid % 100 <= 60:
        return _utm(srid % 100, srid // 100 == 327)
    raise ValueError(f"unknown SRID {srid}; 4326, 3857, 3395, 32601 to 32660, 32701 to 32760, or one that register_srid() adds")


def transformer(source: int, target: int) -> Transform:
    to_degrees, from_degrees = system(source)[1], system(target)[0]
    return lambda c: from_degrees(to_degrees(c))
