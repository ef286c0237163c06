"""UTM zones of WGS 84 by Krüger's series in the third flattening, as Arrow-batched functions.

As column expressions the series repeat each other's terms and grow too long to
plan, so this is the one projection outside generated code.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RADIUS = 6378137.0
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def _zone(crs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Central meridian in radians, and the false northing."""
    return np.radians((crs % 100) * 6 - 183), np.where(crs >= 32700, _SOUTH, 0.0)


def inverse(crs: np.ndarray, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of eastings and northings."""
    meridian, false = _zone(crs)
    xi, eta = (north - false) / (_K0 * _A), (east - _EAST) / (_K0 * _A)
    a = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    b = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return np.degrees(meridian + np.arctan2(np.sinh(b), np.cos(a))), np.degrees(lat)


def forward(crs: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eastings and northings of degrees."""
    meridian, false = _zone(crs)
    e = 2 * math.sqrt(_N) / (1 + _N)
    s, d = np.sin(np.radians(lat)), np.radians(lon) - meridian
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    xi, eta = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return _EAST + _K0 * _A * x, false + _K0 * _A * y


_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _column(compute):
    @F.pandas_udf(_POINT)
    def run(crs: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            a, b = compute(crs.fillna(0).to_numpy(dtype=float), x.to_numpy(dtype=float), y.to_numpy(dtype=float))
        return pd.DataFrame({"x": a, "y": b})

    return run


utm_to_lon_lat, lon_lat_to_utm = _column(inverse), _column(forward)
