"""Web Mercator and tile bounds as column expressions inside generated code, and the choice between systems."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.utm import lon_lat_to_utm, utm_to_lon_lat

#: Fixed values of the projection and the tile scheme.
RADIUS = 6378137.0
MAX_LAT = 85.05112877980659
HALF_WORLD = 20037508.342789244
TILE = 256


def lon_lat_to_mercator(lon: Column, lat: Column, clamp: bool = True) -> tuple[Column, Column]:
    """Degrees to metres. Latitudes beyond the square world are clamped."""
    lat = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat)) if clamp else lat
    return lon * F.lit(RADIUS) * F.lit(math.pi) / F.lit(180.0), F.lit(RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi) / F.lit(180.0) / F.lit(2.0)))


def mercator_to_lon_lat(x: Column, y: Column) -> tuple[Column, Column]:
    return x / F.lit(RADIUS * math.pi / 180.0), (F.lit(2.0) * F.atan(F.exp(y / F.lit(RADIUS))) - F.lit(math.pi / 2)) * F.lit(180.0) / F.lit(math.pi)


def tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    """Bounds in metres of an XYZ tile, y downwards, and the size of its pixels. Any z, x and y are allowed."""
    res = F.lit(2.0 * HALF_WORLD / TILE) / F.pow(F.lit(2.0), z.cast("double"))
    x, y, side = x.cast("double"), y.cast("double"), F.lit(float(TILE))
    return {
        "minx": x * side * res - F.lit(HALF_WORLD),
        "miny": F.lit(HALF_WORLD) - (y + 1) * side * res,
        "maxx": (x + 1) * side * res - F.lit(HALF_WORLD),
        "maxy": F.lit(HALF_WORLD) - y * side * res,
    }


def is_utm(crs: Column) -> Column:
    return crs.between(32601, 32660) | crs.between(32701, 32760)


def supported(crs: Column) -> Column:
    """Geographic WGS 84, Web Mercator and the UTM zones of WGS 84."""
    return crs.isin(4326, 3857) | is_utm(crs)


def to_lon_lat(crs: Column, x: Column, y: Column, utm: bool = False) -> tuple[Column, Column]:
    """Coordinates of a supported system in degrees; null for others."""
    out = []
    for k, (plain, merc) in enumerate(zip((x, y), mercator_to_lon_lat(x, y), strict=True)):
        case = F.when(crs == 4326, plain).when(crs == 3857, merc)
        out.append(case.when(is_utm(crs), utm_to_lon_lat(crs, x, y)[("x", "y")[k]]) if utm else case)
    return tuple(out)


def to_crs(source: Column, target: Column, x: Column, y: Column, clamp: bool = True, utm: bool = False) -> tuple[Column, Column]:
    """Coordinates from one supported system to another; the same system changes nothing.

    UTM zones are computed in Python: pass utm=True where they occur.
    """
    lon, lat = to_lon_lat(source, x, y, utm)
    out = []
    for k, (plain, merc) in enumerate(zip((x, y), lon_lat_to_mercator(lon, lat, clamp), strict=True)):
        case = F.when(source == target, plain).when(target == 4326, (lon, lat)[k]).when(target == 3857, merc)
        out.append(case.when(is_utm(target), lon_lat_to_utm(target, lon, lat)[("x", "y")[k]]) if utm else case)
    return tuple(out)
