"""Extents in several coordinate systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.mercator import to_crs

CACHED = (4326, 3857)


def extent(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.struct(minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def extent_of_grid(origin_x: Column, origin_y: Column, px_w: Column, px_h: Column, width: Column, height: Column) -> Column:
    """From the upper left corner of a north-up grid; px_h is negative."""
    return extent(origin_x, origin_y + px_h * height, origin_x + px_w * width, origin_y)


def project(box: Column, source: Column, target: Column, utm: bool = False) -> Column:
    """The two corners in another system; null where one isn't supported."""
    (x0, y0), (x1, y1) = (to_crs(source, target, box[a], box[b], utm=utm) for a, b in (("minx", "miny"), ("maxx", "maxy")))
    return F.when(x0.isNotNull() & x1.isNotNull(), extent(x0, y0, x1, y1))


def cached_geometry(box: Column, crs: Column, utm: bool = False) -> Column:
    """Map from code to (crs_code, extent) of the own system, 4326 and 3857."""
    geometry = lambda code, e: F.struct(code.alias("crs_code"), e.alias("extent"))
    entries = [F.struct(crs.alias("key"), geometry(crs, box).alias("value"))]
    for code in CACHED:
        c = F.lit(code)
        entries.append(F.when(crs != c, F.struct(c.alias("key"), geometry(c, project(box, crs, c, utm)).alias("value"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def explode_cached(layers: DataFrame, key: str) -> DataFrame:
    """key, crs_code, minx, miny, maxx, maxy of every cached geometry."""
    rows = layers.select(key, F.explode("cached_geometry").alias("code", "g"))
    return rows.select(key, F.col("g.crs_code").alias("crs_code"), "g.extent.*")
