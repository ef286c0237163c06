"""Tiles of many requests in one job."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import colour
from mapweave.functions.mercator import TILE, is_utm
from mapweave.functions.palettes import is_palette
from mapweave.operators import raster
from mapweave.operators.catalog import first_per_name

KEY = ("layer", "z", "x", "y")


def tile_values(requests: DataFrame, layers: DataFrame, pixels: DataFrame | raster.PixelSource, size: int = TILE) -> DataFrame:
    """Every pixel of the requested tiles with its masked value v, its place norm in the layer's range, its stop interval hit, and its layer's columns.

    `requests` has layer, z, x, y. Requests of unknown layers give no rows; of
    layers with one name the first by path serves. A tile off the raster, or
    out of the scheme, has null values throughout. Requests are dealt out one by
    one before they become pixels, so a layer that many ask for fills no task.
    """
    columns = ("layer", "style", "crs_code", "extent", "colour_stops", "min_value", "max_value", "origin_x", "origin_y", "px_w", "px_h", "nodata")
    known = first_per_name(layers).select(*columns, colour.stop_pairs(F.col("colour_stops")).alias("stop_pairs"))
    utm = not layers.where(is_utm(F.col("crs_code"))).isEmpty()
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = requests.select(*KEY).join(known, "layer").repartition(parts, *KEY)
    grid = raster.source_place(raster.tile_grid(asked, size), utm)
    place = ("layer", "z", "x", "y", "crs_code", "origin_x", "origin_y", "px_w", "px_h")
    warped = raster.warp_nearest(grid, raster.reachable(pixels, raster.spans(asked.select(*place), size, utm)))
    hidden = raster.outside(F.col("gx"), F.col("gy"), F.col("extent"), F.col("crs_code"), utm)
    masked = warped.withColumn("v", F.when(~hidden, raster.visible(F.col("v"), F.col("nodata"))))
    # Columns of their own: the colour expressions use them many times, and a copy in each would outgrow generated code.
    placed = masked.withColumn("norm", colour.normalise(F.col("v"), F.col("min_value"), F.col("max_value")))
    return placed.withColumn("hit", colour.stop_interval(F.col("norm"), F.col("stop_pairs")))


def by_style(values: DataFrame, palettes: Sequence[str]) -> list[Column]:
    """Red, green, blue and alpha of tile_values() by each layer's style."""
    return colour.colourise(*map(F.col, ("style", "v", "min_value", "max_value", "colour_stops")), palettes, *map(F.col, ("norm", "stop_pairs", "hit")))


def coloured(values: DataFrame, channels: Sequence[Column]) -> DataFrame:
    return values.select(*KEY, "px", "py", *(c.alias(n) for c, n in zip(channels, colour.CHANNELS, strict=True)))


def tile_rgba(requests: DataFrame, layers: DataFrame, pixels: DataFrame | raster.PixelSource, size: int = TILE, palettes: Sequence[str] | None = None) -> DataFrame:
    """layer, z, x, y, px, py, r, g, b, a.

    `palettes` are the built-in ones that the layers can name; by default those
    of the given layers, nine at most: each is a part of the colour expression.
    """
    if palettes is None:
        palettes = [r["style"] for r in layers.select("style").where(is_palette(F.col("style"))).distinct().collect()]
    values = tile_values(requests, layers, pixels, size)
    return coloured(values, by_style(values, palettes))


def tile_png(rgba: DataFrame, size: int = TILE) -> DataFrame:
    """layer, z, x, y, content_type, bytes: one PNG for each tile, a group of size * size pixels at most."""

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        import numpy as np

        from mapweave.sources.png import encode_rgba

        image = np.zeros((size, size, 4), np.uint8)
        image[table["py"].to_numpy(), table["px"].to_numpy()] = np.stack([table[c].to_numpy() for c in colour.CHANNELS], axis=1)
        values = [k.as_py() for k in key]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.table({n: pa.array([v], t) for n, v, t in zip(KEY, values, kinds, strict=True)} | {"content_type": ["image/png"], "bytes": pa.array([encode_rgba(image)], pa.binary())})

    typed = rgba.select("layer", F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "px", "py", *colour.CHANNELS)
    return typed.groupBy(*KEY).applyInArrow(encode, "layer string, z int, x bigint, y bigint, content_type string, bytes binary")


def png_pixels(images: DataFrame) -> DataFrame:
    """layer, z, x, y, px, py, r, g, b, a: the pixels of tile_png()."""

    def rows(batches):
        import numpy as np

        from mapweave.sources.png import decode_rgba

        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                image = decode_rgba(bytes(row["bytes"]))
                py, px = np.indices(image.shape[:2])
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
                keys = [pa.array([row[k]] * py.size, t) for k, t in zip(KEY, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c.ravel().astype(np.int32)) for c in (px, py, *np.moveaxis(image, 2, 0)))], names=[*KEY, "px", "py", *colour.CHANNELS])

    return images.select(*KEY, "bytes").mapInArrow(rows, "layer string, z int, x bigint, y bigint, px int, py int, r int, g int, b int, a int")
