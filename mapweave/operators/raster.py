"""Rasters as rows of pixels (layer, row_, col, v) or of square blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.f32 import f32
from mapweave.functions.mercator import TILE, tile_bounds, to_crs

#: Metres by which a pixel corner may miss the source's edge: closed forms end one rounding short of the tile scheme's constant.
EDGE = 1e-6
#: Gives the pixels in the rectangles of spans().
PixelSource = Callable[[DataFrame], DataFrame]


def present(v: Column, nodata: Column) -> Column:
    """The value; null for NaN and nodata."""
    return F.when(~F.isnan(v), F.nullif(v, nodata))


def visible(v: Column, nodata: Column) -> Column:
    """The value; null for NaN, nodata and both zeros, which are never drawn."""
    return F.nullif(present(v, nodata), f32(0))


def band_stats(pixels: DataFrame, nodata: DataFrame | None = None) -> DataFrame:
    """layer, min_value, max_value over present pixels; zeros count. A layer without such pixels has nulls.

    `nodata` has layer and nodata, one row a layer.
    """
    rows = pixels if nodata is None else pixels.join(nodata, "layer", "left")
    value = present(F.col("v"), F.lit(None).cast("float") if nodata is None else F.col("nodata"))
    return rows.groupBy("layer").agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def pixel_grid(spark: SparkSession, width: int = TILE, height: int = TILE) -> DataFrame:
    """px, py of every pixel of a tile."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.expr(f"cast(id div {width} as int)").alias("py"))


def tile_grid(requests: DataFrame, size: int = TILE) -> DataFrame:
    """Every pixel of every requested tile: px, py, its corner gx, gy and its centre cx, cy in metres.

    Columns of `requests` stay; z, x and y are needed. The rows come from two
    nested generators, without a join.
    """
    bounds = tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    side = F.sequence(F.lit(0), F.lit(size - 1))
    rows = requests.select("*", *(c.alias(k) for k, c in bounds.items())).select("*", ((F.col("maxx") - F.col("minx")) / size).alias("res_x"), ((F.col("maxy") - F.col("miny")) / size).alias("res_y"))
    rows = rows.select("*", F.explode(side).alias("py")).select("*", F.explode(side).alias("px"))
    half = F.lit(0.5)
    return rows.select(
        *requests.columns, "px", "py", (F.col("minx") + F.col("px") * F.col("res_x")).alias("gx"), (F.col("maxy") - F.col("py") * F.col("res_y")).alias("gy"),
        (F.col("minx") + (F.col("px") + half) * F.col("res_x")).alias("cx"), (F.col("maxy") - (F.col("py") + half) * F.col("res_y")).alias("cy"),
    )


def source_place(grid: DataFrame, utm: bool = False) -> DataFrame:
    """Adds src_col and src_row, the source pixel under each tile pixel's centre. Needs crs_code, origin_x, origin_y, px_w, px_h."""
    sx, sy = to_crs(F.lit(3857), F.col("crs_code"), F.col("cx"), F.col("cy"), clamp=False, utm=utm)
    return grid.withColumns({"src_col": F.floor((sx - F.col("origin_x")) / F.col("px_w")).try_cast("int"), "src_row": F.floor((sy - F.col("origin_y")) / F.col("px_h")).try_cast("int")})


def outside(gx: Column, gy: Column, box: Column, crs: Column, utm: bool = False) -> Column:
    """Whether a pixel's corner lies outside the source's extent, bounds included. Extents end at the square world's edge."""
    (x0, y0), (x1, y1) = (to_crs(crs, F.lit(3857), box[a], box[b], utm=utm) for a, b in (("minx", "miny"), ("maxx", "maxy")))
    edge = F.lit(EDGE)
    return (gx < F.least(x0, x1) - edge) | (gx > F.greatest(x0, x1) + edge) | (gy < F.least(y0, y1) - edge) | (gy > F.greatest(y0, y1) + edge)


SPAN = ("r0", "r1", "c0", "c1")
#: Layers whose rectangles become literals of a predicate; those of more are joined.
LITERAL_SPANS = 500


def spans(asked: DataFrame, size: int = TILE, utm: bool = False) -> DataFrame:
    """layer, r0, r1, c0, c1: the rectangle of source pixels that all requested tiles of a layer reach.

    Longitudes and Mercator's x, and latitudes and its y, rise together, so the
    centres of two corner pixels say it; UTM zones are turned against them, and
    need every pixel.
    """
    if utm:
        placed = source_place(tile_grid(asked, size), True).select("layer", *(F.col(f"src_{k}").alias(f"{k}{i}") for k in ("row", "col") for i in (0, 1)))
    else:
        bounds = tile_bounds(F.col("z"), F.col("x"), F.col("y"))
        half = [(bounds["maxx"] - bounds["minx"]) / (2 * size), (bounds["maxy"] - bounds["miny"]) / (2 * size)]
        corners = asked.select("*", *(c.alias(f"edge_{k}") for k, c in {"x0": bounds["minx"] + half[0], "x1": bounds["maxx"] - half[0], "y0": bounds["miny"] + half[1], "y1": bounds["maxy"] - half[1]}.items()))
        out = []
        for i in (0, 1):
            sx, sy = to_crs(F.lit(3857), F.col("crs_code"), F.col(f"edge_x{i}"), F.col(f"edge_y{i}"), clamp=False)
            place = {"row": (sy - F.col("origin_y")) / F.col("px_h"), "col": (sx - F.col("origin_x")) / F.col("px_w")}
            out += [F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0**31 - 1), c))).cast("int").alias(f"{k}{i}") for k, c in place.items()]
        placed = corners.select("layer", *out)
    ends = [f(g(f"{k}0", f"{k}1")).alias(n) for n, (f, g), k in zip(SPAN, ((F.min, F.least), (F.max, F.greatest)) * 2, ("row", "row", "col", "col"), strict=True)]
    return placed.groupBy("layer").agg(*ends)


def reachable(pixels: DataFrame | PixelSource, near: DataFrame) -> DataFrame:
    """The pixels in the rectangles of spans().

    A source of files is asked for them and reads no other blocks. Of a table,
    rectangles of LITERAL_SPANS layers at most become literals, which reach the
    scan and skip row groups there; those of more are joined on the layer.
    """
    if callable(pixels):
        return pixels(near)
    rows = near.limit(LITERAL_SPANS + 1).collect()
    if len(rows) > LITERAL_SPANS:
        inside = F.col("row_").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
        return pixels.join(near, "layer").where(inside).select(pixels.columns)
    out = F.lit(False)
    for s in rows:
        if s["r0"] is not None and s["c0"] is not None:
            out = out | ((F.col("layer") == s["layer"]) & F.col("row_").between(s["r0"], s["r1"]) & F.col("col").between(s["c0"], s["c1"]))
    return pixels.where(out)


def warp_nearest(grid: DataFrame, pixels: DataFrame) -> DataFrame:
    """Adds v, the source pixel of each row of source_place(); null where the source has none.

    The join is on layer, row and column together, so a large layer spreads
    over all tasks.
    """
    return grid.join(pixels.select("layer", F.col("row_").alias("src_row"), F.col("col").alias("src_col"), "v"), ["layer", "src_row", "src_col"], "left")


def to_blocks(pixels: DataFrame, size: int = 256) -> DataFrame:
    """layer, block_row, block_col, data: square blocks of little-endian 32-bit floats, NaN where a pixel is missing.

    A group is one block, so its size is bounded by size * size pixels.
    """

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        data = np.full((size, size), np.nan, "<f4")
        data[table["row_"].to_numpy() % size, table["col"].to_numpy() % size] = table["v"].to_numpy(zero_copy_only=False)
        layer, row, col = (k.as_py() for k in key)
        return pa.table({"layer": [layer], "block_row": pa.array([row], pa.int32()), "block_col": pa.array([col], pa.int32()), "data": [data.tobytes()]})

    keyed = pixels.select("*", F.expr(f"cast(row_ div {size} as int)").alias("block_row"), F.expr(f"cast(col div {size} as int)").alias("block_col"))
    return keyed.groupBy("layer", "block_row", "block_col").applyInArrow(pack, "layer string, block_row int, block_col int, data binary")


def from_blocks(blocks: DataFrame, size: int = 256) -> DataFrame:
    """Pixels of blocks; filters on block_row and block_col before this reach the scan."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], "<f4").reshape(size, size)
                r, c = np.nonzero(~np.isnan(data))
                yield pa.RecordBatch.from_arrays([pa.array([row["layer"]] * len(r), pa.string()), pa.array(r + row["block_row"] * size, pa.int32()), pa.array(c + row["block_col"] * size, pa.int32()), pa.array(data[r, c])], names=["layer", "row_", "col", "v"])

    return blocks.mapInArrow(unpack, "layer string, row_ int, col int, v float")
