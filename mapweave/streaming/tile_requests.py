"""Tiles for a stream of requests: each micro-batch is one job over its distinct requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mapweave.functions.mercator import TILE
from mapweave.operators import tiles
from mapweave.operators.raster import PixelSource


def render_stream(requests: DataFrame, layers: DataFrame, pixels: DataFrame | PixelSource, out: str, checkpoint: str, size: int = TILE) -> StreamingQuery:
    """Writes the tiles of a streaming frame (layer, z, x, y) as Parquet, a folder for each micro-batch.

    A batch that is run again overwrites its own folder, so that every request
    is answered exactly once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        png = tiles.tile_png(tiles.tile_rgba(rows.select(*tiles.KEY).distinct(), layers, pixels, size), size)
        png.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
