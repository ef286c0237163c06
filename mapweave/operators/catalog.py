"""The layer catalogue: file listings, the metadata cache, indexes and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.functions import colour, paths
from mapweave.functions.palettes import NAMES, is_palette
from mapweave.schema import CACHE


def raster_files(files: DataFrame, default_style: str = "default") -> DataFrame:
    """Files (path, ...) with a raster extension that aren't directly under the root (at_root), with layer and style."""
    path = F.col("path")
    return files.where(paths.is_raster(path) & ~F.col("at_root")).withColumns({"layer": paths.stem(path), "style": paths.style_of(path, default_style)})


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; a partial aggregate before the shuffle, so a hot key is no hot task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("kept")).select("kept.*")


def cache_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose cache record has the same size and time, with its columns, and the files that must be read.

    `cache` has one row a key; see last_by().
    """
    key = ["layer", "size_bytes", "last_modified"]
    return files.join(cache, key, "inner"), files.join(cache.select(*key), key, "left_anti")


def flatten(layers: DataFrame) -> DataFrame:
    """Layers as records of the cache."""
    sides = [F.col(f"extent.{s}").alias(f"extent_{s}") for s in ("minx", "miny", "maxx", "maxy")]
    return layers.select("layer", "size_bytes", "last_modified", "crs_code", "min_value", "max_value", "is_cog", *sides)


def nest(records: DataFrame) -> DataFrame:
    """Records of the cache with an extent column again."""
    sides = [c for c in CACHE.names if c.startswith("extent_")]
    return records.withColumn("extent", F.struct(*(F.col(c).alias(c.removeprefix("extent_")) for c in sides))).drop(*sides)


def layer_index(layers: DataFrame) -> DataFrame:
    """layer and styles, the list of its (path, style) by path."""
    return layers.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("path", "style"))).alias("styles"))


def first_per_name(layers: DataFrame, order: str = "path") -> DataFrame:
    """The layer that serves a name: the first by path."""
    return layers.groupBy("layer").agg(F.min_by(F.struct(*layers.columns), order).alias("kept")).select("kept.*")


def list_layers(layers: DataFrame) -> DataFrame:
    return layers.orderBy("layer", "style", "path")


def layers_response(layers: DataFrame) -> DataFrame:
    """layer, style, geometry without regard to case, for a client."""
    return layers.orderBy(F.lower("layer"), F.lower("style"), "layer", "style", "path").select("layer", "style", F.col("cached_geometry").alias("geometry"))


def load_progress(files: DataFrame, order: str = "ord", failed: Column | None = None) -> DataFrame:
    """Each file's running bytes, place and percent in the order of loading, and the totals.

    A file that `failed`, which can't be a layer, adds its bytes to what was
    read but doesn't advance the place. The running sum is made per range of
    files and then over the ranges, so no task sees all files.
    """
    done = F.lit(1) if failed is None else F.when(failed, 0).otherwise(1)
    spread = files.select(order, "size_bytes", done.cast("long").alias("done")).repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id())
    inner = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.select(order, "part", "size_bytes", "done", F.sum("size_bytes").over(inner).alias("in_part"), F.sum("done").over(inner).alias("place"))
    before = rows.groupBy("part").agg(F.sum("size_bytes").alias("bytes"), F.sum("done").alias("n"), F.count("*").alias("files"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    before = before.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.sum("bytes").over(whole).alias("total_bytes"), F.sum("files").over(whole).alias("total_files"))
    out = rows.join(F.broadcast(before), "part")  # one row a partition
    place = F.col("place") + F.col("n0")
    return out.select(order, (F.col("in_part") + F.col("b0")).alias("loaded_bytes"), place.alias("position"), (100.0 * place / F.col("total_files")).alias("percent"), "total_files", "total_bytes")


def style_summary(layers: DataFrame, order: str = "ord") -> DataFrame:
    """One row a style: layers, the last layer's stops, value range, COGs, breaks and warnings."""
    rows = layers.groupBy("style").agg(F.count("*").alias("n_layers"), F.max_by("colour_stops", order).alias("stops"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum(F.col("is_cog").cast("long")).alias("n_cogs"))
    values = F.transform("stops", lambda s: s["value"])
    some = F.size("stops") > 0
    return rows.withColumns({
        "breaks": F.when(is_palette(F.col("style")) | ~some, F.array().cast("array<float>")).otherwise(values),
        "uncovered": F.coalesce(some & ((F.col("min_value") < F.try_element_at(values, F.lit(1))) | (F.col("max_value") > F.try_element_at(values, F.lit(-1)))), F.lit(False)),
        "some_not_cog": F.col("n_cogs") < F.col("n_layers"),
    })


def warnings(summary: DataFrame) -> DataFrame:
    """style and warnings, the codes of what is wrong with it, for styles that have any."""
    codes = F.filter(F.array(F.when(F.col("uncovered"), F.lit("uncovered_range")), F.when(F.col("some_not_cog"), F.lit("not_cog"))), lambda c: c.isNotNull())
    return summary.select("style", codes.alias("warnings")).where(F.size("warnings") > 0)


def totals(summary: DataFrame) -> DataFrame:
    """One row: styles, layers, and styles that have layers which aren't cloud-optimised."""
    return summary.agg(F.count("*").alias("n_styles"), F.coalesce(F.sum("n_layers"), F.lit(0)).alias("n_layers"), F.count_if("some_not_cog").alias("n_not_cog"))


def breaks_text(breaks: Column) -> Column:
    """Breaks with two decimals for display, or 'auto'."""
    return F.when(F.size(breaks) == 0, "auto").otherwise(F.array_join(F.transform(breaks, lambda v: F.format_string("%.2f", v)), ", "))


def summary_text(summary: DataFrame) -> DataFrame:
    """The style summary as a table for display: what it has, its breaks, its colour bar and its warnings."""
    colours = F.transform("stops", lambda s: F.struct(s["red"].alias("r"), s["green"].alias("g"), s["blue"].alias("b")))
    grey = F.transform(colour.colour_bar_gray(), lambda v: F.struct(v.alias("r"), v.alias("g"), v.alias("b")))
    bar = F.when(F.size("stops") > 0, colours).otherwise(grey)
    for name in NAMES:
        bar = F.when(F.col("style") == name, colour.colour_bar_palette(name)).otherwise(bar)
    cells = F.array_join(F.transform(bar, lambda c: F.format_string("#%02x%02x%02x", c["r"], c["g"], c["b"])), " ")
    notes = F.concat_ws(", ", F.when(F.col("uncovered"), "breaks don't cover the data"), F.when(F.col("some_not_cog"), F.format_string("%d of %d cloud-optimised", "n_cogs", "n_layers")))
    return summary.orderBy("style").select("style", "n_layers", "min_value", "max_value", breaks_text(F.col("breaks")).alias("breaks"), cells.alias("colours"), notes.alias("warnings"))


def mib(n: Column) -> Column:
    return n / F.lit(1024.0) / F.lit(1024.0)
