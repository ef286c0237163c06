"""The registered queries over the derived inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.functions import colour, mercator, palettes, paths
from mapweave.operators import catalog, geometry, raster, tiles
from mapweave.plans import fixtures as fx
from mapweave.schema import STOP
from mapweave.sources.stylefile import parse_styles, with_stops

Query = Callable[[SparkSession, str], DataFrame]
NAME, TILE = "orders", (8, 128, 127)
NODATA = -9999.0


def _stops(stops: Sequence[colour.Stop]):
    return F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(s, ("value", *colour.STOP_FIELDS), strict=True))) for s in stops)).cast(f"array<{STOP}>")


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, fx.RASTER).select(F.lit(NAME).alias("layer"), "row_", "col", "v")


def _layer(spark: SparkSession, d: str, style: str, stops: Sequence[colour.Stop] = ()) -> DataFrame:
    """The derived raster's catalogue row, with its statistics."""
    value = raster.present(F.col("v"), F.lit(NODATA).cast("float"))
    stats = _pixels(spark, d).groupBy("layer").agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), (F.max("row_") + 1).alias("height"))
    box = geometry.extent_of_grid(F.lit(10000.0), F.lit(140000.0), F.lit(1000.0), F.lit(-1000.0), F.lit(128), F.col("height"))
    constants = {"style": style, "path": f"/{style}/{NAME}.tif", "crs_code": 3857, "origin_x": 10000.0, "origin_y": 140000.0, "px_w": 1000.0, "px_h": -1000.0}
    row = stats.select("*", *(F.lit(v).alias(k) for k, v in constants.items()), F.lit(NODATA).cast("float").alias("nodata"), box.alias("extent"))
    return row.withColumn("colour_stops", _stops(stops) if stops else F.array().cast(f"array<{STOP}>"))


def _request(spark: SparkSession, *keys: tuple[int, int, int]) -> DataFrame:
    return spark.createDataFrame([(NAME, *k) for k in keys], "layer string, z int, x bigint, y bigint")


def _tile(style: str, channels: Callable | None, stops: Sequence[colour.Stop] = (), keys: Sequence[tuple[int, int, int]] = (TILE,)) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        values = tiles.tile_values(_request(spark, *keys), _layer(spark, d, style, stops), _pixels(spark, d))
        v = [F.col(c) for c in ("v", "min_value", "max_value")]
        norm = F.col("norm")
        found = channels(*v, norm=norm) if channels else tiles.by_style(values, ())
        out = tiles.coloured(values, found)
        return out.select("px", "py", *colour.CHANNELS) if len(keys) == 1 else out.drop("layer")

    return run


def tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = mercator.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    rows = fx.table(spark, d, fx.REQUESTS).select("id", "z", "x", "y", *(c.alias(k) for k, c in b.items()))
    return rows.withColumns({"res_x": (F.col("maxx") - F.col("minx")) / 256, "res_y": (F.col("maxy") - F.col("miny")) / 256})


def mercator_fwd(spark: SparkSession, d: str) -> DataFrame:
    x, y = mercator.lon_lat_to_mercator(F.col("lon"), F.col("lat"))
    return fx.table(spark, d, fx.POINTS).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def mercator_inv(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = mercator.mercator_to_lon_lat(F.col("lon") * 111000.0, F.col("lat") * 111000.0)
    return fx.table(spark, d, fx.POINTS).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


def mercator_clamp(spark: SparkSession, d: str) -> DataFrame:
    _, y = mercator.lon_lat_to_mercator(F.col("lon"), F.col("lat"))
    return fx.table(spark, d, fx.POINTS).where(F.abs("lat") > mercator.MAX_LAT).select("id", F.round(y, 3).alias("y"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, fx.BOXES).select("id", "crs_code", geometry.extent(*map(F.col, ("minx", "miny", "maxx", "maxy"))).alias("extent"))


def _rounded(rows: DataFrame, crs: str) -> DataFrame:
    digits = lambda c: F.when(F.col(crs) == 4326, F.round(c, 6)).otherwise(F.round(c, 3)).alias(c)
    return rows.select(*(digits(c) if c in ("minx", "miny", "maxx", "maxy") else c for c in rows.columns))


def project_extents(spark: SparkSession, d: str) -> DataFrame:
    target = F.lit(8183) - F.col("crs_code")  # 4326 and 3857 change places
    rows = _boxes(spark, d).select("id", target.alias("target_crs"), geometry.project(F.col("extent"), F.col("crs_code"), target).alias("e"))
    return _rounded(rows.select("id", "target_crs", "e.*"), "target_crs")


def cached_geometry(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(spark, d).withColumn("cached_geometry", geometry.cached_geometry(F.col("extent"), F.col("crs_code")))
    return _rounded(geometry.explode_cached(rows, "id"), "crs_code")


def extent_from_geotransform(spark: SparkSession, d: str) -> DataFrame:
    box = geometry.extent_of_grid(*map(F.col, ("origin_x", "origin_y", "px_w", "px_h", "width", "height")))
    rows = fx.table(spark, d, fx.GRIDS).select("id", box.alias("e"), F.coalesce(F.lower("layout") == "cog", F.lit(False)).alias("is_cog"), F.coalesce("epsg", F.lit(0)).alias("crs_code"))
    return rows.select("id", "e.*", "is_cog", "crs_code")


def pixel_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = raster.tile_grid(_request(spark, TILE))
    return grid.select("px", "py", "gx", "gy", "cx", "cy")


def band_stats(spark: SparkSession, d: str) -> DataFrame:
    nodata = spark.range(1).select(F.lit(NAME).alias("layer"), F.lit(NODATA).cast("float").alias("nodata"))
    return raster.band_stats(_pixels(spark, d), nodata)


def nodata_mask(spark: SparkSession, d: str) -> DataFrame:
    nodata = F.lit(NODATA).cast("float")
    v = F.col("v")
    return _pixels(spark, d).select("row_", "col", raster.present(v, nodata).isNull().alias("no_data"), raster.visible(v, nodata).isNull().alias("hidden"), raster.visible(v, nodata).alias("value"))


def extent_mask(spark: SparkSession, d: str) -> DataFrame:
    grid = raster.tile_grid(_request(spark, TILE))
    box = geometry.extent(F.lit(10000.0), F.lit(22000.0), F.lit(138000.0), F.lit(140000.0))
    return grid.select("px", "py", raster.outside(F.col("gx"), F.col("gy"), box, F.lit(3857)).alias("hidden"))


def warp_nearest(spark: SparkSession, d: str) -> DataFrame:
    layer = _layer(spark, d, "grayscale").select("layer", "crs_code", "origin_x", "origin_y", "px_w", "px_h")
    asked = _request(spark, TILE).join(layer, "layer")
    grid = raster.source_place(raster.tile_grid(asked))
    return raster.warp_nearest(grid, raster.reachable(_pixels(spark, d), raster.spans(asked))).select("px", "py", "src_row", "src_col", F.when(~F.isnan("v"), F.col("v")).alias("v"))


BATCH = ((8, 128, 127), (9, 256, 254), (9, 257, 255), (10, 513, 508), (3, 0, 0))
CONSTANT = 5.0


def tile_png(spark: SparkSession, d: str) -> DataFrame:
    requests = _request(spark, *BATCH)
    rgba = tiles.tile_rgba(requests, _layer(spark, d, "default", fx.STOPS), _pixels(spark, d), palettes=())
    return tiles.tile_png(rgba)


def tile_png_pixels(spark: SparkSession, d: str) -> DataFrame:
    """What the PNG files of tile_png() hold."""
    return tiles.png_pixels(tile_png(spark, d)).drop("layer")


def constant_raster(spark: SparkSession, d: str) -> DataFrame:
    """What the three ways of colouring make of a raster of one value."""
    v = F.lit(CONSTANT).cast("float")
    gray, ramp, pal = colour.grayscale(v, v, v), colour.stops_literal(v, v, v, fx.STOPS), colour.palette("viridis", v, v, v)
    named = [c.alias(f"{way}_{n}") for way, cs in (("gray", gray), ("stops", ramp), ("palette", pal)) for c, n in zip(cs, colour.CHANNELS, strict=True)]
    return fx.table(spark, d, fx.RASTER).select("row_", "col", *named)


def file_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.raster_files(fx.table(spark, d, fx.FILES)).select("ord", "path", "layer", "style")


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return fx.table(spark, d, fx.FILES).select("ord", paths.stem(p).alias("stem"), paths.extension(p).alias("extension"), F.when(~F.col("at_root"), paths.style_of(p)).alias("style"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cache = catalog.last_by(fx.table(spark, d, fx.CACHE), "layer", "ord").withColumnRenamed("ord", "cached_ord")
    return catalog.cache_split(catalog.raster_files(fx.table(spark, d, fx.FILES)), cache)


def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[0].select("ord", "layer", "size_bytes", "last_modified", "cached_ord")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)[1].select("ord", "layer", "size_bytes", "last_modified")


def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    hit, miss = (x.select("ord", "layer", F.lit(c).alias("from_cache")) for x, c in zip(_split(spark, d), (True, False), strict=True))
    return hit.unionByName(miss)


def cache_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return catalog.last_by(fx.table(spark, d, fx.CACHE), "layer", "ord")


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, fx.LAYERS_FLAT)
    box = geometry.extent(F.col("ord") * 1.0, F.col("ord") * 2.0, F.col("ord") * 1.0 + 10, F.col("ord") * 2.0 + 10)
    return rows.select("layer", (F.col("ord") * 10).alias("size_bytes"), (F.col("ord") + 1700000000).alias("last_modified"), F.lit(3857).alias("crs_code"), "min_value", "max_value", "is_cog", box.alias("extent"))


def cache_flatten(spark: SparkSession, d: str) -> DataFrame:
    return catalog.flatten(_records(spark, d))


def cache_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return catalog.flatten(catalog.nest(catalog.flatten(_records(spark, d))))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    files = catalog.raster_files(fx.table(spark, d, fx.FILES))
    flat = fx.table(spark, d, fx.LAYERS_FLAT).select("ord", "min_value", "max_value", "is_cog")
    stops = F.when(F.col("style") == "default", _stops(fx.STOPS)).otherwise(F.array().cast(f"array<{STOP}>"))
    return files.join(flat, "ord").withColumn("colour_stops", stops)


def layer_index(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.layer_index(_layers(spark, d))
    return rows.select("layer", F.size("styles").alias("n"), F.array_join(F.transform("styles", lambda s: F.concat(s["path"], F.lit("|"), s["style"])), ";").alias("styles"))


def first_layer_per_name(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_per_name(_layers(spark, d).withColumn("rank_path", F.struct("path", "ord")), "rank_path").select("layer", "path", "style", "ord")


def _all_layers(spark: SparkSession, d: str) -> DataFrame:
    stops = F.when(F.col("style") == "default", _stops(fx.STOPS)).otherwise(F.array().cast(f"array<{STOP}>"))
    return fx.table(spark, d, fx.LAYERS_FLAT).withColumn("colour_stops", stops)


def style_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.style_summary(_all_layers(spark, d))
    return rows.select("style", "n_layers", F.size("stops").alias("n_stops"), "min_value", "max_value", "n_cogs", F.aggregate("breaks", F.lit(0.0), lambda a, x: a + x).alias("sum_of_breaks"), "uncovered", "some_not_cog")


def style_warnings(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.warnings(catalog.style_summary(_all_layers(spark, d)))
    return rows.select("style", F.array_join("warnings", ",").alias("warnings"))


def load_progress(spark: SparkSession, d: str) -> DataFrame:
    return catalog.load_progress(catalog.raster_files(fx.table(spark, d, fx.FILES)))


def list_layers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_layers(_layers(spark, d)).select("layer", "style", "path")


def layers_response(spark: SparkSession, d: str) -> DataFrame:
    """With a box made of the order number as each layer's geometry, taken apart for the comparison."""
    box = geometry.extent(F.col("ord") * 1.0, F.col("ord") * 2.0, F.col("ord") + 10.0, F.col("ord") * 2.0 + 10)
    rows = catalog.layers_response(_layers(spark, d).withColumn("cached_geometry", geometry.cached_geometry(box, F.lit(3857))))
    return rows.select("layer", "style", F.col("geometry")[3857]["extent"]["minx"].alias("minx"), F.map_contains_key("geometry", 4326).alias("has_4326"))


def first_layer(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_layers(_layers(spark, d)).limit(1).select("layer", "style", "path")


def style_parse(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([(f, i, x) for f, xs in fx.STYLE_LINES.items() for i, x in enumerate(xs)], "file string, ix int, line string")
    rows = parse_styles(lines).select("file", F.posexplode("colour_stops").alias("ix", "s"))
    return rows.select("file", "ix", *(F.col("s")[c].alias(c) for c in ("value", *colour.STOP_FIELDS)))


def style_join(spark: SparkSession, d: str) -> DataFrame:
    """Layers with the stops of their folder's style file."""
    lines = spark.createDataFrame([("default", i, x) for i, x in enumerate(fx.STYLE_LINES["good"])] + [("viridis", 0, "1,2,3,4,5")], "file string, ix int, line string")
    rows = with_stops(fx.table(spark, d, fx.LAYERS_FLAT).withColumn("folder", F.col("style")), parse_styles(lines))
    return rows.select("ord", "style", F.size("colour_stops").alias("n_stops"))


def stop_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring stops in file order."""
    rows = spark.createDataFrame([("default", i, s[0]) for i, s in enumerate(fx.STOPS)], "style string, ix int, value float")
    w = Window.partitionBy("style").orderBy("ix")
    return rows.select("style", "ix", "value", F.lead("value").over(w).alias("next_value")).where("next_value IS NOT NULL")


def colour_bar(spark: SparkSession, d: str) -> DataFrame:
    gray = spark.range(1).select(F.lit("grayscale").alias("style"), F.posexplode(colour.colour_bar_gray()).alias("ix", "r")).select("style", "ix", "r", F.col("r").alias("g"), F.col("r").alias("b"))
    out = gray.unionByName(spark.createDataFrame([("default", i, *s[1:4]) for i, s in enumerate(fx.STOPS)], "style string, ix int, r int, g int, b int"))
    for name in palettes.NAMES:
        out = out.unionByName(spark.range(1).select(F.lit(name).alias("style"), F.posexplode(colour.colour_bar_palette(name)).alias("ix", "c")).select("style", "ix", "c.*"))
    return out


def palette_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every built-in palette at 101 places."""
    out = None
    for name in palettes.NAMES:
        t = (F.col("id") / F.lit(100.0)).alias("t")
        part = spark.range(101).select(F.lit(name).alias("style"), F.col("id").alias("ix"), *(c.alias(n) for c, n in zip(palettes.gradient(name, t), colour.CHANNELS, strict=True)))
        out = part if out is None else out.unionByName(part)
    return out


def format_mib(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, fx.FILES).select("ord", catalog.mib(F.col("size_bytes")).alias("mib"))


QUERIES: dict[str, Query] = {
    "tile_grayscale": _tile("grayscale", colour.grayscale),
    "tile_stops": _tile("default", lambda *v, norm: colour.stops_literal(*v, fx.STOPS, norm=norm), fx.STOPS),
    "tile_stops_column": _tile("default", None, fx.STOPS),
    "tile_gradient": _tile("viridis", lambda *v, norm: colour.palette("viridis", *v, norm=norm)),
    "tile_batch": _tile("default", lambda *v, norm: colour.stops_literal(*v, fx.STOPS, norm=norm), fx.STOPS, BATCH),
} | {
    f.__name__: f
    for f in (
        tile_bounds, mercator_fwd, mercator_inv, mercator_clamp, project_extents, cached_geometry, extent_from_geotransform, pixel_grid, band_stats, nodata_mask,
        extent_mask, warp_nearest, constant_raster, tile_png, tile_png_pixels, file_filter, path_parts, cache_hits, cache_misses, catalog_union, cache_flatten, cache_roundtrip,
        cache_dedupe, layer_index, first_layer_per_name, style_summary, style_warnings, load_progress, list_layers, layers_response, first_layer, style_parse,
        style_join, stop_intervals, colour_bar, palette_samples, format_mib,
    )
}
