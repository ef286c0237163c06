"""A folder of style folders with GeoTIFF files: listing, metadata cache and catalogue."""

from __future__ import annotations

import csv
import io
import logging
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.mercator import is_utm, supported
from mapweave.functions.paths import EXTENSIONS
from mapweave.operators import catalog, geometry
from mapweave.operators.raster import PixelSource
from mapweave.schema import CACHE, LAYERS, STOP
from mapweave.sources import geotiff
from mapweave.sources.files import local, read_all
from mapweave.sources.stylefile import parse_styles, with_stops

CACHE_FILE = ".metadata_cache.csv"
log = logging.getLogger(__name__)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, at_root, size_bytes, last_modified of everything below a folder; what can't be looked at is left out or has defaults.

    Local folders are walked here, since Spark's listing hides names that begin
    with a dot or underscore; other file systems are listed by Spark.
    """
    kind = "path string, at_root boolean, size_bytes bigint, last_modified bigint"
    if "://" in root:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        base = root.rstrip("/")
        rest = F.substring_index("path", base + "/", -1)
        return found.select("path", (~rest.contains("/")).alias("at_root"), F.col("length").alias("size_bytes"), F.greatest(F.lit(0), F.unix_seconds("modificationTime")).alias("last_modified"))
    rows = []
    for folder, folders, names in os.walk(root, onerror=lambda _: None):
        for name in sorted(names + [x for x in folders if x.lower().endswith(EXTENSIONS)]):
            path = os.path.join(folder, name)
            try:
                stat = os.stat(path)
                rows.append((path, folder == root, stat.st_size, max(0, int(stat.st_mtime))))
            except OSError:
                rows.append((path, folder == root, 0, int(time.time())))
    return spark.createDataFrame(rows, kind)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """Records of a cache file; none if it is missing or can't be read, and without its bad rows."""
    kinds = {"string": str, "bigint": int, "int": int, "float": float, "double": float, "boolean": {"true": True, "false": False}.__getitem__}
    rows = []
    try:
        for row in csv.DictReader(io.StringIO(read_all(path).decode("utf-8", "replace"), newline="")):
            try:
                rows.append(tuple(kinds[f.dataType.simpleString()](row[f.name]) for f in CACHE.fields))
            except (KeyError, ValueError, TypeError):
                continue
    except OSError:
        pass
    return spark.createDataFrame(rows, CACHE)


def save_cache(records: DataFrame, path: str) -> None:
    """Writes the records, one a layer file, over the old ones, in local folders only. Errors of the file system are passed over: a cache may be missing."""
    plain = local(path)
    if plain is None:
        return
    try:
        with open(plain, "w", newline="") as file:
            out = csv.writer(file)
            out.writerow(CACHE.names)
            for row in records.select(*CACHE.names).toLocalIterator():
                out.writerow([str(x).lower() if isinstance(x, bool) else x for x in row])
    except OSError:
        pass


def read_styles(folders: DataFrame) -> DataFrame:
    """file (the folder) and colour_stops of the style.txt files that exist in `folders` (folder); read in the executors."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for folder in batch.column("folder").to_pylist():
                try:
                    found += [(folder, i, line) for i, line in enumerate(read_all(f"{folder}/style.txt").decode("utf-8").split("\n"))]
                except (OSError, UnicodeDecodeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["file", "ix", "line"])

    return parse_styles(folders.select("folder").distinct().mapInArrow(rows, "file string, ix int, line string"))


def build_catalog(spark: SparkSession, root: str, use_cache: bool = True, band: int = 1, default_style: str = "default") -> tuple[DataFrame, DataFrame]:
    """The layers below a root, a local folder or the URI of one, and (path, error) of the files that can't be layers.

    Headers and statistics of all files that the cache doesn't answer are read
    in parallel. A cached record answers for a file of the same stem, size and
    time whose place in the tree is the only one with that stem. What fails is
    logged, and how many files and bytes were loaded.
    """
    files = catalog.raster_files(list_files(spark, root), default_style).withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    cache_path = f"{root.rstrip('/')}/{CACHE_FILE}"
    names = files.groupBy("layer").agg(F.count("*").alias("n_files"))
    files = files.join(names, "layer")
    cache = load_cache(spark, cache_path).dropDuplicates(["layer"]) if use_cache else spark.createDataFrame([], CACHE)
    hits, _ = catalog.cache_split(files.where("n_files = 1"), catalog.nest(cache))
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
    if not total["n"]:
        return spark.createDataFrame([], LAYERS), spark.createDataFrame([], "path string, error string")
    known = hits.select("path", *(F.col(c).alias(f"old_{c}") for c in ("min_value", "max_value")))
    asked = files.select("path").join(known.select("path", F.lit(True).alias("cached")), "path", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    heads = geotiff.read_headers(asked.repartition(max(1, min(total["n"], 10_000))), band).cache()
    rows = files.join(heads, "path").join(known, "path", "left")
    unknown = ~supported(F.col("crs_code"))
    errors = rows.select("path", F.when(F.col("error").isNotNull(), F.col("error")).when(unknown, F.concat(F.lit("coordinate system EPSG:"), F.col("crs_code").cast("string"), F.lit(" isn't supported"))).alias("error")).where("error IS NOT NULL")
    good = rows.where(F.col("error").isNull() & ~unknown).withColumns({"min_value": F.coalesce("old_min_value", "min_value"), "max_value": F.coalesce("old_max_value", "max_value")})
    utm = not good.where(is_utm(F.col("crs_code"))).isEmpty()
    box = geometry.extent_of_grid(*map(F.col, ("origin_x", "origin_y", "px_w", "px_h", "width", "height")))
    good = good.withColumn("extent", box).withColumn("cached_geometry", geometry.cached_geometry(F.col("extent"), F.col("crs_code"), utm))
    good = with_stops(good, read_styles(files)).withColumn("colour_stops", F.coalesce("colour_stops", F.array().cast(f"array<{STOP}>")))
    layers = good.select(*spark.createDataFrame([], LAYERS).columns)
    if use_cache:
        save_cache(catalog.last_by(catalog.flatten(layers).withColumn("path", F.monotonically_increasing_id()), "layer", "path"), cache_path)
    failed = 0
    for row in errors.toLocalIterator():
        failed += 1
        log.warning("%s: %s", row["path"], row["error"])
    log.info("%d of %d files, %.2f MiB", total["n"] - failed, total["n"], total["bytes"] / 1024 / 1024)
    return layers, errors


def pixels_of(layers: DataFrame, band: int = 1) -> PixelSource:
    """The pixels of the layers' files: a function of the wanted rectangles (layer, r0, r1, c0, c1), which reads no other blocks."""
    return lambda near: geotiff.read_pixels(layers, near, band)
