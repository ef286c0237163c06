"""Names in file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = ("tif", "tiff", "geotiff", "geotif")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1))


def style_of(path: Column, default: str = "default") -> Column:
    """The name of the folder that holds the file."""
    parts = F.split(path, "/")
    folder = F.try_element_at(parts, F.lit(-2))
    return F.when(folder.isNull() | (folder == ""), F.lit(default)).otherwise(folder)


def is_raster(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)
