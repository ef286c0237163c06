"""Colour ramps in text files: value,red,green,blue,alpha[,label] lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.palettes import is_palette
from mapweave.schema import STOP

_NUMBER = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
_BYTE = r"^[+]?[0-9]+$"


def _field(parts: Column, k: int) -> Column:
    """A field's number; null unless the whole field, spaces included, is one."""
    raw = F.get(parts, F.lit(k))
    if k == 0:
        return F.when(F.lower(raw).rlike(_NUMBER), raw.try_cast("float"))
    number = F.when(raw.rlike(_BYTE), raw.try_cast("int"))
    return F.when(number.between(0, 255), number)


def parse_styles(lines: DataFrame) -> DataFrame:
    """file and colour_stops of lines (file, ix, line), in line order.

    Lines that start with # or INTERPOLATION, blank ones and those of fewer than
    five fields are passed over. One field that isn't a number of its kind
    makes the whole file fail: it has no stops.
    """
    line = F.col("line")
    parts = F.split(line, ",", -1)
    used = ~(line.startswith("#") | line.startswith("INTERPOLATION") | (F.trim(F.translate(line, "\t\r", "  ")) == "")) & (F.size(parts) >= 5)
    stop = F.struct(*(_field(parts, k).alias(n) for k, n in enumerate(("value", "red", "green", "blue", "alpha"))))
    ok = F.forall(F.array(*(_field(parts, k).isNotNull() for k in range(5))), lambda x: x)
    rows = lines.select("file", "ix", F.when(used, stop).alias("stop"), F.when(used, ok).alias("ok"))
    files = rows.groupBy("file").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.array_sort(F.collect_list(F.when(F.col("stop").isNotNull(), F.struct("ix", "stop")))).alias("found"))
    return files.select("file", F.when(F.col("ok"), F.transform("found", lambda s: s["stop"])).otherwise(F.array()).cast(f"array<{STOP}>").alias("colour_stops"))


def with_stops(layers: DataFrame, styles: DataFrame) -> DataFrame:
    """Layers (style, folder) with the stops of their folder's file; none for built-in palettes and missing files."""
    found = layers.join(styles.select(F.col("file").alias("folder"), F.col("colour_stops").alias("found")), "folder", "left")
    none = F.array().cast(f"array<{STOP}>")
    return found.withColumn("colour_stops", F.when(is_palette(F.col("style")), none).otherwise(F.coalesce("found", none))).drop("found")
