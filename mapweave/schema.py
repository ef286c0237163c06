"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

EXTENT = "struct<minx:double,miny:double,maxx:double,maxy:double>"
GEOMETRY = f"struct<crs_code:int,extent:{EXTENT}>"
STOP = "struct<value:float,red:int,green:int,blue:int,alpha:int>"

#: One row a layer. The grid's place and nodata are kept, so that tiles need no second look at the file.
LAYERS = (
    f"layer string, style string, path string, size_bytes bigint, crs_code int, extent {EXTENT}, cached_geometry map<int,{GEOMETRY}>, colour_stops array<{STOP}>, "
    "min_value float, max_value float, is_cog boolean, last_modified bigint, width int, height int, origin_x double, origin_y double, px_w double, px_h double, nodata float"
)
PIXELS = "layer string, row_ int, col int, v float"

#: The flat cache record, in the order of its columns.
CACHE = T.StructType(
    [T.StructField("layer", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("last_modified", T.LongType()), T.StructField("crs_code", T.IntegerType()), T.StructField("min_value", T.FloatType()), T.StructField("max_value", T.FloatType()), T.StructField("is_cog", T.BooleanType())]
    + [T.StructField(f"extent_{side}", T.DoubleType()) for side in ("minx", "miny", "maxx", "maxy")]
)
