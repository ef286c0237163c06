"""Inputs derived from the test tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A raster of 128 columns in Web Mercator: origin (10000, 140000), pixels of 1000 m, nodata -9999, with NaN and 0.
RASTER = """
select cast(o_orderkey % 128 as int) as col, cast((o_orderkey - o_orderkey % 128) / 128 as int) as row_,
  case when o_orderkey % 10 = 3 then cast('NaN' as float) when o_orderkey % 17 = 5 then cast(0 as float)
    when o_orderkey % 13 = 7 then cast(-9999 as float) else cast(o_totalprice as float) end as v
from orders"""
POINTS = """
select o_orderkey as id, cast((o_orderkey * 7919) % 360000 as double) / 1000e0 - 180e0 as lon,
  cast((o_orderkey * 104729) % 180000 as double) / 1000e0 - 90e0 as lat
from orders"""
REQUESTS = """
select o_orderkey as id, cast(o_orderkey % 19 as int) as z,
  (o_orderkey * 31) % cast(power(2e0, cast(o_orderkey % 19 as double)) as bigint) as x,
  (o_orderkey * 17) % cast(power(2e0, cast(o_orderkey % 19 as double)) as bigint) as y
from orders"""
BOXES = """
select s_suppkey as id, case when s_suppkey % 2 = 0 then 4326 else 3857 end as crs_code,
  case when s_suppkey % 2 = 0 then cast(s_suppkey % 170 as double) - 180e0 else s_suppkey * 1000e0 end as minx,
  case when s_suppkey % 2 = 0 then cast(s_suppkey % 80 as double) - 90e0 else s_suppkey * 2000e0 end as miny,
  case when s_suppkey % 2 = 0 then cast(s_suppkey % 170 as double) - 170e0 else s_suppkey * 1000e0 + 5000e0 end as maxx,
  case when s_suppkey % 2 = 0 then cast(s_suppkey % 80 as double) - 85e0 else s_suppkey * 2000e0 + 5000e0 end as maxy
from supplier"""
_STYLE = "case p_partkey % 5 when 0 then 'viridis' when 1 then 'magma' when 2 then 'default' when 3 then 'grayscale' else 'turbo' end"
FILES = f"""
select p_partkey as ord, p_partkey % 11 = 0 as at_root,
  concat('/data/', case when p_partkey % 11 = 0 then '' else concat({_STYLE}, '/') end, replace(p_name, ' ', '_'),
    case p_partkey % 6 when 0 then '.tif' when 1 then '.TIFF' when 2 then '.GeoTiff' when 3 then '.geotif' when 4 then '.txt' else '.png' end) as path,
  cast(p_size * 1000 + p_partkey as bigint) as size_bytes, cast(1700000000 + p_partkey as bigint) as last_modified
from part"""
CACHE = """
select p_partkey as ord, replace(p_name, ' ', '_') as layer,
  cast(p_size * 1000 + p_partkey + case when p_partkey % 5 = 0 then 1 else 0 end as bigint) as size_bytes,
  cast(1700000000 + p_partkey + case when p_partkey % 7 = 0 then 1 else 0 end as bigint) as last_modified
from part where p_partkey % 3 <> 0"""
LAYERS_FLAT = f"""
select p_partkey as ord, replace(p_name, ' ', '_') as layer, {_STYLE} as style,
  cast(p_size as float) as min_value, cast(p_retailprice as float) as max_value, p_partkey % 4 <> 0 as is_cog
from part"""
GRIDS = """
select p_partkey as id, cast(p_size as double) * 10e0 as origin_x, cast(p_partkey as double) as origin_y, cast(p_partkey % 7 + 1 as double) as px_w,
  cast(0 - (p_partkey % 3 + 1) as double) as px_h, cast(p_partkey % 50 + 1 as int) as width, cast(p_partkey % 40 + 1 as int) as height,
  case p_partkey % 4 when 0 then 'COG' when 1 then 'cog' when 2 then 'strips' else cast(null as string) end as layout,
  case when p_partkey % 5 = 0 then cast(null as int) else 32633 end as epsg
from part"""
#: The colour ramp of the fixtures.
STOPS = ((0.0, 215, 25, 28, 255), (100.0, 253, 174, 97, 255), (200.0, 255, 255, 191, 255), (300.0, 171, 221, 164, 255), (400.0, 43, 131, 186, 255))
STYLE_LINES = {
    "good": ["# ramp", "INTERPOLATION:INTERPOLATED", *(f"{s[0]:.0f},{s[1]},{s[2]},{s[3]},{s[4]},label" for s in STOPS), "", "  "],
    "short": ["1,2,3,4", "5,6,7,8,9", "#1,2,3,4,5"],
    "too_large": ["1,256,3,4,5", "2,3,4,5,6"],
    "spaced": ["1, 2,3,4,5"],
    "words": ["1,2,3,4,5", "low,2,3,4,5"],
    "negative": ["-1.5,0,0,0,0", "2e1,255,255,255,255"],
    "comments": ["# nothing", "INTERPOLATION:DISCRETE"],
}


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture over the test tables in a folder."""
    for name in ("orders", "part", "supplier"):
        if f"from {name}" in sql:
            return spark.sql(sql.replace(f"from {name}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    raise ValueError("no known table in the SQL")
