"""SQL for DuckDB with the results of the registered queries."""

from __future__ import annotations

from mapweave.functions import palettes
from mapweave.plans import fixtures as fx

_C, _R, _MAX = "20037508.342789244e0", "6378137e0", "85.05112877980659e0"
_RES0 = "(2e0 * 20037508.342789244e0 / 256e0)"


def _bounds(z: str, x: str, y: str) -> str:
    res = f"({_RES0} / power(2e0, cast({z} as double)))"
    fx_, fy = f"cast({x} as double)", f"cast({y} as double)"
    return f"{fx_} * 256e0 * {res} - {_C} as minx, {_C} - ({fy} + 1) * 256e0 * {res} as miny, ({fx_} + 1) * 256e0 * {res} - {_C} as maxx, {_C} - {fy} * 256e0 * {res} as maxy"


_LON, _LAT = f"{{x}} / ({_R} * pi() / 180e0)", f"(2e0 * atan(exp({{y}} / {_R})) - pi() / 2e0) * 180e0 / pi()"
_MX, _MY = f"{{x}} * {_R} * pi() / 180e0", f"{_R} * ln(tan(pi() / 4e0 + greatest(-{_MAX}, least({_MAX}, {{y}})) * pi() / 180e0 / 2e0))"

_KEYS = "(values {}) as t(z, x, y)"
_ONE = _KEYS.format("(8, 128, 127)")
_BATCH = _KEYS.format("(8, 128, 127), (9, 256, 254), (9, 257, 255), (10, 513, 508), (3, 0, 0)")


def _grid(keys: str) -> str:
    return f"""
  select z, x, y, px, py, minx + px * res_x as gx, maxy - py * res_y as gy, minx + (px + 0.5e0) * res_x as cx, maxy - (py + 0.5e0) * res_y as cy
  from (select *, (maxx - minx) / 256e0 as res_x, (maxy - miny) / 256e0 as res_y from (select z, x, y, {_bounds("z", "x", "y")} from {keys}) b) b,
    (select cast(r % 256 as int) as px, cast(r // 256 as int) as py from range(65536) as t(r)) p"""


_HEIGHT = "(select max(row_) + 1 from raster)"


def _tile(keys: str, body: str, columns: str) -> str:
    """The masked values of the tiles as `m` (px, py, v, mn, mx), and a select over them."""
    return f"""
with raster as ({fx.RASTER}), grid as ({_grid(keys)}), stats as (
  select cast(min(v) as float) as mn, cast(max(v) as float) as mx from raster where not isnan(v) and v <> cast(-9999 as float)
), placed as (
  select *, cast(floor((cx - 10000e0) / 1000e0) as int) as c, cast(floor((cy - 140000e0) / -1000e0) as int) as w from grid
), m as (
  select z, x, y, px, py, mn, mx,
    case when isnan(v) or v = cast(-9999 as float) or v = cast(0 as float) or gx < 10000e0 - 1e-6 or gx > 138000e0 + 1e-6
      or gy > 140000e0 + 1e-6 or gy < 140000e0 - 1000e0 * {_HEIGHT} - 1e-6 then null else v end as v
  from placed left join raster on col = c and row_ = w, stats
), n as (
  select *, greatest(cast(0 as float), least(cast(1 as float), cast((v - mn) / (mx - mn) as float))) as t from m
){body}
select {columns}"""


_GRAY = "case when v is null then 0 else cast(floor(t * cast(255 as float)) as int) end"
_S0, _S1 = (f"cast({s[0]} as float)" for s in (fx.STOPS[0], fx.STOPS[-1]))


def _ramp(k: int) -> str:
    f = lambda x: f"cast({x} as float)"
    cases = ""
    for a, b in zip(fx.STOPS, fx.STOPS[1:], strict=False):
        u = f"cast((s - {f(a[0])}) / ({f(b[0])} - {f(a[0])}) as float)"
        cases += f" when s >= {f(a[0])} and s <= {f(b[0])} then cast(floor((cast(1 as float) - {u}) * {f(a[k])} + {u} * {f(b[k])}) as int)"
    return f"case when v is null then 0{cases} else 0 end"


_SCALED = f", q as (select *, {_S0} + t * ({_S1} - {_S0}) as s from n)"
_RAMPS = ", ".join(f"{_ramp(k)} as {n}" for k, n in enumerate("rgba", 1))


def _byte(x: str) -> str:
    return f"cast(floor(greatest(0e0, least(255e0, {x})) + 0.5e0) as int)"


def _spline(name: str, channel: int) -> str:
    """A channel of a palette of control colours at d, by the four cubic basis functions over mirrored ends."""
    values = [bytes.fromhex(h)[channel] for h in palettes.CONTROLS[name].split()]
    padded = [2 * values[0] - values[1], *values, 2 * values[-1] - values[-2]]
    n = len(values) - 1
    i = f"least(cast(floor(d * {n}e0) as int), {n - 1})"
    v = [f"cast(list_extract([{', '.join(map(str, padded))}], {i} + {k + 1}) as double)" for k in range(4)]
    u = f"(d * {n}e0 - {i})"
    return _byte(f"((1 - 3 * {u} + 3 * ({u} * {u}) - {u} * {u} * {u}) * {v[0]} + (4 - 6 * ({u} * {u}) + 3 * ({u} * {u} * {u})) * {v[1]} + (1 + 3 * {u} + 3 * ({u} * {u}) - 3 * ({u} * {u} * {u})) * {v[2]} + {u} * {u} * {u} * {v[3]}) / 6")


def _helix(hue: str, saturation: str, light: str) -> list[str]:
    """Green's colour helix: a spiral around the grey diagonal."""
    turn, width = f"(({hue} + 120e0) * pi() / 180e0)", f"({saturation} * {light} * (1 - {light}))"
    parts = (("-0.14861e0", "1.78277e0"), ("-0.29227e0", "-0.90649e0"), ("1.97294e0", "0e0"))
    return [_byte(f"255e0 * ({light} + {width} * ({a} * cos({turn}) + {b} * sin({turn})))") for a, b in parts]


def _palette(name: str) -> list[str]:
    """Red, green and blue of a built-in palette at d."""
    if name in palettes.CONTROLS:
        return [_spline(name, k) for k in range(3)]
    if name == "turbo":
        return [_byte(" + ".join(f"({c!r}e0) * power(d, {k}e0)" for k, c in enumerate(p))) for p in palettes.TURBO]
    if name == "sinebow":
        return [_byte(f"255e0 * power(sin((0.5e0 - d) * pi() + {k}e0 * pi() / 3e0), 2e0)") for k in range(3)]
    if name == "rainbow":
        return _helix("(360e0 * d - 100e0)", "(1.5e0 - 1.5e0 * abs(d - 0.5e0))", "(0.8e0 - 0.9e0 * abs(d - 0.5e0))")
    return _helix("(300e0 - 540e0 * d)", "0.5e0", "d")


def _samples(name: str) -> str:
    return f"select '{name}' as style, ix, {', '.join(f'{c} as {n}' for c, n in zip(_palette(name), 'rgb', strict=True))}, 255 as a from (select i as ix, i / 100e0 as d from range(101) as t(i)) s"


_STEM, _EXT = "regexp_replace(list_extract(string_split(path, '/'), -1), '[.][^.]*$', '')", "lower(regexp_extract(path, '[.]([^./]*)$', 1))"
_KEPT = f"""kept as (
  select ord, path, {_STEM} as layer, list_extract(string_split(path, '/'), -2) as style, size_bytes, last_modified
  from ({fx.FILES}) f where not at_root and {_EXT} in ('tif', 'tiff', 'geotiff', 'geotif')
)"""
_OLD = f"old as (select * from ({fx.CACHE}) c qualify row_number() over (partition by layer order by ord desc) = 1)"
_RECORDS = f"""
select layer, cast(ord * 10 as bigint) as size_bytes, cast(ord + 1700000000 as bigint) as last_modified, 3857 as crs_code, min_value, max_value, is_cog,
  cast(ord as double) as extent_minx, ord * 2e0 as extent_miny, ord + 10e0 as extent_maxx, ord * 2e0 + 10 as extent_maxy
from ({fx.LAYERS_FLAT}) f"""
_SUMMARY = f"""
select style, count(*) as n_layers, case when style = 'default' then {len(fx.STOPS)} else 0 end as n_stops, min(min_value) as min_value, max(max_value) as max_value,
  cast(count(*) filter (where is_cog) as bigint) as n_cogs, case when style = 'default' then {sum(s[0] for s in fx.STOPS)}e0 else 0e0 end as sum_of_breaks,
  style = 'default' and (min(min_value) < 0 or max(max_value) > 400) as uncovered, count(*) filter (where is_cog) < count(*) as some_not_cog
from ({fx.LAYERS_FLAT}) f group by style"""
_PARSED = [(f, i, *x) for f, xs in {"good": fx.STOPS, "short": [(5.0, 6, 7, 8, 9)], "negative": [(-1.5, 0, 0, 0, 0), (20.0, 255, 255, 255, 255)]}.items() for i, x in enumerate(xs)]
_e = "minx, miny, maxx, maxy"


def _box(kind: str) -> str:
    """minx to maxy of a box in the other system, rounded."""
    if kind == "to_3857":
        return ", ".join(f"round({(_MX if c[-1] == 'x' else _MY).format(x=c, y=c)}, 3) as {c}" for c in _e.split(", "))
    return ", ".join(f"round({(_LON if c[-1] == 'x' else _LAT).format(x=c, y=c)}, 6) as {c}" for c in _e.split(", "))


_SAME = ", ".join(f"case when crs_code = 4326 then round({c}, 6) else round({c}, 3) end as {c}" for c in _e.split(", "))
_PROJECTED = f"""
select id, 3857 as target_crs, {_box("to_3857")} from ({fx.BOXES}) b where crs_code = 4326
union all select id, 4326, {_box("to_4326")} from ({fx.BOXES}) b where crs_code = 3857"""

ORACLES: dict[str, str] = {
    "tile_bounds": f"select *, (maxx - minx) / 256e0 as res_x, (maxy - miny) / 256e0 as res_y from (select id, z, x, y, {_bounds('z', 'x', 'y')} from ({fx.REQUESTS}) r) b",
    "mercator_fwd": f"select id, round({_MX.format(x='lon')}, 3) as x, round({_MY.format(y='lat')}, 3) as y from ({fx.POINTS}) p",
    "mercator_inv": f"select id, round({_LON.format(x='(lon * 111000e0)')}, 6) as lon, round({_LAT.format(y='(lat * 111000e0)')}, 6) as lat from ({fx.POINTS}) p",
    "mercator_clamp": f"select id, round({_MY.format(y='lat')}, 3) as y from ({fx.POINTS}) p where abs(lat) > {_MAX}",
    "project_extents": _PROJECTED,
    "cached_geometry": f"select id, crs_code, {_SAME} from ({fx.BOXES}) b union all select id, target_crs, {_e} from ({_PROJECTED}) p",
    "extent_from_geotransform": f"select id, origin_x as minx, origin_y + px_h * height as miny, origin_x + px_w * width as maxx, origin_y as maxy, coalesce(lower(layout) = 'cog', false) as is_cog, coalesce(epsg, 0) as crs_code from ({fx.GRIDS}) g",
    "pixel_grid": f"select px, py, gx, gy, cx, cy from ({_grid(_ONE)}) g",
    "band_stats": f"select 'orders' as layer, min(v) as min_value, max(v) as max_value from ({fx.RASTER}) r where not isnan(v) and v <> cast(-9999 as float)",
    "nodata_mask": f"select row_, col, isnan(v) or v = -9999 as no_data, isnan(v) or v = -9999 or v = 0 as hidden, case when isnan(v) or v = -9999 or v = 0 then null else v end as value from ({fx.RASTER}) r",
    "extent_mask": f"select px, py, gx < 10000e0 - 1e-6 or gx > 138000e0 + 1e-6 or gy < 22000e0 - 1e-6 or gy > 140000e0 + 1e-6 as hidden from ({_grid(_ONE)}) g",
    "warp_nearest": f"with raster as ({fx.RASTER}), placed as (select *, cast(floor((cx - 10000e0) / 1000e0) as int) as src_col, cast(floor((cy - 140000e0) / -1000e0) as int) as src_row from ({_grid(_ONE)}) g) select px, py, src_row, src_col, case when not isnan(v) then v end as v from placed left join raster on col = src_col and row_ = src_row",
    "tile_grayscale": _tile(_ONE, "", f"px, py, {_GRAY} as r, {_GRAY} as g, {_GRAY} as b, case when v is null then 0 else 255 end as a from n"),
    "tile_stops": _tile(_ONE, _SCALED, f"px, py, {_RAMPS} from q"),
    "tile_batch": _tile(_BATCH, _SCALED, f"cast(z as int) as z, cast(x as bigint) as x, cast(y as bigint) as y, px, py, {_RAMPS} from q"),
    "tile_gradient": _tile(_ONE, ", q as (select *, cast(t as double) as d from n)", f"px, py, {', '.join(f'case when v is null then 0 else {c} end as {n}' for c, n in zip(_palette('viridis'), 'rgb', strict=True))}, case when v is null then 0 else 255 end as a from q"),
    "constant_raster": f"select row_, col, 0 as gray_r, 0 as gray_g, 0 as gray_b, 255 as gray_a, 0 as stops_r, 0 as stops_g, 0 as stops_b, 0 as stops_a, {', '.join(f'{c} as palette_{n}' for c, n in zip(_palette('viridis'), 'rgb', strict=True))}, 255 as palette_a from (select *, 0e0 as d from ({fx.RASTER}) r) r",
    "file_filter": f"with {_KEPT} select ord, path, layer, style from kept",
    "path_parts": f"select ord, {_STEM} as stem, {_EXT} as extension, case when not at_root then list_extract(string_split(path, '/'), -2) end as style from ({fx.FILES}) f",
    "cache_hits": f"with {_KEPT}, {_OLD} select kept.ord, layer, size_bytes, last_modified, old.ord as cached_ord from kept join old using (layer, size_bytes, last_modified)",
    "cache_misses": f"with {_KEPT}, {_OLD} select ord, layer, size_bytes, last_modified from kept anti join old using (layer, size_bytes, last_modified)",
    "catalog_union": f"with {_KEPT}, {_OLD} select kept.ord, kept.layer, old.ord is not null as from_cache from kept left join old using (layer, size_bytes, last_modified)",
    "cache_dedupe": f"with {_OLD} select * from old",
    "cache_flatten": _RECORDS,
    "cache_roundtrip": _RECORDS,
    "layer_index": f"with {_KEPT} select layer, cast(count(*) as int) as n, string_agg(path || '|' || style, ';' order by path, style) as styles from kept group by layer",
    "first_layer_per_name": f"with {_KEPT} select layer, path, style, ord from kept qualify row_number() over (partition by layer order by path, ord) = 1",
    "style_summary": _SUMMARY,
    "style_warnings": f"select style, concat_ws(',', case when uncovered then 'uncovered_range' end, case when some_not_cog then 'not_cog' end) as warnings from ({_SUMMARY}) s where uncovered or some_not_cog",
    "load_progress": f"with {_KEPT} select ord, cast(sum(size_bytes) over w as bigint) as loaded_bytes, row_number() over w as position, 100e0 * row_number() over w / count(*) over () as percent, count(*) over () as total_files, cast(sum(size_bytes) over () as bigint) as total_bytes from kept window w as (order by ord)",
    "list_layers": f"with {_KEPT} select layer, style, path from kept",
    "layers_response": f"with {_KEPT} select layer, style, cast(ord as double) as minx, true as has_4326 from kept",
    "first_layer": f"with {_KEPT} select layer, style, path from kept order by layer, style, path limit 1",
    "style_parse": f"select file, cast(ix as int) as ix, cast(value as float) as value, red, green, blue, alpha from (values {', '.join(map(str, _PARSED))}) as t(file, ix, value, red, green, blue, alpha)",
    "style_join": f"select ord, style, case when style = 'default' then {len(fx.STOPS)} else 0 end as n_stops from ({fx.LAYERS_FLAT}) f",
    "stop_intervals": "select style, ix, value, next_value from (select 'default' as style, cast(ix as int) as ix, cast(value as float) as value, lead(cast(value as float)) over (order by ix) as next_value from (values {}) as t(ix, value)) w where next_value is not null".format(", ".join(f"({i}, {s[0]})" for i, s in enumerate(fx.STOPS))),
    "colour_bar": "select 'grayscale' as style, cast(i as int) as ix, v as r, v as g, v as b from (select i, cast(floor(255e0 * i / 9e0 + 0.5e0) as int) as v from range(10) as t(i)) g union all select 'default', ix, r, g, b from (values {}) as t(ix, r, g, b)".format(", ".join(str((i, *s[1:4])) for i, s in enumerate(fx.STOPS)))
    + " union all " + " union all ".join(f"select '{n}', cast(ix as int), {', '.join(_palette(n))} from (select i as ix, i / 9e0 as d from range(10) as t(i)) s" for n in palettes.NAMES),
    "palette_samples": " union all ".join(map(_samples, palettes.NAMES)),
    "format_mib": f"select ord, size_bytes / 1024e0 / 1024e0 as mib from ({fx.FILES}) f",
}
ORACLES["tile_stops_column"] = ORACLES["tile_stops"]
ORACLES["tile_png_pixels"] = ORACLES["tile_batch"]
