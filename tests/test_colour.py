import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.functions import colour, mercator, palettes, utm
from mapweave.plans.fixtures import STOPS
from mapweave.schema import STOP


def channels(spark, values, make, low=0.0, high=400.0):
    rows = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v float")
    made = make(F.col("v"), F.lit(low).cast("float"), F.lit(high).cast("float"))
    return [tuple(r)[1:] for r in rows.select("i", *(c.alias(n) for c, n in zip(made, "rgba", strict=True))).orderBy("i").collect()]


def numpy_stops(v, low, high, stops):
    f = np.float32
    if v is None:
        return (0, 0, 0, 0)
    with np.errstate(all="ignore"):
        norm = min(max((f(v) - f(low)) / (f(high) - f(low)), f(0)), f(1)) if high != low else f("nan")
    scaled = f(stops[0][0]) + norm * (f(stops[-1][0]) - f(stops[0][0]))
    for a, b in zip(stops, stops[1:], strict=False):
        if f(a[0]) <= scaled <= f(b[0]):
            with np.errstate(all="ignore"):
                t = (scaled - f(a[0])) / (f(b[0]) - f(a[0]))
            out = [(f(1) - t) * f(a[k]) + t * f(b[k]) for k in range(1, 5)]
            return tuple(0 if math.isnan(x) else int(x) for x in out)
    return (0, 0, 0, 0)


@pytest.mark.parametrize("stops", [STOPS, STOPS[::-1], STOPS[:1], (STOPS[0], STOPS[1], STOPS[1], STOPS[2])], ids=["ramp", "unsorted", "single", "repeated"])
def test_stops_in_both_forms_equal_32_bit_arithmetic(spark, stops):
    rng = random.Random(5)
    values = [None, -3.0, 0.0, 100.0, 200.0, 300.0, 400.0, 999.0, *(rng.uniform(0, 400) for _ in range(300))]
    want = [numpy_stops(v, 0.0, 400.0, stops) for v in values]
    column = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(s, ("value", *colour.STOP_FIELDS), strict=True))) for s in stops)).cast(f"array<{STOP}>")
    assert channels(spark, values, lambda *v: colour.stops_column(*v, column)) == want
    assert channels(spark, values, lambda *v: colour.stops_literal(*v, stops)) == want


def test_opaque_ramps_often_have_alpha_254(spark):
    got = channels(spark, range(0, 400), lambda *v: colour.stops_literal(*v, STOPS))
    assert {g[3] for g in got} == {254, 255}


def test_grayscale_truncates_and_masks(spark):
    assert channels(spark, [None, 0, 100, 399.9, 400], colour.grayscale) == [(0, 0, 0, 0), (0, 0, 0, 255), (63, 63, 63, 255), (254, 254, 254, 255), (255, 255, 255, 255)]


def test_constant_rasters(spark):
    assert channels(spark, [5.0], colour.grayscale, 5.0, 5.0) == [(0, 0, 0, 255)]
    assert channels(spark, [5.0], lambda *v: colour.stops_literal(*v, STOPS), 5.0, 5.0) == [(0, 0, 0, 0)]
    assert channels(spark, [5.0], lambda *v: colour.palette("magma", *v), 5.0, 5.0) == [palettes.colour_at("magma", 0.0)]


#: Published colours of the maps at 0, 1/4, 1/2, 3/4 and 1.
PUBLISHED = {
    "viridis": "440154 3b528b 21918c 5ec962 fde725",
    "magma": "000004 51127c b73779 fc8961 fcfdbf",
    "plasma": "0d0887 7e03a8 cc4778 f89540 f0f921",
    "inferno": "000004 57106e bc3754 f98e09 fcffa4",
    "spectral": "9e0142 f98e52 fffebe 86cfa5 5e4fa2",
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_palettes_are_near_the_published_maps(name):
    for k, h in enumerate(PUBLISHED[name].split()):
        got = palettes.colour_at(name, k / 4)[:3]
        assert max(abs(a - b) for a, b in zip(got, bytes.fromhex(h), strict=True)) <= 16, (k, got, h)


def test_palettes_by_formula():
    for t in (0.0, 0.3, 0.5, 1.0):
        got = palettes.colour_at("sinebow", t)[:3]
        assert got == tuple(int(255 * math.sin(math.pi * (0.5 - t) + k * math.pi / 3) ** 2 + 0.5) for k in range(3))
    # Turbo begins dark blue-violet, is green in the middle and ends dark red.
    first, middle, last = (palettes.colour_at("turbo", t) for t in (0.0, 0.5, 1.0))
    assert max(first) == 255 and first[0] < 50 and middle[1] > 230 and last[0] > 120 and last[1] < 20 and last[2] < 20


def test_palette_ends():
    assert palettes.colour_at("viridis", 0.0) == (0x44, 0x01, 0x54, 255)
    assert palettes.colour_at("spectral", 1.0) == (0x5E, 0x4F, 0xA2, 255)
    assert palettes.colour_at("cubehelix_default", 0.0)[:3] == (0, 0, 0)
    assert palettes.colour_at("cubehelix_default", 1.0)[:3] == (255, 255, 255)
    with pytest.raises(KeyError):
        palettes.colour_at("Viridis", 0.5)


def test_mercator_round_trip_and_clamp(spark):
    rng = random.Random(42)
    points = [(rng.uniform(-180, 180), rng.uniform(-85, 85)) for _ in range(1000)]
    rows = spark.createDataFrame(points, "lon double, lat double")
    x, y = mercator.lon_lat_to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = mercator.mercator_to_lon_lat(F.col("x"), F.col("y"))
    for r in rows.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-6 and abs(r["lat"] - r["lat2"]) < 1e-6
    ends = spark.createDataFrame([(90.0, mercator.MAX_LAT), (-90.0, -mercator.MAX_LAT)], "a double, b double")
    both = ends.select(mercator.lon_lat_to_mercator(F.lit(10.0), F.col("a"))[1].alias("a"), mercator.lon_lat_to_mercator(F.lit(10.0), F.col("b"))[1].alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())


def test_utm_known_points_and_round_trip():
    # On the central meridian the easting is the false one, and northing at the equator is 0.
    crs, lon, lat = np.array([32633, 32733, 32633, 32601]), np.array([15.0, 15.0, 12.5, -178.0]), np.array([0.0, -30.0, 52.0, 10.0])
    e, n = utm.forward(crs, lon, lat)
    assert abs(e[0] - 500000) < 1e-6 and abs(n[0]) < 1e-6
    assert abs(n[1] - (10000000 - 0.9996 * 3320113.398)) < 0.01
    back = utm.inverse(crs, e, n)
    assert np.abs(back[0] - lon).max() < 1e-7 and np.abs(back[1] - lat).max() < 1e-7


def test_children_fill_their_parent(spark):
    rows = spark.createDataFrame([(3, 2, 5), (0, 0, 0), (10, 511, 700)], "z int, x bigint, y bigint")
    b = mercator.tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    c = mercator.tile_bounds(F.col("z") + 1, F.col("x") * 2 + 1, F.col("y") * 2 + 1)
    for r in rows.select(b["maxx"].alias("a"), c["maxx"].alias("b"), b["miny"].alias("c"), c["miny"].alias("d")).collect():
        assert math.isclose(r["a"], r["b"], abs_tol=1e-6) and math.isclose(r["c"], r["d"], abs_tol=1e-6)
