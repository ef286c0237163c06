"""From a pixel's value to red, green, blue and alpha, in 32-bit floats.

A masked pixel is null and gets (0, 0, 0, 0). Whole numbers come by truncation,
so that an opaque ramp of colour stops often has alpha 254.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions.f32 import div32, f32
from mapweave.functions.palettes import NAMES, gradient

CHANNELS = ("r", "g", "b", "a")
STOP_FIELDS = ("red", "green", "blue", "alpha")
Stop = tuple[float, int, int, int, int]


def normalise(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low) cut off at 0 and 1; null where both are equal."""
    place = div32(v - low, high - low)
    return F.when(place.isNotNull(), F.greatest(f32(0), F.least(f32(1), place)))  # both pass over nulls


def grayscale(v: Column, low: Column, high: Column, norm: Column | None = None) -> list[Column]:
    """A constant raster is black. `norm` is normalise() where a column holds it already, here and below."""
    lum = F.floor(F.coalesce(normalise(v, low, high) if norm is None else norm, f32(0)) * f32(255)).cast("int")
    return [F.when(v.isNull(), 0).otherwise(lum)] * 3 + [F.when(v.isNull(), 0).otherwise(255)]


def _between(scaled: Column, a: Column, b: Column, low: Column, high: Column) -> Column:
    """One channel between two stops; 0 where the stops' values are equal."""
    t = div32(scaled - low, high - low)
    return F.coalesce(F.floor((f32(1) - t) * a + t * b).cast("int"), F.lit(0))


def rescale(norm: Column, first: Column, last: Column) -> Column:
    """The data's range is stretched onto the stops' range."""
    return first + norm * (last - first)


def stops_literal(v: Column, low: Column, high: Column, stops: Sequence[Stop], norm: Column | None = None) -> list[Column]:
    """Colour stops known to the driver, in file order, as one CASE chain: the first interval that holds the value wins."""
    scaled = rescale(normalise(v, low, high) if norm is None else norm, f32(stops[0][0]), f32(stops[-1][0]))
    out = []
    for k in range(1, 5):
        case = F.when(v.isNull(), 0)
        for a, b in zip(stops, stops[1:], strict=False):
            case = case.when((scaled >= f32(a[0])) & (scaled <= f32(b[0])), _between(scaled, f32(a[k]), f32(b[k]), f32(a[0]), f32(b[0])))
        out.append(case.otherwise(0))
    return out


def stop_pairs(stops: Column) -> Column:
    """Neighbouring stops (a, b) in file order. A column of a layer: pixels need not make it again."""
    return F.zip_with(F.slice(stops, 1, F.greatest(F.size(stops) - 1, F.lit(0))), F.slice(stops, 2, F.size(stops)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def stop_interval(norm: Column, pairs: Column) -> Column:
    """The first of stop_pairs() that holds the rescaled value; null if there is none."""
    scaled = rescale(norm, F.get(pairs, F.lit(0))["a"]["value"], F.get(pairs, F.size(pairs) - 1)["b"]["value"])
    return F.when(F.size(pairs) > 0, F.get(F.filter(pairs, lambda p: (scaled >= p["a"]["value"]) & (scaled <= p["b"]["value"])), F.lit(0)))


def stops_column(v: Column, low: Column, high: Column, stops: Column, norm: Column | None = None, pairs: Column | None = None, hit: Column | None = None) -> list[Column]:
    """Colour stops in an array column, for styles that only the data know. `pairs` and `hit` are stop_pairs() and stop_interval() where columns hold them."""
    norm = normalise(v, low, high) if norm is None else norm
    pairs = stop_pairs(stops) if pairs is None else pairs
    hit = stop_interval(norm, pairs) if hit is None else hit
    scaled = rescale(norm, F.get(pairs, F.lit(0))["a"]["value"], F.get(pairs, F.size(pairs) - 1)["b"]["value"])
    return [F.when(v.isNull() | hit.isNull(), 0).otherwise(_between(scaled, f32(hit["a"][c]), f32(hit["b"][c]), hit["a"]["value"], hit["b"]["value"])) for c in STOP_FIELDS]


def palette(name: str, v: Column, low: Column, high: Column, norm: Column | None = None) -> list[Column]:
    """A constant raster gets the palette's first colour."""
    t = F.coalesce(normalise(v, low, high) if norm is None else norm, f32(0)).cast("double")
    return [F.when(v.isNull(), 0).otherwise(c) for c in gradient(name, t)]


def colourise(style: Column, v: Column, low: Column, high: Column, stops: Column, palettes: Sequence[str] = NAMES, norm: Column | None = None, pairs: Column | None = None, hit: Column | None = None) -> list[Column]:
    """By a built-in palette of the style's name, else gray without stops, else by the stops."""
    by_name = [(n, palette(n, v, low, high, norm)) for n in palettes]
    gray, ramp = grayscale(v, low, high, norm), stops_column(v, low, high, stops, norm, pairs, hit)
    out = []
    for k in range(4):
        case = F.when(F.size(stops) <= 0, gray[k]).otherwise(ramp[k])
        for name, channels in by_name:
            case = F.when(style == name, channels[k]).otherwise(case)
        out.append(case)
    return out


def colour_bar_palette(name: str, n: int = 10) -> Column:
    """n colours (r, g, b) of a palette from its first to its last."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(*(c.alias(k) for c, k in zip(gradient(name, i.cast("double") / F.lit(float(n - 1)))[:3], CHANNELS, strict=False))))


def colour_bar_gray(n: int = 10) -> Column:
    """n gray levels from black to white."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(f32(255) * i.cast("float") / f32(n - 1) + F.lit(0.5)).cast("int"))
