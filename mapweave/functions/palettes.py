"""The nine built-in palettes as colour functions of t in [0, 1].

Alpha is 255. Channels are computed as doubles, cut off at 0 and 255 and rounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control colours of published colour maps, a cubic B-spline apart.
CONTROLS = {
    "viridis": "440154 482777 3f4a8a 31678e 26838f 1f9d8a 6cce5a b6de2b fee825",
    "magma": "000004 140e37 3b0f70 641a80 8c2981 b63679 de4968 f66f5c fe9f6d fece91 fcfdbf",
    "plasma": "0d0887 42039d 6a00a8 900da3 b12a90 cb4678 e16462 f1834b fca636 fccd25 f0f921",
    "inferno": "000004 170b3a 420a68 6b176e 932667 bb3654 dd513a f3771a fca50a f6d644 fcffa4",
    "spectral": "9e0142 d53e4f f46d43 fdae61 fee08b ffffbf e6f598 abdda4 66c2a5 3288bd 5e4fa2",
}
#: The published polynomials of the Turbo colour map, lowest power first.
TURBO = ((34.61, 1172.33, -10793.56, 33300.12, -38394.49, 14825.05), (23.31, 557.33, 1225.33, -3574.96, 1073.77, 707.56), (27.2, 3211.1, -15327.97, 27814.0, -22569.18, 6838.66))
NAMES = ("viridis", "magma", "plasma", "inferno", "turbo", "cubehelix_default", "rainbow", "spectral", "sinebow")


class _Columns:
    """The functions that palettes need, on columns; the tests and SQL tables use `math` through _Floats."""

    sin, cos = staticmethod(F.sin), staticmethod(F.cos)
    abs = staticmethod(F.abs)

    @staticmethod
    def number(x: float) -> Column:
        return F.lit(float(x))

    @staticmethod
    def pick(values: list[float], i: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), i)

    @staticmethod
    def floor(x: Column) -> Column:
        return F.floor(x).cast("int")

    least, greatest = staticmethod(F.least), staticmethod(F.greatest)


class _Floats:
    sin, cos, abs = math.sin, math.cos, abs
    number, floor, least, greatest = float, math.floor, min, max

    @staticmethod
    def pick(values: list[float], i: int) -> float:
        return values[i]


def _spline(m, values: list[float], t):
    """Uniform cubic B-spline whose ends are mirrored."""
    n = len(values) - 1
    padded = [2 * values[0] - values[1], *values, 2 * values[-1] - values[-2]]
    i = m.least(m.floor(t * m.number(n)), n - 1 if m is _Floats else F.lit(n - 1))
    u = t * m.number(n) - i
    v = [m.pick(padded, i + k) for k in range(4)]
    u2, u3 = u * u, u * u * u
    return ((1 - 3 * u + 3 * u2 - u3) * v[0] + (4 - 6 * u2 + 3 * u3) * v[1] + (1 + 3 * u + 3 * u2 - 3 * u3) * v[2] + u3 * v[3]) / 6


def _cubehelix(m, hue, saturation, light):
    angle = (hue + 120) * (math.pi / 180)
    amp = saturation * light * (1 - light)
    c, s = m.cos(angle), m.sin(angle)
    return [255 * (light + amp * (a * c + b * s)) for a, b in ((-0.14861, 1.78277), (-0.29227, -0.90649), (1.97294, 0.0))]


def _channels(m, name: str, t) -> list:
    if name in CONTROLS:
        colours = [bytes.fromhex(h) for h in CONTROLS[name].split()]
        return [_spline(m, [float(c[k]) for c in colours], t) for k in range(3)]
    if name == "turbo":
        return [p[0] + t * (p[1] + t * (p[2] + t * (p[3] + t * (p[4] + t * p[5])))) for p in TURBO]
    if name == "sinebow":
        x = (0.5 - t) * math.pi
        return [255 * m.sin(x + k * math.pi / 3) * m.sin(x + k * math.pi / 3) for k in range(3)]
    if name == "rainbow":
        d = m.abs(t - 0.5)
        return _cubehelix(m, 360 * t - 100, 1.5 - 1.5 * d, 0.8 - 0.9 * d)
    if name == "cubehelix_default":
        return _cubehelix(m, 300 - 540 * t, m.number(0.5), t)
    raise KeyError(name)


def gradient(name: str, t: Column) -> list[Column]:
    """Red, green, blue and alpha of a palette at t."""
    return [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + F.lit(0.5)).cast("int") for c in _channels(_Columns, name, t)] + [F.lit(255)]


def colour_at(name: str, t: float) -> tuple[int, int, int, int]:
    """gradient() of a number."""
    return (*(math.floor(max(0.0, min(255.0, c)) + 0.5) for c in _channels(_Floats, name, t)), 255)


def is_palette(style: Column) -> Column:
    return style.isin(*NAMES)


