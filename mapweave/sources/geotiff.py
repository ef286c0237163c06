"""GeoTIFF files with NumPy only: a reader of the baseline forms, a small writer, and a Spark data source.

Read: little- and big-endian classic TIFF; strips and tiles; no compression,
deflate, LZW and PackBits; predictors 1, 2 and 3; 8-, 16- and 32-bit integers
and 32- and 64-bit floats; one band of the first image. A file is read in
ranges: the header, and the strips or tiles that the wanted pixels lie in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

from mapweave.sources.files import Ranges

#: Sizes and struct letters of TIFF field types.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Numbers of the tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, FORMAT = 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEOKEYS, NODATA = 33550, 33922, 34735, 42113
#: Geo keys of the model, and of geographic and projected system codes.
_GEOGRAPHIC, _PROJECTED = 2048, 3072


def _fields(data: bytes | Ranges) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    out, (n,) = {}, struct.unpack(order + "H", data[at : at + 2])
    for k in range(n):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        form = order + (f"{count}s" if kind == 2 else _TYPES[kind] * count)
        size, held = struct.calcsize(form), entry[8:]
        if size > 4:
            (place,) = struct.unpack(order + "I", held)
            held = data[place : place + size]
        out[tag] = struct.unpack(form, held[:size])
    return order, out


def _lzw(data: bytes) -> bytes:
    clear, end = 256, 257
    table: list[bytes] = []
    out, bits, held, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & (1 << bits) - 1
            if code == end:
                return bytes(out)
            if code == clear:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if not table:
                raise ValueError("LZW data without a start")
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def _unpack(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return _lzw(data)
    if compression == 32773:
        return _packbits(data)
    raise ValueError(f"compression {compression} isn't read")


class GeoTiff:
    """Header and one band of a file, given as bytes or Ranges. ValueError says what is wrong."""

    def __init__(self, data: bytes | Ranges, band: int = 1):
        try:
            self.order, self.tags = _fields(data)
        except struct.error as e:
            raise ValueError("truncated") from e
        self.data = data
        one = lambda tag, default=None: self.tags.get(tag, (default,))[0]
        self.width, self.height = one(WIDTH), one(HEIGHT)
        if not self.width or not self.height:
            raise ValueError("no image size")
        letter = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
        self.kind = np.dtype(f"{self.order}{letter}{one(BITS, 1) // 8}")
        self.compression, self.predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if not 1 <= band <= one(SAMPLES, 1):
            raise ValueError(f"no band {band}")
        mixed = one(PLANAR, 1) == 1
        self.samples, self.sample, self.plane = (one(SAMPLES, 1), band - 1, 0) if mixed else (1, 0, band - 1)
        self.tiled = TILE_WIDTH in self.tags
        if SCALE not in self.tags or TIEPOINT not in self.tags:
            raise ValueError("no geotransform")
        (sx, sy), t = self.tags[SCALE][:2], self.tags[TIEPOINT]
        self.px_w, self.px_h = sx, -sy
        self.origin_x, self.origin_y = t[3] - t[0] * sx, t[4] + t[1] * sy
        keys = self.tags.get(GEOKEYS, ())
        codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        if not codes:
            raise ValueError("no coordinate system")
        code = codes.get(_PROJECTED) or codes.get(_GEOGRAPHIC) or 0
        self.crs_code = 0 if code == 32767 else code
        text = b"".join(self.tags.get(NODATA, ())).rstrip(b"\0 ")
        self.nodata = float(text) if text else None
        #: A cloud-optimised file says so in text right after the first eight bytes.
        self.is_cog = b"LAYOUT=IFDS_BEFORE_DATA" in data[8:512]
        if self.tiled:
            self.block_w, self.block_h = one(TILE_WIDTH), one(TILE_HEIGHT)
            self.places = self.tags[TILE_AT], self.tags[TILE_SIZE]
        else:
            self.block_w, self.block_h = self.width, min(one(ROWS, self.height), self.height)
            self.places = self.tags[STRIP_AT], self.tags[STRIP_SIZE]

    def _cut(self, raw: bytes, rows: int, columns: int) -> np.ndarray:
        shape = (rows, columns, self.samples)
        if self.predictor == 3:
            size = self.kind.itemsize
            planes = np.cumsum(np.frombuffer(raw, np.uint8)[: rows * columns * self.samples * size].reshape(rows, -1, self.samples), axis=1, dtype=np.uint8)
            planes = planes.reshape(rows, size, columns * self.samples).transpose(0, 2, 1)
            return np.ascontiguousarray(planes).view(self.kind.newbyteorder(">")).reshape(shape)[:, :, self.sample]
        image = np.frombuffer(raw, self.kind)[: rows * columns * self.samples].reshape(shape)
        if self.predictor == 2:
            image = np.cumsum(image, axis=1, dtype=self.kind.newbyteorder("="))
        return image[:, :, self.sample]

    def block(self, row: int, column: int) -> np.ndarray:
        """The part of the band in a strip or tile, as 32-bit floats."""
        across, down = -(-self.width // self.block_w), -(-self.height // self.block_h)
        k = (self.plane * down + row) * across + column
        at, size = (p[k] for p in self.places)
        if at + size > len(self.data):
            raise ValueError("truncated")
        y, x = row * self.block_h, column * self.block_w
        rows = self.block_h if self.tiled else min(self.block_h, self.height - y)
        part = self._cut(_unpack(self.data[at : at + size], self.compression), rows, self.block_w)
        return part[: self.height - y, : self.width - x].astype(np.float32)

    def window(self, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
        """Rows r0 to r1 and columns c0 to c1, all included, of the band; they must lie inside it. No other block is read."""
        out = np.zeros((r1 - r0 + 1, c1 - c0 + 1), np.float32)
        for i in range(r0 // self.block_h, r1 // self.block_h + 1):
            for j in range(c0 // self.block_w, c1 // self.block_w + 1):
                y, x, part = i * self.block_h, j * self.block_w, self.block(i, j)
                top, left = max(r0, y), max(c0, x)
                cut = part[top - y : r1 + 1 - y, left - x : c1 + 1 - x]
                out[top - r0 : top - r0 + cut.shape[0], left - c0 : left - c0 + cut.shape[1]] = cut
        return out

    def band(self) -> np.ndarray:
        """(height, width) 32-bit floats of the whole band."""
        return self.window(0, self.height - 1, 0, self.width - 1)

    def stats(self) -> tuple[float, float]:
        """Smallest and largest present value; ValueError if there is none. One row of blocks is in memory at a time."""
        least, most = np.inf, -np.inf
        for y in range(0, self.height, self.block_h):
            band = self.window(y, min(self.height, y + self.block_h) - 1, 0, self.width - 1)
            ok = ~np.isnan(band)
            if self.nodata is not None:
                ok &= band != np.float32(self.nodata)
            if ok.any():
                least, most = min(least, float(band[ok].min())), max(most, float(band[ok].max()))
        if least > most:
            raise ValueError("no data in the band")
        return least, most


def write_geotiff(band: np.ndarray, origin: tuple[float, float], pixel: tuple[float, float], crs_code: int | None, nodata: float | None = None, compression: int = 1, predictor: int = 1, tile: int | None = None, order: str = "<", cog: bool = False) -> bytes:
    """A file of one band. `pixel` holds positive sizes; compression 1, 8 or 32773; predictor 1 or 2."""
    height, width = band.shape
    kind = band.dtype.newbyteorder(order)
    step_x, step_y = (tile, tile) if tile else (width, max(1, min(height, 64)))
    parts = []
    for y in range(0, height, step_y):
        for x in range(0, width, step_x):
            cut = band[y : y + step_y, x : x + step_x]
            if tile:
                cut = np.pad(cut, ((0, tile - cut.shape[0]), (0, tile - cut.shape[1])))
            if predictor == 2:
                cut = np.concatenate((cut[:, :1], np.diff(cut, axis=1)), axis=1)
            raw = cut.astype(kind).tobytes()
            if compression == 8:
                raw = zlib.compress(raw)
            elif compression == 32773:
                raw = b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))
            parts.append(raw)
    bits = kind.itemsize * 8
    tags = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [bits]), (COMPRESSION, "H", [compression]), (262, "H", [1]), (SAMPLES, "H", [1]), (PREDICTOR, "H", [predictor]), (FORMAT, "H", [{"u": 1, "i": 2, "f": 3}[kind.kind]])]
    tags += [(TILE_WIDTH, "I", [tile]), (TILE_HEIGHT, "I", [tile])] if tile else [(ROWS, "I", [step_y])]
    places = (TILE_AT, TILE_SIZE) if tile else (STRIP_AT, STRIP_SIZE)
    tags += [(places[0], "I", [0] * len(parts)), (places[1], "I", [len(p) for p in parts])]
    tags += [(SCALE, "d", [*pixel, 0.0]), (TIEPOINT, "d", [0.0, 0.0, 0.0, *origin, 0.0])]
    if crs_code is not None:
        geographic = crs_code == 4326
        tags.append((GEOKEYS, "H", [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, _GEOGRAPHIC if geographic else _PROJECTED, 0, 1, crs_code]))
    if nodata is not None:
        tags.append((NODATA, "s", [f"{nodata:g}".encode() + b"\0"]))
    tags.sort()
    ghost = b"LAYOUT=IFDS_BEFORE_DATA\n" if cog else b""
    start = 8 + len(ghost)
    extra_at, head, extra = start + 2 + 12 * len(tags) + 4, b"", b""
    numbers = {"H": 3, "I": 4, "d": 12, "s": 2}

    def packed(letter: str, values: list) -> bytes:
        return values[0] if letter == "s" else struct.pack(order + letter * len(values), *values)

    data_at = extra_at + sum(n + n % 2 for n in (len(packed(t, v)) for _, t, v in tags) if n > 4)
    for tag, letter, values in tags:
        if tag == places[0]:
            values = [data_at + sum(map(len, parts[:k])) for k in range(len(parts))]
        raw = packed(letter, values)
        head += struct.pack(order + "HHI", tag, numbers[letter], len(raw) if letter == "s" else len(values))
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack(order + "I", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + ghost + struct.pack(order + "H", len(tags)) + head + b"\0\0\0\0" + extra + b"".join(parts)


HEADER = "path string, width int, height int, origin_x double, origin_y double, px_w double, px_h double, crs_code int, nodata float, min_value float, max_value float, is_cog boolean, error string"


_WRONG = (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error)


def header_row(path: str, data: bytes | Ranges, stats: bool = True, band: int = 1) -> tuple:
    """A HEADER row; `error` says why a file can't be a layer, its other columns are then null. Without stats the band isn't read."""
    try:
        t = GeoTiff(data, band)
        return (path, t.width, t.height, t.origin_x, t.origin_y, t.px_w, t.px_h, t.crs_code, t.nodata, *(t.stats() if stats else (None, None)), t.is_cog, None)
    except _WRONG as e:
        return (path, *[None] * 11, f"{type(e).__name__}: {e}")


def read_headers(files, band: int = 1):
    """HEADER rows of the files of a frame (path, cached); of cached ones only the header is read, not the band."""
    import pandas as pd

    names = [c.split()[0] for c in HEADER.split(", ")]

    def one(path: str, cached: bool) -> tuple:
        try:
            with Ranges(path) as data:
                return header_row(path, data, not cached, band)
        except OSError as e:
            return (path, *[None] * 11, str(e))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(p, c) for p, c in zip(frame["path"], frame["cached"], strict=True)], columns=names)

    return files.select("path", "cached").mapInPandas(rows, HEADER)


#: Rows of a raster that one piece of work reads, about.
BAND_ROWS = 1024


def read_pixels(layers, near=None, band: int = 1):
    """Pixels (layer, row_, col, v) of the files of `layers` (path, layer, width, height).

    `near` (layer, r0, r1, c0, c1) names the rectangle wanted of each layer; without
    it, whole files. Rectangles are cut into bands of BAND_ROWS rows that are
    dealt out over the tasks, and a task reads the header of its file and the
    blocks that its band touches.
    """
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            with Ranges(row["path"]) as data:
                tiff, (r0, r1, c0, c1) = GeoTiff(data, band), (row[k] for k in ("r0", "r1", "c0", "c1"))
                for i in range(r0 // tiff.block_h, r1 // tiff.block_h + 1):
                    top = max(r0, i * tiff.block_h)
                    part = tiff.window(top, min(r1, (i + 1) * tiff.block_h - 1), c0, c1)
                    r, c = np.nonzero(~np.isnan(part))
                    yield pa.RecordBatch.from_arrays([pa.array([row["layer"]] * len(r), pa.string()), pa.array(r + top, pa.int32()), pa.array(c + c0, pa.int32()), pa.array(part[r, c])], names=["layer", "row_", "col", "v"])

    last = lambda c: F.col(c) - 1
    found = layers.select("path", "layer", "width", "height")
    if near is None:
        found = found.select("path", "layer", F.lit(0).alias("r0"), last("height").alias("r1"), F.lit(0).alias("c0"), last("width").alias("c1"))
    else:
        inside = {"r0": F.greatest("r0", F.lit(0)), "r1": F.least(F.col("r1"), last("height")), "c0": F.greatest("c0", F.lit(0)), "c1": F.least(F.col("c1"), last("width"))}
        found = found.join(near.where("r0 IS NOT NULL AND c0 IS NOT NULL"), "layer").select("path", "layer", *(c.alias(k) for k, c in inside.items())).where("r0 <= r1 AND c0 <= c1")
    step = lambda c: F.floor(F.col(c) / BAND_ROWS).cast("int")
    bands = found.select("*", F.explode(F.sequence(step("r0"), step("r1"))).alias("k"))
    bands = bands.select("path", "layer", F.greatest(F.col("r0"), F.col("k") * BAND_ROWS).alias("r0"), F.least(F.col("r1"), (F.col("k") + 1) * BAND_ROWS - 1).alias("r1"), "c0", "c1")
    parts = int(layers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bands.repartition(parts, "path", "r0").mapInArrow(rows, "layer string, row_ int, col int, v float")
