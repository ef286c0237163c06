"""8-bit RGBA PNG files with the standard library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_rgba(image: np.ndarray, level: int = 6) -> bytes:
    """A (height, width, 4) array of bytes as a PNG without row filters."""
    height, width = image.shape[:2]
    rows = np.zeros((height, 1 + 4 * width), np.uint8)
    rows[:, 1:] = np.ascontiguousarray(image, np.uint8).reshape(height, -1)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_rgba(data: bytes) -> np.ndarray:
    """The array of a PNG of encode_rgba()."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, packed, size = len(_SIGNATURE), b"", (0, 0)
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 6):
                raise ValueError("only 8-bit RGBA is read")
            size = (height, width)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[0], 1 + 4 * size[1])
    if rows[:, 0].any():
        raise ValueError("row filters are not read")
    return rows[:, 1:].reshape(*size, 4)
