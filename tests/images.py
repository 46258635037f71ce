"""PNG files for tests, written with zlib alone."""

import struct
import zlib

import numpy as np


def png(path, rgb):
    """Writes an H x W x 3 (RGB) or H x W array of bytes."""
    rgb = np.asarray(rgb, np.uint8)
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if rgb.ndim == 3 else 0, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
