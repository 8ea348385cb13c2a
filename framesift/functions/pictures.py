"""Decoding of pictures in a column: PNG and BMP by numpy, other formats by Pillow where it is installed."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FRAME
from . import imaging

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by PNG's type of colour.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: x, y, step in x, step in y of the passes of an interlaced picture.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


class BadPicture(ValueError):
    def __init__(self, why: str):
        super().__init__(f"Could not load image: {why}")


def _unfiltered(lines: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Bytes of the rows, (height, bytes of a row), with PNG's filters undone."""
    h, n = lines.shape
    if kinds.max(initial=0) > 4:
        raise BadPicture("unknown filter")
    if not (kinds > 2).any():
        above = np.zeros(n, np.uint8)
        for y in range(h):
            if kinds[y] == 1:
                lines[y] = np.cumsum(lines[y].reshape(-1, bpp), axis=0, dtype=np.uint32).astype(np.uint8).ravel()
            elif kinds[y] == 2:
                lines[y] += above
            above = lines[y]
        return lines
    # a byte depends on those to the left and above, so all pixels of a diagonal are found at once
    w = n // bpp
    px = np.zeros((h + 1, w + 1, bpp), np.int16)
    raw, kind = lines.reshape(h, w, bpp), kinds[:, None]
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner, k = px[y + 1, x], px[y, x + 1], px[y, x], kind[y]
        p, q, r = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))
        px[y + 1, x + 1] = (raw[y, x] + np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) >> 1, nearest], 0)) & 255
    return px[1:, 1:].astype(np.uint8).reshape(h, n)


def _samples(rows: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """(height, width, samples) of the bytes; of 16 bits the upper ones, of less than 8 the plain numbers."""
    h = len(rows)
    if depth == 16:
        return rows.reshape(h, width, samples, 2)[..., 0]
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * samples]
    return rows.reshape(h, width, samples)


def decode_png(data: bytes) -> np.ndarray:
    at, body, palette, head = len(PNG), [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise BadPicture("cut off")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + size
    if not head or not body:
        raise BadPicture("no header or no pixels")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in SAMPLES or not width or not height:
        raise BadPicture("unknown type of colour, or no size")
    raw = zlib.decompress(b"".join(body))
    n, start = SAMPLES[colour], 0
    out = np.zeros((height, width, n), np.uint8)
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * n * depth // 8)
        part = np.frombuffer(raw, np.uint8, h * (line + 1), start).reshape(h, line + 1)
        start += h * (line + 1)
        rows = _unfiltered(part[:, 1:].copy(), part[:, 0], max(1, n * depth // 8))
        out[y0::dy, x0::dx] = _samples(rows, w, depth, n)
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise BadPicture("no such colour in its palette")
        return palette[out[..., 0]]
    if depth < 8:
        out = out * (255 // ((1 << depth) - 1))
    return imaging.to_rgb(out[..., : 1 if colour in (0, 4) else 3].astype(np.uint8))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed, of 8 bits with a palette, 24 or 32."""
    offset, size, width, height, _, depth, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or not height:
        raise BadPicture("a BMP of this kind isn't read")
    line = -(-width * depth // 32) * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), offset).reshape(abs(height), line)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        colours = np.frombuffer(data, np.uint8, (offset - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        return colours[rows][..., 2::-1].copy()
    return rows.reshape(abs(height), width, depth // 8)[..., 2::-1].copy()


def decode(data: bytes | None) -> np.ndarray:
    """RGB of an encoded picture; a BadPicture for what can't be decoded."""
    data = bytes(data or b"")
    try:
        if data.startswith(PNG):
            return decode_png(data)
        if data.startswith(b"BM"):
            return decode_bmp(data)
    except BadPicture:
        raise
    except Exception as e:  # any other fault lies in the bytes
        raise BadPicture(str(e)) from e
    try:
        from PIL import Image
    except ImportError:
        raise BadPicture("neither PNG nor BMP, and Pillow isn't installed") from None
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except Exception as e:
        raise BadPicture(str(e)) from e


DECODED = T.StructType([T.StructField("frame", FRAME), T.StructField("error", T.StringType())])


def decoded_rows(data: pd.Series) -> pd.DataFrame:
    frames, errors = [], []
    for x in data:
        try:
            a = decode(x)
            frames.append({"height": a.shape[0], "width": a.shape[1], "data": a.tobytes()})
            errors.append(None)
        except BadPicture as e:
            frames.append(None)
            errors.append(str(e))
    return pd.DataFrame({"frame": pd.Series(frames, dtype=object), "error": pd.Series(errors, dtype=object)})


def decoded(data: Column) -> Column:
    """struct(frame, error) of a column of encoded pictures; one of the two is null."""

    @F.pandas_udf(DECODED)
    def decoded_(d: pd.Series) -> pd.DataFrame:
        return decoded_rows(d)

    return decoded_(data)
