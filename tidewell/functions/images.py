"""PNG images in binary columns: decoded, fitted into a square by nearest neighbour, encoded again.

Pixels are numpy arrays inside Arrow batches; nothing but ``zlib`` reads or writes the
format.  All colour types, bit depths and both interlacings are read; what is written is
8-bit RGB, or RGBA where some pixel is not opaque, without metadata.

Defined cases: null, other formats, broken data, wrong checksums, and images of more than
``MOST_PIXELS`` give null (the caller keeps the raw bytes); an image that fits is only
encoded anew.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Sides into which article images and icons are fitted; fixed values.
IMAGE_SIDE, ICON_SIDE = 1200, 64
#: Pixels beyond which an image is not decoded.
MOST_PIXELS = 50_000_000
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Interlaced passes: first column and row, steps between them.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


class NotReadable(ValueError):
    """Not a whole PNG image."""


def _chunks(data: bytes) -> dict[bytes, bytes]:
    """Contents by chunk type, image data joined."""
    if not data.startswith(SIGNATURE):
        raise NotReadable("no PNG")
    out: dict[bytes, bytes] = {}
    at, parts = len(SIGNATURE), []
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(body) < n or len(crc) < 4 or zlib.crc32(kind + body) != int.from_bytes(crc, "big"):
            raise NotReadable("a broken chunk")
        if kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            return {**out, b"IDAT": b"".join(parts)}
        else:
            out.setdefault(kind, body)
        at += 12 + n
    raise NotReadable("no end")


def _unfiltered(raw: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes without their filters; ``step`` bytes lie between neighbours."""
    lines = np.frombuffer(raw, np.uint8, rows * (width + 1)).reshape(rows, width + 1)
    out = np.zeros((rows, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(rows):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            done = line
        elif kind == 1:
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            done = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            done = line + above
        elif kind in (3, 4):
            done = np.frombuffer(_by_neighbours(kind, line.tobytes(), above.tobytes(), step), np.uint8)
        else:
            raise NotReadable("an unknown filter")
        out[y] = above = done
    return out


def _by_neighbours(kind: int, line: bytes, above: bytes, step: int) -> bytearray:
    """Average and Paeth, whose bytes depend on the one before."""
    done = bytearray(line)
    for k, x in enumerate(line):
        left, up = done[k - step] if k >= step else 0, above[k]
        if kind == 3:
            guess = (left + up) >> 1
        else:
            corner = above[k - step] if k >= step else 0
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        done[k] = (x + guess) & 255
    return done


def _samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """(rows, width, channels) of whole samples, at their own depth."""
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return lines.reshape(len(lines), width, channels).astype(np.uint16)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, 1, depth)
    return bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint16)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) of RGBA bytes."""
    chunks = _chunks(data)
    if len(chunks.get(b"IHDR", b"")) != 13:
        raise NotReadable("no header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if depth not in _DEPTHS.get(colour, ()) or not width or not height or width * height > MOST_PIXELS or interlaced > 1:
        raise NotReadable("an unknown kind, or too large")
    channels = _CHANNELS[colour]
    passes = [p for p in (_PASSES if interlaced else [(0, 0, 1, 1)]) if p[0] < width and p[1] < height]
    shapes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for x, y, dx, dy in passes]
    sizes = [rows * (1 + -(-columns * channels * depth // 8)) for rows, columns in shapes]
    try:
        raw = zlib.decompressobj().decompress(chunks[b"IDAT"], sum(sizes))
    except zlib.error as e:
        raise NotReadable("broken image data") from e
    if len(raw) < sum(sizes):
        raise NotReadable("too little image data")
    pixels, at = np.zeros((height, width, channels), np.uint16), 0
    for (x, y, dx, dy), (rows, columns), size in zip(passes, shapes, sizes, strict=True):
        lines = _unfiltered(raw[at : at + size], rows, size // rows - 1, max(1, channels * depth // 8))
        pixels[y::dy, x::dx] = _samples(lines, columns, channels, depth)
        at += size
    return _rgba(pixels, colour, depth, chunks.get(b"PLTE"), chunks.get(b"tRNS"))


def _rgba(pixels: np.ndarray, colour: int, depth: int, palette: bytes | None, clear: bytes | None) -> np.ndarray:
    out = np.full((*pixels.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        if not palette or len(palette) % 3 or pixels.max(initial=0) >= len(palette) // 3:
            raise NotReadable("no palette, or a colour beyond it")
        table = np.full((len(palette) // 3, 4), 255, np.uint8)
        table[:, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        alpha = np.frombuffer((clear or b"")[: len(table)], np.uint8)
        table[: len(alpha), 3] = alpha
        return table[pixels[:, :, 0]]
    scaled = (pixels >> 8 if depth == 16 else pixels * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out[:, :, :3] = scaled[:, :, : 3 if colour in (2, 6) else 1]
    if colour in (4, 6):
        out[:, :, 3] = scaled[:, :, -1]
    elif clear:
        key = np.frombuffer(clear, ">u2")
        if len(key) == pixels.shape[2]:
            out[:, :, 3] = np.where((pixels == key).all(axis=2), 0, 255)
    return out


def encode(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width, 3 or 4) bytes; an alpha channel stays only if it is used."""
    if pixels.shape[2] == 4 and (pixels[:, :, 3] == 255).all():
        pixels = pixels[:, :, :3]
    height, width, channels = pixels.shape
    lines = np.ascontiguousarray(pixels, np.uint8).reshape(height, width * channels)
    filtered = np.empty((height, width * channels + 1), np.uint8)
    filtered[:, 0] = 2  # differences to the row above
    filtered[:, 1:] = lines
    filtered[1:, 1:] -= lines[:-1]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + chunk(b"IEND", b"")


def fitted_size(width: int, height: int, side: int) -> tuple[int, int]:
    """The size within a square, aspect kept in whole pixels, at least one."""
    if width <= side and height <= side:
        return width, height
    if width > height:
        return side, max(1, height * side // width)
    return max(1, width * side // height), side


def resampled(pixels: np.ndarray, side: int) -> np.ndarray:
    """Nearest neighbours in the size that fits."""
    height, width = pixels.shape[:2]
    w, h = fitted_size(width, height, side)
    return pixels if (w, h) == (width, height) else pixels[np.arange(h) * height // h][:, np.arange(w) * width // w]


def fit(data: bytes | None, side: int) -> tuple[bytes, int, int] | None:
    """(PNG, width, height) of an image that can be read, else None."""
    try:
        pixels = resampled(decode(bytes(data)), side) if data is not None else None
    except NotReadable:
        return None
    return None if pixels is None else (encode(pixels), pixels.shape[1], pixels.shape[0])


def fitted_png(data: Column, side: int = IMAGE_SIDE) -> Column:
    """Struct (data, width, height) of a column of PNG images fitted into a square; null where one cannot be read."""

    @pandas_udf("data binary, width int, height int, ok boolean")
    def run(images: pd.Series) -> pd.DataFrame:
        done = [fit(x, side) for x in images]
        columns = list(zip(*[(*d, True) if d else (None, None, None, False) for d in done], strict=True)) or [()] * 4
        frame = pd.DataFrame({"data": pd.Series(columns[0], dtype=object)})
        for name, values in zip(("width", "height"), columns[1:3], strict=True):
            frame[name] = pd.array(values, "Int32")
        return frame.assign(ok=list(columns[3]))

    made = run(data)
    return F.when(made["ok"], F.struct(made["data"].alias("data"), made["width"].alias("width"), made["height"].alias("height")))


def icon_png(data: Column) -> Column:
    """A feed's icon as PNG within 64 pixels."""
    return fitted_png(data, ICON_SIDE)


def drawn(seed: Column, width: Column, height: Column) -> Column:
    """A PNG of the given size whose red is ``(seed * 31 + 7 x + 13 y) % 256``: images for tables that have none."""

    @pandas_udf("binary")
    def run(seeds: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
        def one(s: int, w: int, h: int) -> bytes:
            pixels = np.zeros((h, w, 3), np.uint8)
            pixels[:, :, 0] = (s * 31 + 7 * np.arange(w) + 13 * np.arange(h)[:, None]) % 256
            return encode(pixels)

        return pd.Series([one(*map(int, v)) for v in zip(seeds, widths, heights, strict=True)], dtype=object)

    return run(seed, width, height)


def red_sum(data: Column) -> Column:
    """The sum of an image's red samples; null where it cannot be read."""

    @pandas_udf("long")
    def run(images: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> int | None:
            try:
                return None if x is None else int(decode(bytes(x))[:, :, 0].sum())
            except NotReadable:
                return None

        return pd.Series([one(x) for x in images], dtype="Int64")

    return run(data)
