"""PNG images of every kind, written by a plain encoder, and their fitting."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import images

KINDS = [(c, d) for c, depths in images._DEPTHS.items() for d in depths]


def packed(row, depth):
    """Samples of a row, most significant bit first."""
    bits = "".join(f"{int(v):0{depth}b}" for v in row)
    bits += "0" * (-len(bits) % 8)
    return [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]


def filtered(rows, kind, step):
    """Rows of bytes with a filter by its definition."""
    out, above = b"", [0] * len(rows[0]) if rows else []
    for y, row in enumerate(rows):
        f = kind if kind < 5 else y % 5
        line = []
        for k, x in enumerate(row):
            a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
            line.append((x - (0, a, b, (a + b) // 2, paeth)[f]) % 256)
        out, above = out + bytes([f, *line]), row
    return out


def png(samples, colour, depth, kind=0, interlaced=False, extra=()):
    """``samples``: (height, width, channels)."""
    height, width, channels = samples.shape
    step, raw = max(1, channels * depth // 8), b""
    for x, y, dx, dy in images._PASSES if interlaced else [(0, 0, 1, 1)]:
        part = samples[y::dy, x::dx]
        if part.size:
            raw += filtered([packed(r.ravel(), depth) for r in part], kind, step)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = zlib.compress(raw)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    parts = [*(chunk(k, b) for k, b in extra), chunk(b"tEXt", b"Comment\0x"), chunk(b"IDAT", data[:7]), chunk(b"IDAT", data[7:]), chunk(b"IEND", b"")]
    return images.SIGNATURE + head + b"".join(parts)


@pytest.mark.parametrize("colour,depth", KINDS)
@pytest.mark.parametrize("interlaced", [False, True])
def test_every_kind_is_read(colour, depth, interlaced):
    r = np.random.default_rng(colour * 100 + depth)
    palette = r.integers(0, 256, (1 << min(depth, 8), 3), dtype=np.uint8)
    extra = [(b"PLTE", palette.tobytes()), (b"tRNS", bytes([7, 9]))] if colour == 3 else []
    for height, width in ((1, 1), (5, 3), (9, 17), (2, 8)):
        samples = r.integers(0, 1 << depth, (height, width, images._CHANNELS[colour]))
        full = np.round(samples * 255 / ((1 << depth) - 1)) if depth < 16 else samples >> 8
        want = np.full((height, width, 4), 255)
        if colour == 3:
            want[:, :, :3] = palette[samples[:, :, 0]]
            want[:, :, 3] = np.array([7, 9] + [255] * 254)[samples[:, :, 0]]
        else:
            want[:, :, :3] = full[:, :, :3] if colour in (2, 6) else full[:, :, :1]
            if colour in (4, 6):
                want[:, :, 3] = full[:, :, -1]
        for kind in range(6):
            assert (images.decode(png(samples, colour, depth, kind, interlaced, extra)) == want).all(), (height, width, kind)


def test_a_clear_colour():
    samples = np.array([[[10, 20, 30], [10, 20, 31]]])
    got = images.decode(png(samples, 2, 8, extra=[(b"tRNS", struct.pack(">HHH", 10, 20, 30))]))
    assert got[0, :, 3].tolist() == [0, 255]


def test_written_images_are_read_back():
    r = np.random.default_rng(5)
    for shape in ((1, 1, 3), (7, 5, 4), (40, 33, 3)):
        pixels = r.integers(0, 256, shape, dtype=np.uint8)
        assert (images.decode(images.encode(pixels))[:, :, : shape[2]] == pixels).all()
    assert images.encode(np.full((2, 2, 4), 255, np.uint8))[25] == 2  # an alpha channel without use goes


@pytest.mark.parametrize("width,height,side,want", [(32, 32, 1200, (32, 32)), (2000, 1000, 1200, (1200, 600)), (16, 16, 64, (16, 16)), (512, 512, 64, (64, 64)), (128, 32, 64, (64, 16)), (3, 3000, 64, (1, 64)), (3000, 3, 64, (64, 1))])
def test_fitting(width, height, side, want):
    pixels = np.arange(width * height * 3, dtype=np.uint32).reshape(height, width, 3).astype(np.uint8)
    data, w, h = images.fit(images.encode(pixels), side)
    assert (w, h) == want == images.fitted_size(width, height, side)
    got = images.decode(data)
    for x, y in ((0, 0), (w - 1, h - 1), (w // 2, h // 3)):
        assert (got[y, x, :3] == pixels[y * height // h, x * width // w]).all()


def test_what_cannot_be_read_is_null(spark):
    good = images.encode(np.zeros((100, 50, 3), np.uint8))
    rows = [(0, good), (1, b"not an image"), (2, b""), (3, None), (4, good[:-13]), (5, good[:40] + b"\0" + good[41:]), (6, b"GIF89a"), (7, images.SIGNATURE)]
    head = images.SIGNATURE + struct.pack(">I", 13)
    huge = b"IHDR" + struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 2, 0, 0, 0)
    rows.append((8, head + huge + struct.pack(">I", zlib.crc32(huge)) + good[33:]))
    df = spark.createDataFrame(rows, "id int, data binary").withColumn("icon", images.icon_png(F.col("data")))
    got = {r.id: r.icon for r in df.collect()}
    assert (got[0].width, got[0].height) == (32, 64) and images.decode(bytes(got[0].data)).shape == (64, 32, 4)
    assert [k for k, v in got.items() if v is not None] == [0]
