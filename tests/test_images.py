import random
import struct
import zlib

import numpy as np
import pytest

from pagemill.config import Settings
from pagemill.operators import images


def picture(height, width, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


def file_of(rows, width, height, depth, colour, palette=b"", interlaced=0):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(rows, step, kinds):
    """Rows of bytes as a writer filters them, by the definitions of the five filters."""
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds):
        line = bytearray([kind])
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - [0, a, b, (a + b) // 2, nearest][kind]) & 255)
        out, above = out + bytes(line), row
    return out


@pytest.mark.parametrize("colour, samples", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters(colour, samples):
    draw = random.Random(colour)
    rows = [bytes(draw.randrange(256) for _ in range(7 * samples)) for _ in range(20)]
    png = file_of(filtered(rows, samples, [k % 5 for k in range(20)]), 7, 20, 8, colour)
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(20, 7, samples)
    expected = np.repeat(raw[:, :, :1], 3, 2) if samples < 3 else raw[:, :, :3]
    assert (images.png_pixels(png) == expected).all()


def test_palettes_and_depths():
    palette = bytes(range(12))
    two = file_of(b"\0" + bytes([0b00011011]) + b"\0" + bytes([0b11100100]), 4, 2, 2, 3, palette)
    assert images.png_pixels(two)[:, :, 0].tolist() == [[0, 3, 6, 9], [9, 6, 3, 0]]
    one = file_of(b"\0" + bytes([0b10100000]), 3, 1, 1, 0)
    assert images.png_pixels(one)[:, :, 1].tolist() == [[255, 0, 255]]
    deep = file_of(b"\0\x12\x34\xff\x00", 2, 1, 16, 0)
    assert images.png_pixels(deep)[:, :, 2].tolist() == [[0x12, 0xFF]]


def test_round_trip():
    pixels = picture(9, 31)
    assert (images.png_pixels(images.png_of(pixels)) == pixels).all()


@pytest.mark.parametrize("png", [b"", b"x" * 50, images.SIGNATURE, images.png_of(picture(3, 3))[:-5], images.png_of(picture(3, 3)).replace(b"IDAT", b"IDAX"), file_of(b"\0\1", 1, 1, 8, 0, interlaced=1), file_of(b"\x09\1", 1, 1, 8, 0), file_of(b"\0\5", 1, 1, 8, 3, bytes(6))])
def test_broken_files(png):
    with pytest.raises((ValueError, zlib.error)):
        images.png_pixels(png)


def test_resampling_against_a_plain_sum():
    import math

    def lanczos(x):
        return 1.0 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if -3 <= x < 3 else 0.0

    pixels = picture(8, 11, 4)
    for width, height in ((30, 8), (11, 20), (5, 3), (33, 24)):
        def line(values, size):
            scale, out = len(values) / size, []
            for o in range(size):
                spread, centre = max(scale, 1), (o + 0.5) * scale
                ks = {i: lanczos((i - centre + 0.5) / spread) for i in range(max(0, int(centre - 3 * spread + 0.5)), min(len(values), int(centre + 3 * spread + 0.5)))}
                out.append(min(255, max(0, round(sum(k * values[i] for i, k in ks.items()) / sum(ks.values())))))
            return out

        wide = np.array([[line([int(v) for v in row[:, b]], width) for b in range(3)] for row in pixels]).transpose(0, 2, 1) if width != 11 else pixels
        plain = np.array([[line([int(v) for v in wide[:, x, b]], height) for b in range(3)] for x in range(width)]).transpose(2, 0, 1) if height != 8 else wide
        assert np.abs(images.resampled(pixels, width, height).astype(int) - plain).max() <= 1
    assert (images.resampled(np.full((4, 4, 3), 77, np.uint8), 13, 9) == 77).all()


def test_stretch_contrast_sharpness():
    pixels = np.clip(picture(10, 10, 2), 50, 200).astype(np.uint8)
    full = images.stretched(pixels, 0)
    assert full.min() == 0 and full.max() == 255 and (images.stretched(full, 0) == full).all()
    assert (images.stretched(np.full((3, 3, 3), 9, np.uint8), 1) == 9).all()
    assert (images.with_contrast(pixels, 100) == pixels).all() and (images.sharpened(pixels, 100) == pixels).all()
    more = images.with_contrast(pixels, 115).astype(int)
    assert more.std() > pixels.std() and (images.with_contrast(pixels, 0) == images.with_contrast(pixels, 0)[0, 0]).all()
    spot = np.full((5, 5, 3), 100, np.uint8)
    spot[2, 2] = 152
    got = images.sharpened(spot, 200)[:, :, 0]
    assert got[2, 2] == 184 and got[1, 1] == 96 and got[0, 0] == 100  # the mean in the middle is 120, beside it 104


def test_prepared_images(spark):
    small = images.png_of(picture(10, 20))
    rows = [("a", bytearray(small)), ("b", bytearray(b"no picture")), ("c", None)]
    got = {r["path"]: r for r in images.prepare_images(spark.createDataFrame(rows, "path string, content binary"), Settings()).collect()}
    assert images.png_pixels(bytes(got["a"]["content"])).shape == (30, 60, 3) and got["a"]["error"] is None
    assert bytes(got["b"]["content"]) == b"no picture" and got["b"]["error"].startswith("ValueError") and got["c"]["content"] is None
    assert (images.png_pixels(bytes(got["a"]["content"])) == images.prepared(images.png_pixels(small))).all()
