"""Pixels of images, prepared for recognition: enlarged, stretched, with more contrast and sharpness, as arithmetic on arrays.

Images are arrays of bytes (height, width, 3). Each step works on whole images in numpy inside Spark's tasks; results are those
of integer arithmetic, so they are the same on all machines.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from pagemill import ship
from pagemill.config import DEFAULT, Settings

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bits behind the point of the weights of resampling.
WEIGHT_BITS = 22
LOBES = 3
#: Values of a PNG file: samples of a pixel by colour type (grey, RGB, palette, grey and alpha, RGB and alpha).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks_of(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG file as (type, data); ValueError for anything else, or a broken one."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + size]
        if len(data) < size or zlib.crc32(kind + data) != int.from_bytes(png[at + 8 + size : at + 12 + size], "big"):
            raise ValueError(f"a broken chunk {kind.decode('latin-1')}")
        yield kind, data
        at += size + 12
        if kind == b"IEND":
            return
    raise ValueError("the file has no end")


def unfiltered(data: bytes, height: int, width: int, step: int):
    """Rows of bytes (height, width) from filtered rows, each of which begins with its filter; step: bytes of a pixel."""
    import numpy as np

    rows = np.frombuffer(data, np.uint8, height * (width + 1)).reshape(height, width + 1)
    out = np.zeros((height, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(height):
        kind, row = rows[y, 0], rows[y, 1:]
        if kind == 0:
            own = row
        elif kind == 1:  # the pixel before: sums along the row, for each byte of a pixel
            pad = np.zeros(-(-width // step) * step, np.uint8)
            pad[:width] = row
            own = np.cumsum(pad.reshape(-1, step), 0, np.uint8).reshape(-1)[:width]
        elif kind == 2:  # the pixel above
            own = row + above
        elif kind in (3, 4):
            own = _sequential(row.tobytes(), above.tobytes(), step, kind)
        else:
            raise ValueError(f"an unknown filter {kind}")
        out[y] = above = own
    return out


def _sequential(row: bytes, above: bytes, step: int, kind: int):
    """A row whose bytes need those before them: by the mean of left and above (3), or the nearest of three (4)."""
    import numpy as np

    own = bytearray(row)
    for x, value in enumerate(row):
        a, b = own[x - step] if x >= step else 0, above[x]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = above[x - step] if x >= step else 0
            to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
        own[x] = (value + guess) & 255
    return np.frombuffer(bytes(own), np.uint8)


def png_pixels(png: bytes):
    """The pixels (height, width, 3) of a PNG file; transparency is left out. ValueError if it is broken, or interlaced."""
    import numpy as np

    header, palette, data = None, None, []
    for kind, chunk in chunks_of(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(chunk)
    if header is None or header[3] not in SAMPLES or header[6]:
        raise ValueError("an image of a kind that is not read")
    width, height, depth, colour = header[:4]
    bits = SAMPLES[colour] * depth
    rows = unfiltered(zlib.decompress(b"".join(data)), height, -(-width * bits // 8), max(1, bits // 8))
    if depth == 16:
        samples = rows[:, ::2]
    elif depth < 8:
        each = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        samples = (each * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)[:, : width * SAMPLES[colour]]
        if colour == 0:
            samples = samples * np.uint8(255 // ((1 << depth) - 1))
    else:
        samples = rows
    pixels = samples.reshape(height, width, -1)
    if colour == 3:
        if palette is None or len(palette) <= int(pixels.max(initial=0)):
            raise ValueError("a palette that lacks colours")
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, 2) if colour in (0, 4) else np.ascontiguousarray(pixels[:, :, :3])


def png_of(pixels) -> bytes:
    """A PNG file of pixels (height, width, 3)."""
    import numpy as np

    height, width = pixels.shape[:2]
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def weights(size: int, wanted: int):
    """The weights (wanted, size) of resampling a line by Lanczos windows of three lobes, as integers of WEIGHT_BITS bits."""
    import numpy as np

    scale = size / wanted
    spread = max(scale, 1.0)
    centre = (np.arange(wanted) + 0.5) * scale
    low = np.maximum((centre - LOBES * spread + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + LOBES * spread + 0.5).astype(np.int64), size)
    at = np.arange(size)
    x = (at[None, :] - centre[:, None] + 0.5) / spread
    window = np.where((x >= -LOBES) & (x < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    window[(at[None, :] < low[:, None]) | (at[None, :] >= high[:, None])] = 0.0
    window /= window.sum(1, keepdims=True)
    return np.where(window < 0, np.ceil(window * (1 << WEIGHT_BITS) - 0.5), np.floor(window * (1 << WEIGHT_BITS) + 0.5)).astype(np.int64)


def resampled(pixels, width: int, height: int):
    """Pixels (height, width, bands) of another size: lines first, then columns, rounded to bytes after each."""
    import numpy as np

    def along(values, size):  # the first axis
        if values.shape[0] == size:
            return values
        sums = np.tensordot(weights(values.shape[0], size), values.astype(np.int64), (1, 0))
        return np.clip((sums + (1 << (WEIGHT_BITS - 1))) >> WEIGHT_BITS, 0, 255).astype(np.uint8)

    return along(along(pixels.swapaxes(0, 1), width).swapaxes(0, 1), height)


def stretched(pixels, cutoff: int):
    """Each band stretched over all values, once cutoff per cent of its darkest and of its lightest pixels are set aside."""
    import numpy as np

    out = np.empty_like(pixels)
    for band in range(pixels.shape[2]):
        counts = np.bincount(pixels[:, :, band].ravel(), minlength=256)
        cut = int(counts.sum()) * cutoff // 100
        kept = counts > 0 if not cut else (np.cumsum(counts) > cut) & (np.cumsum(counts[::-1])[::-1] > cut)
        found = np.flatnonzero(kept)
        low, high = (int(found[0]), int(found[-1])) if len(found) else (0, 0)
        table = np.arange(256)
        if high > low:
            table = np.clip((table - low) * 255 // (high - low), 0, 255)
        out[:, :, band] = table.astype(np.uint8)[pixels[:, :, band]]
    return out


def _blended(base, pixels, per_cent: int):
    """Pixels moved from base by per_cent of their difference, cut to bytes."""
    import numpy as np

    base, pixels = base.astype(np.int64), pixels.astype(np.int64)
    return np.clip((base * 100 + (pixels - base) * per_cent) // 100, 0, 255).astype(np.uint8)


def with_contrast(pixels, per_cent: int):
    """Pixels moved away from the image's mean grey."""
    import numpy as np

    grey = (pixels.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16
    mean = (2 * int(grey.sum()) + grey.size) // (2 * grey.size)
    return _blended(np.full_like(pixels, mean), pixels, per_cent)


def sharpened(pixels, per_cent: int):
    """Pixels moved away from the mean of their surroundings, in which they count five times; pixels of the rim stay."""
    import numpy as np

    p = pixels.astype(np.int64)
    smooth = p.copy()
    if min(p.shape[:2]) > 2:
        around = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + 4 * p[1:-1, 1:-1]
        smooth[1:-1, 1:-1] = (2 * around + 13) // 26
    return _blended(smooth, pixels, per_cent)


def enlarged_size(width: int, height: int, settings: Settings = DEFAULT) -> tuple[int, int]:
    """The size to which a narrow image is enlarged (assets.upscaled, for one image)."""
    if not 0 < width < settings.upscale_width:
        return width, height
    scale = min(settings.upscale_width / width, settings.upscale_most)
    return round(width * scale), round(height * scale)


def prepared(pixels, settings: Settings = DEFAULT):
    """Pixels as they are given to recognition."""
    height, width = pixels.shape[:2]
    grown = resampled(pixels, *enlarged_size(width, height, settings))
    return sharpened(with_contrast(stretched(grown, settings.stretch_cutoff), settings.contrast_per_cent), settings.sharpness_per_cent)


def prepare_images(images: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """images (path, content, …) with ``content`` prepared for recognition and ``error``.

    An image that cannot be read keeps its content and has an error. One image at a time, no shuffle.
    """
    ship(images.sparkSession)
    names = [c for c in images.columns if c != "error"]
    at = names.index("content")
    schema = images.select(*names).schema.add("error", "string")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                b, error = batch.slice(k, 1), None
                content = b.column(at)[0].as_py()
                try:
                    content = png_of(prepared(png_pixels(content or b""), settings))
                except (ValueError, zlib.error, struct.error) as failure:
                    error = f"{type(failure).__name__}: {failure}"
                columns = [pa.array([content], pa.binary()) if c == at else b.column(c) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([error], pa.string())], schema.fieldNames())

    return images.select(*names).mapInArrow(read, schema)


def prepared_rasters(rasters: DataFrame, key: str, width: int, height: int, cutoff: int) -> DataFrame:
    """key, ``stretched`` and ``resampled`` (to width by height), as lists of bytes, of grey images given by their rows in the column raster."""
    ship(rasters.sparkSession)

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            one, two = [], []
            for raster in b.column(1).to_pylist():
                pixels = np.array(raster, np.uint8)[:, :, None]
                one.append(stretched(pixels, cutoff).ravel().tolist())
                two.append(resampled(pixels, width, height).ravel().tolist())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(one, kind), pa.array(two, kind)], [key, "stretched", "resampled"])

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, "raster").mapInArrow(read, f"`{key}` {kind}, stretched array<int>, resampled array<int>")
