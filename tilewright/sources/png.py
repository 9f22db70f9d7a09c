"""PNG images as rows: decoding and encoding in tasks, one image at a time.

Decoding takes gray, gray with alpha, colours, colours with alpha, and palettes, 8 bits a sample
(1, 2 and 4 for gray and palettes too), not interlaced.  Lines are filtered by five
predictors; where one depends on the pixel to the left by a carry (average, Paeth) the image is
undone along diagonals, all lines at once, so no Python code runs per pixel.
A file that can't be read has a ``problem`` and no pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: The signature, and the samples of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRAY, RGB, PALETTE, GRAY_ALPHA, RGB_ALPHA = 0, 2, 3, 4, 6
SAMPLES = {GRAY: 1, RGB: 3, PALETTE: 1, GRAY_ALPHA: 2, RGB_ALPHA: 4}
RASTER = "path string, height int, width int, kind int, pixels binary, palette binary, problem string"


def unfiltered(lines: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """The bytes of scan lines (height x bytes) whose filters are undone; ``step`` bytes are a pixel."""
    height, size = lines.shape
    if not np.isin(filters, (0, 1, 2, 3, 4)).all():
        raise ValueError("unknown filter")
    if not (filters > 2).any():
        out = lines.copy()
        for k in np.flatnonzero(filters):
            if filters[k] == 1:
                out[k] = np.cumsum(out[k].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            elif k:
                out[k] += out[k - 1]
        return out
    width = size // step
    raw = lines.reshape(height, width, step)
    # a border of zeros above and to the left
    out = np.zeros((height + 1, width + 1, step), dtype=np.int32)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        c = d - r
        left, up, corner, kind = out[r + 1, c], out[r, c + 1], out[r, c], filters[r][:, None]
        a, b, e = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= e), left, np.where(b <= e, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        out[r + 1, c + 1] = (raw[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, size)


def decode(data: bytes) -> tuple[np.ndarray, int, bytes | None]:
    """Samples (height x width x samples), the colour type, and the palette (three bytes an entry)."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, palette, packed, ended = 8, None, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut short")
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise ValueError("cut short")
        if zlib.crc32(tag + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("bad checksum")
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif tag == b"PLTE":
            palette = body
        elif tag == b"IDAT":
            packed.append(body)
        ended = tag == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("cut short")
    width, height, depth, kind, _, _, interlaced = head
    if kind not in SAMPLES or interlaced or not (depth == 8 or depth in (1, 2, 4) and kind in (GRAY, PALETTE)) or not width or not height:
        raise ValueError("a kind that is not read")
    if kind == PALETTE and palette is None:
        raise ValueError("no palette")
    bits = SAMPLES[kind] * depth
    size = (width * bits + 7) // 8
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error:
        raise ValueError("bad data") from None
    if len(raw) != height * (size + 1):
        raise ValueError("bad size")
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(height, size + 1)
    out = unfiltered(rows[:, 1:], rows[:, 0], max(1, bits // 8))
    if depth < 8:
        parts = np.unpackbits(out, axis=1)[:, : width * depth].reshape(height, width, depth)
        out = (parts * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
        if kind == GRAY:
            out = out * np.uint8(255 // ((1 << depth) - 1))
    return out.reshape(height, width, SAMPLES[kind]), kind, palette


def encode(samples: np.ndarray, palette: bytes | None = None) -> bytes:
    """A file of uint8 samples, height x width (with a palette or gray) or height x width x 2, 3 or 4."""
    samples = samples.reshape(*samples.shape[:2], -1)
    kind = PALETTE if palette is not None else {1: GRAY, 2: GRAY_ALPHA, 3: RGB, 4: RGB_ALPHA}[samples.shape[2]]
    height, width = samples.shape[:2]
    lines = np.zeros((height, 1 + width * samples.shape[2]), dtype=np.uint8)
    lines[:, 1:] = samples.reshape(height, -1)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0))]
    if palette is not None:
        parts.append(chunk(b"PLTE", palette))
    return SIGNATURE + b"".join([*parts, chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)), chunk(b"IEND", b"")])


def decoded(found: DataFrame) -> DataFrame:
    """Rasters of files (path, content); a task holds one image at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                row = {"path": path.as_py(), "height": None, "width": None, "kind": None, "pixels": None, "palette": None, "problem": None}
                try:
                    samples, kind, palette = decode(content.as_py() or b"")
                    row |= {"height": samples.shape[0], "width": samples.shape[1], "kind": kind, "pixels": samples.tobytes(), "palette": palette}
                except ValueError as e:
                    row["problem"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return found.select("path", "content").mapInArrow(run, RASTER)


_ARROW = pa.schema([("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("kind", pa.int32()), ("pixels", pa.binary()), ("palette", pa.binary()), ("problem", pa.string())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rasters of the PNG files of a folder, or of one file.  Spark does not list files of no bytes."""
    return decoded(files.images(spark, path, content=True).where("lower(path) LIKE '%.png'"))


def _pixels(rasters: DataFrame, of, fields: str, names: list[str]) -> DataFrame:
    """Rows of pixels that ``of`` (samples, kind, palette) gives as y, x and values, a band of lines at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, height, width, kind, data, palette in zip(*(batch.column(k) for k in range(6))):
                path, height, width, kind, palette = (v.as_py() for v in (path, height, width, kind, palette))
                samples = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(height, width, SAMPLES[kind])
                band = max(1, 500_000 // width)
                for top in range(0, height, band):
                    columns = of(samples[top : top + band], kind, palette)
                    columns[0] = columns[0] + top
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(columns[0])), *(pa.array(c.astype(np.int32)) for c in columns)], names=["path", *names])

    rows = rasters.where("problem IS NULL").select("path", "height", "width", "kind", "pixels", "palette")
    return rows.mapInArrow(run, fields)


def colours(samples: np.ndarray, kind: int, palette: bytes | None) -> np.ndarray:
    """As red, green and blue: gray repeated, palettes looked up (black beyond their end), alpha dropped."""
    if kind in (GRAY, GRAY_ALPHA):
        return np.repeat(samples[..., :1], 3, axis=2)
    if kind == PALETTE:
        entries = np.zeros((256, 3), dtype=np.uint8)
        known = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)[:256]
        entries[: len(known)] = known
        return entries[samples[..., 0]]
    return samples[..., :3]


def rgb_pixels(rasters: DataFrame) -> DataFrame:
    """path, y, x, r, g, b of every pixel."""

    def of(samples: np.ndarray, kind: int, palette: bytes | None) -> list[np.ndarray]:
        rgb = colours(samples, kind, palette)
        y, x = np.indices(rgb.shape[:2])
        return [y.ravel(), x.ravel(), *rgb.reshape(-1, 3).T]

    return _pixels(rasters, of, "path string, y int, x int, r int, g int, b int", ["y", "x", "r", "g", "b"])


def mask_pixels(rasters: DataFrame, over: int = 127) -> DataFrame:
    """path, y, x of a mask's pixels, those over ``over``: by alpha where there is one, by luma of colours, by the plain value of gray and palettes."""

    def of(samples: np.ndarray, kind: int, palette: bytes | None) -> list[np.ndarray]:
        wide = samples.astype(np.int32)
        if kind in (RGB_ALPHA, GRAY_ALPHA):
            value = wide[..., -1]
        elif kind == RGB:  # 0.299, 0.587 and 0.114 in 14 bits, rounded
            value = (wide @ np.array([4899, 9617, 1868]) + 8192) >> 14
        else:
            value = wide[..., 0]
        return list(np.nonzero(value > over))

    return _pixels(rasters, of, "path string, y int, x int", ["y", "x"])


def object_pixels(rasters: DataFrame) -> DataFrame:
    """path, y, x, object of palette or gray masks whose values are objects; 0 is background."""

    def of(samples: np.ndarray, kind: int, palette: bytes | None) -> list[np.ndarray]:
        y, x = np.nonzero(samples[..., 0])
        return [y, x, samples[y, x, 0]]

    return _pixels(rasters, of, "path string, y int, x int, object int", ["y", "x", "object"])


def encoded(pix: DataFrame, of: list[str], sizes: DataFrame, channels: list[str], palette: bytes | None = None) -> DataFrame:
    """One PNG for each row of ``sizes`` (``of``, height, width): ``of`` and content.

    ``pix`` has ``of``, y, x and the channels; pixels that are absent are 0, those outside are left out.
    """
    rows = sizes.select(*of, "height", "width", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x"), *(F.lit(None).cast("int").alias(c) for c in channels))
    both = rows.unionByName(pix.select(*of, F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"), F.col("y").cast("int"), F.col("x").cast("int"), *(F.col(c).cast("int") for c in channels)))

    def paint(part: pd.DataFrame) -> pd.DataFrame:
        size = part.loc[part["height"].notna()]
        if not len(size):
            return pd.DataFrame({**{k: [] for k in of}, "content": []})
        height, width = int(size["height"].iloc[0]), int(size["width"].iloc[0])
        image = np.zeros((height, width, len(channels)), dtype=np.uint8)
        at = part.loc[part["y"].notna()]
        at = at.loc[(at["y"] >= 0) & (at["y"] < height) & (at["x"] >= 0) & (at["x"] < width)]
        image[at["y"].astype(int), at["x"].astype(int)] = at[channels].to_numpy(dtype=np.uint8)
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in of}, "content": [encode(image, palette)]})

    fields = ", ".join(f"{k} {dict(sizes.dtypes)[k]}" for k in of)
    return both.groupBy(*of).applyInPandas(paint, f"{fields}, content binary")
