"""Exact distances of pixels to the nearest one outside their mask, and the deepest points.

Two passes, each over strips of an image: along columns the distance to the nearest
outside pixel of the column, then along rows the lower envelope of the parabolas
``depth**2 + (x - x')**2``.  The envelope is built for all rows of a strip at once, column by column, so the work grows with
the pixels, and a task holds one strip.  Everything around an image is outside.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a strip, about.
STRIP = 1 << 21


def along_columns(inside: np.ndarray) -> np.ndarray:
    """For each pixel the distance to the nearest pixel outside in its column; 0 outside."""
    up = np.zeros((inside.shape[0] + 2, inside.shape[1]), dtype=np.int64)
    for y in range(1, inside.shape[0] + 1):
        up[y] = np.where(inside[y - 1], up[y - 1] + 1, 0)
    for y in range(inside.shape[0], 0, -1):
        up[y] = np.minimum(up[y], up[y + 1] + 1)
    return up[1:-1]


def along_rows(depth: np.ndarray) -> np.ndarray:
    """The least ``depth[x']**2 + (x - x')**2`` over the row, for each pixel; beyond both ends the depth is 0."""
    g = np.pad(depth.astype(np.int64), ((0, 0), (1, 1)))
    height, width = g.shape
    square = g * g
    rows = np.arange(height)
    # per row a stack of parabolas: where each lies, and the first pixel where it is the lowest
    at, since = np.zeros((height, width), dtype=np.int32), np.zeros((height, width), dtype=np.int32)
    top = np.zeros(height, dtype=np.int64)
    for x in range(1, width):
        open_ = rows
        while len(open_):  # parabolas that the new one undercuts where they begin
            q = top[open_]
            s, t = at[open_, q], since[open_, q]
            open_ = open_[(t - s) ** 2 + square[open_, s] > (t - x) ** 2 + square[open_, x]]
            top[open_] -= 1
            open_ = open_[top[open_] >= 0]
        gone = top < 0
        q = np.maximum(top, 0)
        s = at[rows, q]
        begin = 1 + (x * x - s * s + square[:, x] - square[rows, s]) // np.maximum(2 * (x - s), 1)
        begin = np.where(gone, 0, begin)
        put = rows[begin < width]
        top[put] += 1
        at[put, top[put]], since[put, top[put]] = x, begin[put]
    out = np.empty_like(g)
    for x in range(width - 1, -1, -1):
        s = at[rows, top]
        out[:, x] = (x - s) ** 2 + square[rows, s]
        top -= (x == since[rows, top]) & (top > 0)
    return out[:, 1:-1]


def _column_depths(pix: DataFrame, of: list[str], height: int) -> DataFrame:
    """``of``, y, x, and the depth along the column, from pixels (``of``, y, x)."""
    wide = max(1, STRIP // height)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        left = int(part["x"].min())
        inside = np.zeros((height, int(part["x"].max()) - left + 1), dtype=bool)
        y, x = part["y"].to_numpy(), part["x"].to_numpy() - left
        inside[y, x] = True
        return part.drop(columns="strip").assign(depth=along_columns(inside)[y, x])

    rows = pix.select(*of, "y", "x", F.floor(F.col("x") / wide).alias("strip"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("strip").schema.fields)
    return rows.groupBy(*of, "strip").applyInPandas(run, f"{fields}, depth long")


def _row_strips(pix: DataFrame, of: list[str], height: int, width: int, run) -> DataFrame:
    tall = max(1, STRIP // width)
    rows = _column_depths(pix, of, height).withColumn("strip", F.floor(F.col("y") / tall))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("strip", "depth"))

    def strip(part: pd.DataFrame) -> pd.DataFrame:
        top = int(part["y"].min())
        depth = np.zeros((int(part["y"].max()) - top + 1, width), dtype=np.int64)
        y, x = part["y"].to_numpy() - top, part["x"].to_numpy()
        depth[y, x] = part["depth"].to_numpy()
        return run(part.drop(columns=["strip", "depth"]).assign(depth=along_rows(depth)[y, x]))

    return rows.groupBy(*of, "strip").applyInPandas(strip, f"{fields}, depth long")


def depths(pix: DataFrame, of: list[str], height: int, width: int) -> DataFrame:
    """``of``, y, x, depth: for each pixel of a mask the squared distance to the nearest pixel outside."""
    return _row_strips(pix, of, height, width, lambda part: part)


def deepest(pix: DataFrame, of: list[str], height: int, width: int) -> DataFrame:
    """Per mask its deepest pixel, the first in reading order on ties: ``of``, y, x, depth.  Strips send one pixel each."""
    found = _row_strips(pix, of, height, width, lambda part: part.sort_values(["depth", "y", "x"], ascending=[False, True, True]).head(1))
    best = F.min_by(F.struct("depth", "y", "x"), F.struct(-F.col("depth"), "y", "x")).alias("b")
    return found.groupBy(*of).agg(best).select(*of, "b.y", "b.x", "b.depth")
