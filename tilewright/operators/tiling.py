"""Tiles: catalogues of tile files, cutting images into overlapping tiles, and putting them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.names import FOUR_NUMBERS, tile_position
from .ranking import first_best


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def catalogue(files: DataFrame) -> DataFrame:
    """One file for each row and column, of several the last path in order; files without a position are left out."""
    placed = files.select("path", *(v.alias(k) for k, v in tile_position(base_name(F.col("path"))).items())).where("tile_row IS NOT NULL")
    return first_best(placed, ["tile_row", "tile_col"], "path DESC")


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Array files named by four numbers, with the instances that their sidecars (path, num_instances) tell; 0 without one."""
    name = base_name(F.col("path"))
    tiles = files.where(name.rlike(FOUR_NUMBERS + r"\.npy")).select("path", name.alias("filename"), *(v.alias(k) for k, v in tile_position(name).items()))
    told = sidecars.select(base_name(F.col("path")).alias("_meta"), F.col("num_instances").cast("long").alias("_n"))
    joined = tiles.join(told, F.replace("filename", F.lit(".npy"), F.lit("_meta.json")) == F.col("_meta"), "left")
    return joined.select(*tiles.columns, F.coalesce("_n", F.lit(0)).alias("num_instances"))


def grid_size(tiles: DataFrame, by: list[str], side: int) -> DataFrame:
    """Rows, columns and the whole size: from the offsets where any tile has them, else from rows and columns."""
    most = lambda c: F.max(F.col(c)) + 1
    size = lambda at, c: F.coalesce(F.max(F.col(at)) + side, most(c) * side)
    return tiles.groupBy(*by).agg(most("tile_row").alias("n_rows"), most("tile_col").alias("n_cols"), size("offset_y", "tile_row").alias("height"), size("offset_x", "tile_col").alias("width"))


def starts(size: int, patch: int, overlap: int) -> list[int]:
    """Where tiles begin along an axis; the last ones are shifted back into the image."""
    step = patch if patch >= size else patch - 2 * overlap
    if step <= 0:
        raise ValueError("the overlap is too large for the tiles")
    return sorted({max(0, min(at, size - patch)) for at in range(0, size, step)})


def mirrored(at: Column, size: int) -> Column:
    """The pixel that stands at ``at`` when an axis of ``size`` pixels goes on in mirror images."""
    turn = F.pmod(at, F.lit(2 * size))
    return F.when(turn < size, turn).otherwise(2 * size - 1 - turn)


def cut_tiles(pix: DataFrame, height: int, width: int, patch: int, overlap: int) -> DataFrame:
    """Every tile's pixels: tile_y, tile_x (where the tile begins) and ly, lx within it."""
    begins = lambda c, size: F.filter(F.array(*(F.lit(s) for s in starts(size, patch, overlap))), lambda s: (s <= F.col(c)) & (s + patch > F.col(c)))
    rows = pix.withColumn("tile_y", F.explode(begins("y", height))).withColumn("tile_x", F.explode(begins("x", width)))
    return rows.withColumns({"ly": F.col("y") - F.col("tile_y"), "lx": F.col("x") - F.col("tile_x")}).drop("y", "x")


def stitched(tiles: DataFrame, by: list[str], height: int, width: int, patch: int, overlap: int, value: str = "v") -> DataFrame:
    """Whole images from tiles: a pixel comes from the middle of its tile, at the image's edges from the edge tile.

    Where middles overlap, as those of shifted tiles do, the later tile in reading order counts.
    """

    def inside(at: str, begin: str, size: int) -> Column:
        margin = 0 if patch >= size else overlap
        low = F.when(F.col(begin) == 0, 0).otherwise(margin)
        high = F.when(F.col(begin) == max(0, size - patch), patch).otherwise(patch - margin)
        return (F.col(at) >= low) & (F.col(at) < high)

    used = tiles.where(inside("ly", "tile_y", height) & inside("lx", "tile_x", width))
    at = used.groupBy(*by, (F.col("tile_y") + F.col("ly")).alias("y"), (F.col("tile_x") + F.col("lx")).alias("x"))
    return at.agg(F.max_by(value, F.struct("tile_y", "tile_x")).alias(value))
