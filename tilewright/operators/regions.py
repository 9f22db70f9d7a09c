"""Regions of rasters: components within tiles, merging across seams, statistics.

A pixel table has image_id, y, x.  Tiles are components' unit of work: a task
labels a tile with numpy, and only regions that touch a seam meet in joins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Boxes, box_runs, on_groups
from .graph import components, cut, shuffled

EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
SHIFT = 1 << 20
#: Side of the block of pixels that a task labels at once, where tiles are not larger.
BLOCK = 512


def pixel_key(y: Column, x: Column) -> Column:
    return (y * SHIFT + x).cast("long")


def label_tiles(y: np.ndarray, x: np.ndarray, group: np.ndarray, around: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the place of the first pixel of its component within its group, and how many of its eight neighbours are there.

    Each round takes the least label around and then follows labels to labels, so
    rounds grow with the logarithm of the longest path.
    """
    order = np.lexsort([x, y, group])  # in the order of keys, so that labels are positions
    boxes = Boxes(y[order], x[order], group[order])
    at, wide, n = boxes.at, boxes.wide, len(y)
    place = np.full(boxes.size, n)
    place[at] = np.arange(n)
    near = [place[at + dy * wide + dx] for dy, dx in around]
    label = np.arange(n + 1)
    while True:
        least = label[:-1]
        for k in near:
            least = np.minimum(least, label[k])
        if (least == label[:-1]).all():
            break
        # a pixel's label may improve that of the pixel it names
        new = label.copy()
        np.minimum.at(new, label[:-1], least)
        new[:-1] = np.minimum(new[:-1], least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new
    first, count = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int32)
    first[order] = order[label[:-1]]
    count[order] = sum((place[at + dy * wide + dx] < n).astype(np.int32) for dy, dx in EIGHT)
    return first, count


def label_tile(y: np.ndarray, x: np.ndarray, around: list[tuple[int, int]]) -> np.ndarray:
    """For each pixel of one tile the least key of its component."""
    first, _ = label_tiles(y, x, np.zeros(len(y), dtype=np.int64), around)
    return y[first].astype(np.int64) * SHIFT + x[first]


def tile_regions(pix: DataFrame, tile: int, diagonal: bool = True, carry: Sequence[str] = (), near: bool = False) -> DataFrame:
    """Adds tile_row, tile_col and region: the least pixel key of the pixel's component within its tile.  Columns in ``carry`` stay.

    A task labels a block of tiles at once, and blocks of few pixels together.  With ``near`` there is also the number of the pixel's eight neighbours within its tile.
    """
    around = EIGHT if diagonal else FOUR
    block = tile * max(1, BLOCK // tile)

    def label(part: pa.Table, group: np.ndarray) -> pa.Table:
        y, x = (part[c].to_numpy().astype(np.int64) for c in ("y", "x"))
        # a gap between tiles, so that they do not touch
        apart = (y + y // tile, x + x // tile)
        region, count = np.empty(len(y), dtype=np.int64), np.empty(len(y), dtype=np.int32)
        for run in box_runs(*apart, group):
            first, count[run] = label_tiles(apart[0][run], apart[1][run], group[run], around)
            region[run] = y[run][first] * SHIFT + x[run][first]
        part = part.drop_columns(["block_row", "block_col"]).append_column("region", pa.array(region))
        return part.append_column("near", pa.array(count)) if near else part

    at = lambda c, n: F.floor(F.col(c) / n).cast("int")
    rows = pix.select("image_id", "y", "x", *carry, at("y", tile).alias("tile_row"), at("x", tile).alias("tile_col"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", region long" + (", near int" if near else "")
    return on_groups(rows.withColumns({"block_row": at("y", block), "block_col": at("x", block)}), ["image_id", "block_row", "block_col"], label, schema)


def seam_pairs(labelled: DataFrame, tile: int, diagonal: bool = False) -> DataFrame:
    """Regions of neighbouring tiles that touch across a seam: image_id, a, b.

    Straight across only, unless ``diagonal``.  Only pixels beside a seam are joined.
    """
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    rim = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    seam = labelled.where(rim("y") | rim("x"))
    near = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps)))
    left = seam.select("image_id", F.col("tile_row").alias("row_a"), F.col("tile_col").alias("col_a"), F.col("region").alias("a"), near.alias("at"))
    left = left.select("image_id", "row_a", "col_a", "a", F.col("at.y").alias("y"), F.col("at.x").alias("x"))
    left = left.where((F.floor(F.col("y") / tile) != F.col("row_a")) | (F.floor(F.col("x") / tile) != F.col("col_a")))
    right = seam.select("image_id", "y", "x", F.col("region").alias("b"))
    return left.join(shuffled(right), ["image_id", "y", "x"]).select("image_id", "a", "b").distinct()


def merged_regions(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds global_region: the least region of those connected through ``pairs``."""
    node = lambda c: F.struct(F.col("image_id").cast("long").alias("i"), F.col(c).alias("r"))
    roots = components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    roots = roots.select(F.col("node.i").alias("of_image"), F.col("node.r").alias("of_region"), F.col("root.r").alias("global_region"))
    joined = labelled.join(shuffled(roots), (F.col("image_id") == F.col("of_image")) & (F.col("region") == F.col("of_region")), "left")
    return joined.withColumn("global_region", F.coalesce("global_region", "region")).drop("of_image", "of_region")


def whole_image_components(pix: DataFrame, tile: int, diagonal: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Pixels with ``component``: the least pixel key of the component in the whole image.  Columns in ``carry`` stay."""
    labelled = cut(tile_regions(pix, tile, diagonal, carry))
    return merged_regions(labelled, seam_pairs(labelled, tile, diagonal)).select("image_id", "y", "x", *carry, F.col("global_region").alias("component"))


def shape(of: list[str], pix: DataFrame) -> DataFrame:
    """Area, centroid and box of each group of pixels."""
    return pix.groupBy(*of).agg(
        F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.min("y").alias("y1"), F.min("x").alias("x1"), F.max("y").alias("y2"), F.max("x").alias("x2"),
    )


def border_flags(labelled: DataFrame, tile: int) -> DataFrame:
    """Per tile region: area, centroid, box (tile-local) and the tile edges it touches."""
    local = labelled.select("image_id", "tile_row", "tile_col", "region", (F.col("y") % tile).alias("y"), (F.col("x") % tile).alias("x"))
    out = shape(["image_id", "tile_row", "tile_col", "region"], local)
    edges = F.array_compact(F.array(*(F.when(c, name) for name, c in (("bottom", F.col("y2") == tile - 1), ("left", F.col("x1") == 0), ("right", F.col("x2") == tile - 1), ("top", F.col("y1") == 0)))))
    return out.withColumn("edges", F.array_join(edges, ","))


def perimeters(merged: DataFrame, tile: int) -> DataFrame:
    """Per merged region: its pixels with any of the eight neighbours outside the region.

    ``merged`` has ``near``, the neighbours within the tile, which are of one region; only pixels at a tile's
    edge are joined with those across.
    """
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    seam = merged.where(edge("y") | edge("x"))
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in EIGHT)))
    across = seam.select("image_id", "global_region", "y", "x", "tile_row", "tile_col", steps.alias("n"))
    across = across.withColumns({"ny": F.col("y") + F.col("n.dy"), "nx": F.col("x") + F.col("n.dx")}).where((F.floor(F.col("ny") / tile) != F.col("tile_row")) | (F.floor(F.col("nx") / tile) != F.col("tile_col")))
    there = seam.select(F.col("image_id").alias("i"), F.col("global_region").alias("g"), F.col("y").alias("ty"), F.col("x").alias("tx"))
    met = across.join(there, (F.col("image_id") == F.col("i")) & (F.col("global_region") == F.col("g")) & (F.col("ny") == F.col("ty")) & (F.col("nx") == F.col("tx")))
    more = met.groupBy("image_id", "global_region", "y", "x").agg(F.count("*").alias("more"))
    at_edge = seam.select("image_id", "global_region", "y", "x", "near").join(more, ["image_id", "global_region", "y", "x"], "left").where(F.col("near") + F.coalesce("more", F.lit(0)) < 8)
    rim = merged.where(~(edge("y") | edge("x")) & (F.col("near") < 8)).select("image_id", "global_region").unionByName(at_edge.select("image_id", "global_region"))
    return rim.groupBy("image_id", "global_region").agg(F.count("*").alias("perimeter"))


def global_regions(merged: DataFrame, tile: int) -> DataFrame:
    """Per merged region: shape, tiles, source regions, perimeter and circularity (0 without a perimeter)."""
    key = ["image_id", "global_region"]
    # a region lies in one tile
    each = merged.groupBy(*key, "tile_row", "tile_col", "region").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum("x").alias("sx"), F.min("y").alias("y1"), F.min("x").alias("x1"), F.max("y").alias("y2"), F.max("x").alias("x2"))
    stats = each.groupBy(*key).agg(
        F.sum("n").alias("area"), (F.sum("sy") / F.sum("n")).alias("cy"), (F.sum("sx") / F.sum("n")).alias("cx"), F.min("y1").alias("y1"), F.min("x1").alias("x1"), F.max("y2").alias("y2"), F.max("x2").alias("x2"),
        F.count_distinct(F.struct("tile_row", "tile_col")).alias("n_tiles"), F.count("*").alias("n_sources"),
    )
    out = stats.join(perimeters(merged, tile), key, "left")
    perimeter = F.coalesce("perimeter", F.lit(0))
    return out.withColumn("perimeter", perimeter).withColumn("circularity", F.when(F.col("perimeter") > 0, 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0))


def area_summary(regions: DataFrame, by: list[str], px_area: float = 1.0) -> DataFrame:
    """Count, sum, mean, median, extremes and population deviation of areas; size classes; share of merged regions."""
    n = F.count("*")
    return regions.groupBy(*by).agg(
        n.alias("n"), F.sum("area").alias("total_area"), F.round(F.avg("area"), 6).alias("mean_area"), F.round(F.median("area"), 6).alias("median_area"), F.min("area").alias("min_area"), F.max("area").alias("max_area"),
        F.round(F.stddev_pop("area"), 6).alias("std_area"), F.round(F.sum("area") * px_area, 6).alias("total_um2"),
        F.count_if(F.col("area") < 100).alias("small"), F.count_if((F.col("area") >= 100) & (F.col("area") < 500)).alias("medium"), F.count_if(F.col("area") >= 500).alias("large"),
        F.count_if(F.col("n_sources") > 1).alias("merged"), F.round(100 * F.count_if(F.col("n_sources") > 1) / n, 6).alias("merged_percent"),
    )
