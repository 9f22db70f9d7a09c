"""Mending masks: holes, islands, borders, merged instances and centres of errors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Area, moved, on_blocks
from .depths import deepest
from .geometry import grouped, overlapping
from .graph import cut, shuffled
from .regions import EIGHT, FOUR, SHIFT, whole_image_components

PIXEL = ["image_id", "y", "x"]


def background(pix: DataFrame, height: int, width: int) -> DataFrame:
    """The pixels of each image that ``pix`` does not have."""
    rows = pix.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    grid = rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return grid.join(pix.select(*PIXEL), PIXEL, "left_anti")


def holes(pix: DataFrame, height: int, width: int, most: int, tile: int) -> DataFrame:
    """Background components (eight neighbours) of at most ``most`` pixels: their pixels, with component and area.

    To fill the holes is to add these pixels to the mask; as scores they get a
    small positive value.  For "fewer than n" pass ``n - 1``.
    """
    labelled = cut(whole_image_components(background(pix, height, width), tile))
    small = labelled.groupBy("image_id", "component").agg(F.count("*").alias("area")).where(F.col("area") <= most)
    return labelled.join(shuffled(small), ["image_id", "component"]).select(*PIXEL, "component", "area")


def borders(labelled: DataFrame, classes: DataFrame, height: int, width: int) -> DataFrame:
    """Background pixels beside a cell, with the class of the first cell that reaches them.

    ``labelled`` has the cells' pixels (image_id, y, x, component) and ``classes`` the
    class of each cell that is painted.  Cells paint in the order of their first pixels,
    over background only, and a cell's first pixel paints no neighbours.
    """
    painted = labelled.select(*PIXEL, "component").join(shuffled(classes.select("image_id", "component", "class")), ["image_id", "component"], "left")
    paints = F.col("class").isNotNull() & (F.col("y") * SHIFT + F.col("x") != F.col("component"))

    def run(part: pd.DataFrame, area: Area) -> pd.DataFrame:
        paint = np.flatnonzero(part["paints"].to_numpy())
        codes, names = pd.factorize(part["class"])
        none = np.iinfo(np.int64).max
        first, name = area.dense(part["component"].to_numpy()[paint], none, np.int64, paint), area.dense(codes[paint], -1, np.int64, paint)
        best, chosen = np.full(area.shape, none), np.full(area.shape, -1)
        for dy, dx in FOUR:
            near, near_name = moved(first, dy, dx, none), moved(name, dy, dx, -1)
            chosen = np.where(near < best, near_name, chosen)
            best = np.minimum(best, near)
        y, x = np.nonzero((chosen >= 0) & ~area.dense(True, False, bool) & area.mine & area.inside(height, width))
        return pd.DataFrame({"y": y + area.top, "x": x + area.left, "class": np.asarray(names, dtype=object)[chosen[y, x]]})

    return on_blocks(painted.withColumn("paints", paints), ["image_id"], ["component", "class", "paints"], 1, run, f"y int, x int, class {classes.schema['class'].dataType.simpleString()}")


def dilated(edges: DataFrame, cells: DataFrame, height: int, width: int) -> DataFrame:
    """``edges`` and the background around them, each new pixel of the first edge pixel's class in reading order."""
    taken = edges.select(*PIXEL, "class").unionByName(cells.select(*PIXEL, F.lit(None).cast(edges.schema["class"].dataType).alias("class")))

    def run(part: pd.DataFrame, area: Area) -> pd.DataFrame:
        codes, names = pd.factorize(part["class"])
        edge = np.flatnonzero(codes >= 0)
        name = area.dense(codes[edge], -1, np.int64, edge)
        chosen = np.full(area.shape, -1)
        for dy, dx in sorted(EIGHT):  # in reading order
            chosen = np.where(chosen < 0, moved(name, dy, dx, -1), chosen)
        y, x = np.nonzero((chosen >= 0) & ~area.dense(True, False, bool) & area.mine & area.inside(height, width))
        return pd.DataFrame({"y": y + area.top, "x": x + area.left, "class": np.asarray(names, dtype=object)[chosen[y, x]]})

    return edges.select(*PIXEL, "class").unionByName(on_blocks(taken, ["image_id"], ["class"], 1, run, f"y int, x int, class {edges.schema['class'].dataType.simpleString()}"))


def merged_instances(pix: DataFrame, scores: DataFrame, least: int, tile: int) -> DataFrame:
    """Instances whose pixels touch become one: per merged region its number, area, mean score and members.

    ``pix`` has image_id, y, x, inst; regions under ``least`` pixels are dropped, the
    rest are numbered from 1 in reading order.  An instance without a score counts 0.
    """
    labelled = whole_image_components(pix, tile, carry=["inst"])
    members = labelled.groupBy("image_id", "component", "inst").agg(F.count("*").alias("n"))
    scored = members.join(scores.select("image_id", "inst", "score"), ["image_id", "inst"], "left")
    merged = scored.groupBy("image_id", "component").agg(F.sum("n").alias("area"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.sort_array(F.collect_list("inst")).alias("members")).where(F.col("area") >= least)
    return merged.withColumn("new_id", F.expr("row_number() OVER (PARTITION BY image_id ORDER BY component)"))


def overlap_merged(cells: DataFrame, padding: int, cell: int) -> DataFrame:
    """Cells whose padded boxes overlap become one: box, centre, pixels and members.

    ``cells`` has image_id, id (unique), position (from 1 in its image), n, sum_y,
    sum_x, x1, y1, x2, y2.  Members are positions, not ids.
    """
    padded = cells.withColumns({"x1": F.col("x1") - padding, "y1": F.col("y1") - padding, "x2": F.col("x2") + padding, "y2": F.col("y2") + padding})
    members = grouped(padded, cut(overlapping(padded, cell, ["image_id"]).select("a", "b")))
    whole = members.groupBy("image_id", "grp_id").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("n").alias("pixel_count"),
        (F.sum("sum_y") / F.sum("n")).cast("int").alias("cy"), (F.sum("sum_x") / F.sum("n")).cast("int").alias("cx"), F.sort_array(F.collect_list("position")).alias("members"),
    )
    return whole.withColumn("is_merged", F.size("members") > 1)


def widened_errors(wide: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """Errors (image_id, y, x, missed) of two masks, ``t`` of the truth and ``f`` as found, each widened by a square of ``reach``."""
    def run(part: pd.DataFrame, area: Area) -> pd.DataFrame:
        t, f = (area.dense(part[c].to_numpy().astype(bool), False, bool) for c in ("t", "f"))
        for down in (True, False):
            t, f = (np.logical_or.reduce([moved(m, d * down, d * (not down)) for d in range(-reach, reach + 1)]) for m in (t, f))
        y, x = np.nonzero((t != f) & area.mine & area.inside(height, width))
        return pd.DataFrame({"y": y + area.top, "x": x + area.left, "missed": t[y, x]})

    return on_blocks(wide.where("t OR f"), ["image_id"], ["t", "f"], reach, run, "y int, x int, missed boolean")


def error_centres(errors: DataFrame, keys: DataFrame, height: int, width: int) -> DataFrame:
    """Per key (image_id) the deepest point of its errors: x, y, and whether it was missed (a positive point).

    ``errors`` has image_id, y, x and ``missed`` (of the truth only); the rest are false
    pixels.  Missed pixels win if their depth is strictly greater; without errors it is
    the first pixel, negative.
    """
    found = deepest(errors.select("image_id", "missed", "y", "x"), ["image_id", "missed"], height, width)
    of = lambda missed: F.max(F.when(F.col("missed") == missed, F.struct("depth", "x", "y")))
    both = found.groupBy("image_id").agg(of(True).alias("t"), of(False).alias("f"))
    positive = F.coalesce(F.col("t.depth") > F.coalesce("f.depth", F.lit(0)), F.lit(False))
    at = lambda c: F.coalesce(F.when(F.col("positive"), F.col(f"t.{c}")).otherwise(F.col(f"f.{c}")), F.lit(0)).cast("int").alias(f"p{c}")
    joined = keys.select("image_id").join(both, "image_id", "left").withColumn("positive", positive)
    return joined.select("image_id", at("x"), at("y"), "positive")
