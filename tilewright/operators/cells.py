"""Cells: statistics, classes, scores and exports of labelled pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .regions import tile_regions, merged_regions, seam_pairs


def adjacent_tiles(tiles: DataFrame) -> DataFrame:
    """Each tile with its neighbours that exist: an equi-join in four directions."""
    steps = (("top", -1, 0), ("bottom", 1, 0), ("left", 0, -1), ("right", 0, 1))
    near = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("tile_row") + dr).alias("near_row"), (F.col("tile_col") + dc).alias("near_col")) for s, dr, dc in steps)))
    wanted = tiles.select("image_id", "tile_row", "tile_col", near.alias("n")).select("image_id", "tile_row", "tile_col", "n.*")
    there = tiles.select("image_id", F.col("tile_row").alias("near_row"), F.col("tile_col").alias("near_col"))
    return wanted.join(there, ["image_id", "near_row", "near_col"])


def cell_stats(pix: DataFrame) -> DataFrame:
    """Per component: marker statistics (of r), truncated centroid, class counts and the majority (ties are positive)."""
    positive, negative = F.count_if(F.col("r") >= F.col("b")), F.count_if(F.col("r") < F.col("b"))
    return pix.groupBy("image_id", "component").agg(
        F.count("*").alias("pixel_count"), F.sum("r").alias("sum_marker"), F.avg("r").alias("mean_marker"), F.max("r").alias("max_marker"), F.min("r").alias("min_marker"),
        F.avg("y").cast("int").alias("cy"), F.avg("x").cast("int").alias("cx"), positive.alias("n_positive"), negative.alias("n_negative"), (positive >= negative).alias("is_positive"),
    )


def positive_cells(cells: DataFrame, min_sum: int, min_pixels: int, min_mean: float) -> DataFrame:
    return cells.where(F.col("is_positive") & (F.col("sum_marker") >= min_sum) & (F.col("pixel_count") >= min_pixels) & (F.col("mean_marker") > min_mean))


def grown_cells(pix: DataFrame) -> DataFrame:
    """As ``cell_stats``, with the centroid rounded half to even."""
    return pix.groupBy("image_id", "component").agg(
        F.count("*").alias("pixel_count"), F.count_if(F.col("r") >= F.col("b")).alias("n_positive"), F.count_if(F.col("r") < F.col("b")).alias("n_negative"), F.max("r").alias("max_marker"),
        F.bround(F.avg("y")).cast("int").alias("cy"), F.bround(F.avg("x")).cast("int").alias("cx"),
    )


def final_class(cells: DataFrame, marker_threshold: int | None, low: int, high: int | None) -> DataFrame:
    """Cells within the size band; positive by majority or by a strong marker (255 without a threshold: never)."""
    sized = cells.where((F.col("pixel_count") > low) & (F.lit(True) if high is None else F.col("pixel_count") < high))
    return sized.withColumn("is_positive", (F.col("n_positive") >= F.col("n_negative")) | (F.col("max_marker") > (255 if marker_threshold is None else marker_threshold)))


def score(cells: DataFrame) -> DataFrame:
    n, positive = F.count("*"), F.count_if("is_positive")
    return cells.groupBy("image_id").agg(n.alias("n_total"), positive.alias("n_positive"), F.count_if(~F.col("is_positive")).alias("n_negative"), F.coalesce(F.bround(100.0 * positive / n, 1), F.lit(0.0)).alias("percent_positive"))


def export_rows(cells: DataFrame) -> DataFrame:
    """The columns of the cell table as it is written to CSV, and why the class was chosen."""
    reason = F.when(F.col("n_positive") > F.col("n_negative"), "majority").when(F.col("n_positive") == F.col("n_negative"), "tie").otherwise("minority")
    return cells.select(
        "image_id", F.col("component").alias("Cell_ID"), F.when(F.col("is_positive"), "Yes").otherwise("No").alias("Is_Positive"), F.col("pixel_count").alias("Pixel_Count"), F.col("sum_marker").alias("Marker_Sum"),
        F.format_string("%.2f", F.round("mean_marker", 2)).alias("Marker_Mean"), F.col("max_marker").alias("Marker_Max"), F.col("min_marker").alias("Marker_Min"), F.col("cy").alias("Center_Y"), F.col("cx").alias("Center_X"), reason.alias("decision_reason"),
    )


def flooded_background(pix: DataFrame, side: int, tile: int) -> DataFrame:
    """Pixels without a value, and whether the flood from the image's border reaches them (four neighbours)."""
    images = pix.select("image_id").distinct()
    grid = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))
    holes = cut(tile_regions(grid.join(pix, ["image_id", "y", "x"], "left_anti"), tile, diagonal=False))
    labelled = cut(merged_regions(holes, seam_pairs(holes, tile)))
    last = side - 1
    outer = labelled.where(f"y = 0 OR x = 0 OR y = {last} OR x = {last}").select("image_id", "global_region").distinct().withColumn("outside", F.lit(True))
    return labelled.join(outer, ["image_id", "global_region"], "left").select("image_id", "y", "x", F.coalesce("outside", F.lit(False)).alias("outside"))


def without_small(labelled: DataFrame, most: int) -> DataFrame:
    """Pixels of components with more than ``most`` pixels."""
    large = labelled.groupBy("image_id", "component").count().where(F.col("count") > most).select("image_id", "component")
    return labelled.join(large, ["image_id", "component"], "left_semi")


def islands(labelled: DataFrame, least: int) -> DataFrame:
    """Components of at least ``least`` pixels; where an image has none, its largest (the first of equals)."""
    sized = labelled.groupBy("image_id", "component").agg(F.count("*").alias("area"))
    best = sized.groupBy("image_id").agg(F.max(F.struct("area", (-F.col("component")).alias("first"))).alias("top"))
    joined = sized.join(best, "image_id")
    keep = F.when(F.col("top.area") < least, (F.col("area") == F.col("top.area")) & (F.col("component") == -F.col("top.first"))).otherwise(F.col("area") >= least)
    return joined.where(keep).select("image_id", "component", "area")
