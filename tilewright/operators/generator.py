"""What an automatic mask generator does to its masks: quality filters, crops, clean-up; and outputs that lose their prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import islands
from .geometry import suppress
from .graph import cut
from .regions import whole_image_components
from .repairs import holes
from .sampling import uniform


def good_masks(masks: DataFrame, least_iou: float, least_stability: float) -> DataFrame:
    """Masks whose predicted overlap exceeds the one bound and whose stability reaches the other; a bound of 0 (or less) asks for nothing."""
    out = masks
    if least_iou > 0:
        out = out.where(F.col("predicted_iou") > least_iou)
    if least_stability > 0:
        out = out.where(F.col("stability") >= least_stability)
    return out


def uncropped(rows: DataFrame, xs: list[str], ys: list[str], left: str = "crop_x", top: str = "crop_y") -> DataFrame:
    """Boxes, points or pixels of a crop as they lie in the image: all columns of x and of y are moved by the crop's origin."""
    return rows.withColumns({**{c: F.col(c) + F.col(left) for c in xs}, **{c: F.col(c) + F.col(top) for c in ys}})


def model_coordinates(x: Column, y: Column, resolution: int, size: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """Coordinates as a model of this resolution takes them: shares of the image, or pixels of an image of ``size`` (height, width), times the resolution."""
    if size is not None:
        x, y = x / size[1], y / size[0]
    return x * resolution, y * resolution


def image_coordinates(x: Column, y: Column, resolution: int, size: tuple[Column, Column]) -> tuple[Column, Column]:
    """The way back: pixels of an image of ``size`` (height, width)."""
    return x / resolution * size[1], y / resolution * size[0]


def cleaned(pix: DataFrame, height: int, width: int, least: int, overlap: float, tile: int) -> DataFrame:
    """Masks without small holes and islands, and without duplicates that this leaves: mask, grp, y, x, unchanged.

    ``pix`` has grp, mask (unique over all groups), y, x.  Background parts of fewer than ``least``
    pixels are filled, then parts of fewer are dropped (where all are, the largest stays).  Of boxes in a
    group that overlap by more than ``overlap`` one stays: masks that needed no change come first, then smaller numbers.
    """
    own = cut(pix.select(F.col("mask").alias("image_id"), "y", "x", "grp"))
    groups = own.groupBy("image_id").agg(F.min("grp").alias("grp"))
    filled = cut(holes(own, height, width, least - 1, tile))
    whole = cut(whole_image_components(own.select("image_id", "y", "x").unionByName(filled.select("image_id", "y", "x")), tile))
    kept = islands(whole, least)
    small = whole.groupBy("image_id", "component").count().where(F.col("count") < least).select("image_id").distinct()
    changed = filled.select("image_id").unionByName(small).distinct().withColumn("changed", F.lit(True))
    masks = cut(whole.join(kept.select("image_id", "component"), ["image_id", "component"]).select("image_id", "y", "x"))
    boxes = masks.groupBy("image_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    scored = cut(boxes.join(changed, "image_id", "left").join(groups, "image_id").select(F.col("image_id").alias("id"), "grp", "x1", "y1", "x2", "y2", F.when(F.col("changed"), 0.0).otherwise(1.0).alias("score")))
    stay = suppress(scored, "grp", overlap).select("id").join(scored.select("id", "grp", "score"), "id")
    return masks.join(stay, F.col("image_id") == F.col("id")).select(F.col("id").alias("mask"), "grp", "y", "x", (F.col("score") > 0).alias("unchanged"))


def concatenated(parts: list[tuple[DataFrame, float]], key: str, seed: int = 0) -> DataFrame:
    """The rows of all parts, each part's rows as often as its factor says, with ``part`` and ``copy`` (from 1).

    A fraction is rounded for each row by a seeded draw on its key.
    """
    out = None
    for number, (rows, factor) in enumerate(parts):
        whole = int(factor)
        n = F.lit(whole) + (uniform(F.lit(number), F.col(key), seed=seed) < factor - whole).cast("int")
        copies = rows.withColumn("part", F.lit(number)).withColumn("n_", n).where("n_ > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_")))).drop("n_")
        out = copies if out is None else out.unionByName(copies)
    return out


def unprompted(outputs: DataFrame, cleared: DataFrame) -> DataFrame:
    """Outputs (session, obj, frame, is_prompted, ...) after the prompts of some frames (session, obj, frame) are cleared.

    The prompted output of a cleared frame becomes one that is not, in place of such a one.
    """
    key = ["session", "obj", "frame"]
    hit = outputs.where("is_prompted").join(cleared.select(*key).distinct(), key, "left_semi").select(*key)
    marked = outputs.join(hit.withColumn("hit", F.lit(True)), key, "left")
    return marked.where("hit IS NULL OR is_prompted").withColumn("is_prompted", F.col("is_prompted") & F.col("hit").isNull()).drop("hit")
