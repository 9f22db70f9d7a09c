"""Scores of predicted object masks against the truth over the frames of videos."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import masks
from .graph import cut

OF = ["video", "frame", "object"]


def matched_frames(truth: DataFrame, found: DataFrame) -> DataFrame:
    """The truth's frames (video, frame, height, width), each of which must have a prediction of its size.

    A frame without one, or of another size, is an error; further predictions are ignored.
    """
    other = found.select("video", "frame", F.col("height").alias("_h"), F.col("width").alias("_w")).distinct()
    where = F.concat_ws(" ", "video", "frame")
    checked = F.when(F.col("_h").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), where)).cast("int"))
    checked = checked.when((F.col("_h") != F.col("height")) | (F.col("_w") != F.col("width")), F.raise_error(F.concat(F.lit("sizes differ in "), where)).cast("int"))
    return truth.join(other, ["video", "frame"], "left").select("video", "frame", F.coalesce(checked, "height").alias("height"), "width")


def object_frames(truth: DataFrame, found: DataFrame, frames: DataFrame) -> DataFrame:
    """The samples: for each object of the truth, every frame from the first on where either side has it."""
    seen = truth.select("video", "object", "frame", F.lit(True).alias("real")).unionByName(found.select("video", "object", "frame", F.lit(False).alias("real")))
    first = seen.groupBy("video", "object").agg(F.min("frame").alias("first"), F.bool_or("real").alias("real")).where("real")
    return frames.select("video", "frame").join(first, "video").where("frame >= first").select(*OF)


def object_scores(truth: DataFrame, found: DataFrame, frames: DataFrame, height: int, width: int, share: float = 0.008) -> DataFrame:
    """Per video and object of the truth: mean overlap (j) and boundary measure (f) over its frames, times 100.

    ``truth`` and ``found`` are pixels (video, frame, object, y, x); ``frames`` all of
    the truth's frames.  Boundaries match within ``share`` of the image's diagonal.
    """
    keys = cut(object_frames(truth, found, frames))
    found = found.join(keys.select("video", "object").distinct(), ["video", "object"], "left_semi")
    overlap = masks.overlap(truth, found, keys, OF).select(*OF, "iou_empty_one")
    edges = masks.boundary_score(truth, found, keys, OF, height, width, math.ceil(share * math.hypot(height, width))).select(*OF, "f")
    both = overlap.join(edges, OF)
    return both.groupBy("video", "object").agg((100 * F.avg("iou_empty_one")).alias("j"), (100 * F.avg("f")).alias("f"))


def report(scores: DataFrame) -> DataFrame:
    """The global row, over objects of all videos, and one row for each video and object: sequence, obj, jf, j, f."""
    one = lambda c: F.round(c, 6)
    jf = (F.col("j") + F.col("f")) / 2 + 1e-9  # halves of the last place go up, whatever the order of the sums
    detail = scores.select(F.col("video").cast("string").alias("sequence"), F.lpad(F.col("object").cast("string"), 3, "0").alias("obj"), one(jf).alias("jf"), one("j").alias("j"), one("f").alias("f"))
    whole = scores.agg(F.avg("j").alias("j"), F.avg("f").alias("f")).select(F.lit("Global score").alias("sequence"), F.lit("").alias("obj"), one(jf).alias("jf"), one("j").alias("j"), one("f").alias("f"))
    return whole.unionByName(detail)


def report_lines(rows: DataFrame) -> DataFrame:
    """The report as text: ``at`` (the line's order) and ``line``, with the sequences padded to one width."""
    width = rows.agg(F.greatest(F.max(F.length("sequence")), F.lit(len("Global score"))).alias("_n"))
    named = rows.crossJoin(F.broadcast(width))  # one row
    first = F.col("sequence") == "Global score"
    number = lambda c: F.when(first, F.format_string("%.1f", F.round(c, 1))).otherwise(F.format_string("%4.1f", F.round(c, 1)))
    line = F.concat(F.rpad("sequence", F.col("_n"), " "), F.lit(","), F.when(first, "   ").otherwise(F.col("obj")), F.lit(", "), number("jf"), F.lit(", "), number("j"), F.lit(", "), number("f"))
    head = width.select(F.lit("").alias("at"), F.concat(F.rpad(F.lit("sequence"), F.col("_n"), " "), F.lit(",obj,  J&F,    J,    F")).alias("line"))
    return head.unionByName(named.select(F.when(first, " ").otherwise(F.concat("sequence", F.lit("/"), "obj")).alias("at"), line.alias("line")))


def write_report(rows: DataFrame, path: str) -> None:
    """Writes the lines in order, as text."""
    report_lines(rows).orderBy("at").select("line").write.mode("overwrite").text(path)
