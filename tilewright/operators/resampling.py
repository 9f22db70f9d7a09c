"""Geometric transforms of rasters by an inverse map: where in the source each output pixel lies.

An output pixel is a mean of the source pixels around that place; those are joined by
position, so no image has to be whole in a task.  Absent pixels are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import uniform


def chained(pix: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps one after the other."""
    return reduce(lambda rows, step: step(rows), steps, pix)


def mirrored(pix: DataFrame, width: int) -> DataFrame:
    """Left and right exchanged."""
    return pix.withColumn("x", (width - 1 - F.col("x")).cast("int"))


def normalised(pix: DataFrame, channels: dict[str, tuple[float, float]]) -> DataFrame:
    """Each channel less its mean, over its deviation, of values from 0 to 255 as 0 to 1."""
    return pix.withColumns({c: (F.col(c) / 255 - mean) / deviation for c, (mean, deviation) in channels.items()})


def in_gray(pix: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """All channels as luma."""
    luma = F.col(r) * 0.299 + F.col(g) * 0.587 + F.col(b) * 0.114
    return pix.withColumns({c: luma for c in (r, g, b)})


def jittered(pix: DataFrame, limits: dict[str, float], keys: Sequence[str], seed: int = 0, channels: Sequence[str] = ("r", "g", "b"), decimals: int = 6) -> DataFrame:
    """Brightness, contrast and saturation changed by factors drawn once for each ``keys``, in that order.

    ``limits`` has the most that a factor is from 1; a factor is never below 0.  Contrast is about the
    image's mean luma, saturation about each pixel's.  Values stay from 0 to 255.
    """
    def factor(what: str) -> Column:
        low, high = max(0.0, 1 - limits.get(what, 0.0)), 1 + limits.get(what, 0.0)
        return F.lit(low) + uniform(F.lit(what), *(F.col(k) for k in keys), seed=seed) * (high - low)

    inside = lambda c: F.greatest(F.least(c, F.lit(255.0)), F.lit(0.0))
    luma = lambda: F.col(channels[0]) * LUMA[0] + F.col(channels[1]) * LUMA[1] + F.col(channels[2]) * LUMA[2]
    lit = pix.withColumns({c: inside(F.col(c) * factor("brightness")) for c in channels})
    # one mean an image comes back by a join, so no image is whole in a task
    means = lit.groupBy(F.col("image_id").alias("_image")).agg(F.round(F.avg(luma()), decimals).alias("_mean"))
    met = lit.join(means, F.col("image_id") == F.col("_image")).drop("_image")
    met = met.withColumns({c: inside(F.col("_mean") + (F.col(c) - F.col("_mean")) * factor("contrast")) for c in channels}).drop("_mean")
    met = met.withColumn("_luma", luma())
    return met.withColumns({c: F.round(inside(F.col("_luma") + (F.col(c) - F.col("_luma")) * factor("saturation")), decimals) for c in channels}).drop("_luma")


def coloured(pix: DataFrame, matrix: dict[str, tuple[float, float, float]], r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Channels as weighted sums of the three, cut off to whole numbers from 0 to 255."""
    value = lambda w: F.least(F.greatest(F.floor(F.round(F.col(r) * w[0] + F.col(g) * w[1] + F.col(b) * w[2] + 0.5, 9)), F.lit(0)), F.lit(255)).cast("int")
    return pix.withColumns({c: value(w) for c, w in matrix.items()})


#: The luma weights, and which channels the two stains show.
LUMA, NONE = (0.299, 0.587, 0.114), (0.0, 0.0, 0.0)
NUCLEI, MARKER = {"r": NONE, "g": LUMA, "b": LUMA}, {"r": LUMA, "g": LUMA, "b": NONE}


def inverse_affine(angle: float, translate: tuple[float, float], scale: float, shear: tuple[float, float], height: int, width: int) -> tuple[float, ...]:
    """The map (a, b, c, d, e, f) from an output place to the source: x' = a x + b y + c, y' = d x + e y + f.

    The source is sheared, turned by ``angle`` degrees and scaled about its middle, then moved; places are centres of pixels.
    """
    turn, sx, sy = (math.radians(v) for v in (angle, *shear))
    a, b = math.cos(turn - sy) / math.cos(sy), -math.cos(turn - sy) * math.tan(sx) / math.cos(sy) - math.sin(turn)
    c, d = math.sin(turn - sy) / math.cos(sy), -math.sin(turn - sy) * math.tan(sx) / math.cos(sy) + math.cos(turn)
    m = [d / scale, -b / scale, -c / scale, a / scale]  # the inverse of a turn and shear has determinant 1
    cx, cy = (width - 1) / 2, (height - 1) / 2
    x0, y0 = cx + translate[0], cy + translate[1]
    return m[0], m[1], cx - m[0] * x0 - m[1] * y0, m[2], m[3], cy - m[2] * x0 - m[3] * y0


def _sampled(pix: DataFrame, channels: Sequence[str], size: tuple[int, int], source: tuple[int, int], sx: Column, sy: Column, how: str, clamp: bool, decimals: int) -> DataFrame:
    # the map is the same for all images, so it is one table of the size of an image; its rows are known to Spark, which
    # broadcasts it or not.  Source pixels go to the output pixels that see them: no image is laid out as a grid of its own.
    along = lambda n, c: pix.sparkSession.range(n).select(F.col("id").cast("int").alias(c))
    at = along(size[0], "y").crossJoin(along(size[1], "x")).select("y", "x", F.round(sx, 9).alias("sx"), F.round(sy, 9).alias("sy"))
    if how == "nearest":
        # halves go to the even pixel
        taps = F.array(F.struct(F.bround("sy", 0).cast("int").alias("py"), F.bround("sx", 0).cast("int").alias("px"), F.lit(1.0).alias("w")))
    else:
        fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
        taps = F.array(*(F.struct((F.floor("sy") + dy).cast("int").alias("py"), (F.floor("sx") + dx).cast("int").alias("px"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)))
    each = at.select("y", "x", F.explode(taps).alias("t")).where("t.w > 0")
    if clamp:  # the border goes on beyond the image
        inside = lambda c, n: F.greatest(F.least(F.col(c), F.lit(n - 1)), F.lit(0))
        each = each.select("y", "x", inside("t.py", source[0]).alias("py"), inside("t.px", source[1]).alias("px"), "t.w")
    else:
        each = each.select("y", "x", "t.py", "t.px", "t.w").where(F.col("py").between(0, source[0] - 1) & F.col("px").between(0, source[1] - 1))
    there = pix.select("image_id", F.col("y").alias("iy"), F.col("x").alias("ix"), *channels)
    met = there.join(each, (F.col("py") == F.col("iy")) & (F.col("px") == F.col("ix")))
    return met.groupBy("image_id", "y", "x").agg(*(F.round(F.sum(F.col("w") * F.col(c)), decimals).alias(c) for c in channels))


def affine(pix: DataFrame, channels: Sequence[str], height: int, width: int, inverse: tuple[float, ...], how: str = "linear", decimals: int = 6) -> DataFrame:
    """Rasters (image_id, y, x, channels) under a map from ``inverse_affine``: by the nearest pixel (masks), or linearly from up to four.

    Places outside the source are 0; output pixels that see no source pixel are absent.
    """
    a, b, c, d, e, f = (F.lit(v) for v in inverse)
    x, y = F.col("x"), F.col("y")
    return _sampled(pix, channels, (height, width), (height, width), a * x + b * y + c, d * x + e * y + f, how, False, decimals)


def resized(pix: DataFrame, channels: Sequence[str], source: tuple[int, int], size: tuple[int, int], decimals: int = 6) -> DataFrame:
    """Rasters of ``source`` height and width as ``size``, linearly between pixel centres; at borders the outer pixel counts on."""
    place = lambda c, s, t: (F.col(c) + 0.5) * (s / t) - 0.5
    return _sampled(pix, channels, size, source, place("x", source[1], size[1]), place("y", source[0], size[0]), "linear", True, decimals)
