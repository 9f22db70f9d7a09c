"""Pixel classes, thresholds, histograms and scalings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_foreground(threshold: int, r="r", g="g", b="b") -> Column:
    return (F.col(r) + F.col(b) > threshold) & (F.col(g) <= 80)


def pixel_class(threshold: int, positive: int = 2, negative: int = 1) -> Column:
    """``positive`` where r >= b, ``negative`` where r < b, 0 in the background."""
    return F.when(is_foreground(threshold), F.when(F.col("r") >= F.col("b"), positive).otherwise(negative)).otherwise(0)


def is_red(r="r", g="g", b="b") -> Column:
    return (F.col(r) > 150) & (F.col(g) < 100) & (F.col(b) < 100)


def luma() -> Column:
    return F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int")


def brightest() -> Column:
    return F.greatest("r", "g", "b")


def empty_tiles(tiles: DataFrame, by: list[str], value: str = "v", least: float = 9.0) -> DataFrame:
    """Population variance of the values other than 0 and 255; a tile below ``least`` is empty."""
    inner = F.when((F.col(value) != 0) & (F.col(value) != 255), F.col(value))
    variance = F.coalesce(F.var_pop(inner), F.lit(0.0))
    return tiles.groupBy(*by).agg(F.round(variance, 6).alias("variance"), (variance < least).alias("is_empty"))


def marker_threshold(values: DataFrame, by: list[str], value: str = "v", share: float = 0.9, without: int = 128) -> DataFrame:
    """Between the 0.1 and the 99.9 percentile of values over 0, truncated; ``without`` where there is none."""
    over = F.when(F.col(value) > 0, F.col(value))
    low, high = F.percentile(over, 0.001), F.percentile(over, 0.999)
    return values.groupBy(*by).agg(F.coalesce(F.round((high - low) * share + low, 6).cast("int"), F.lit(without)).alias("threshold"))


def histogram(values: DataFrame, by: list[str], value: str = "v", bins: int = 256) -> DataFrame:
    """Counts for every bin, and scaled by the largest count of bins from 1 on."""
    counted = values.groupBy(*by, F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    grid = values.select(*by).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    top = full.where("bin >= 1").groupBy(*by).agg(F.max("n").alias("top"))
    return full.join(top, by).select(*by, "bin", "n", F.when(F.col("top") > 0, F.round(F.col("n") / F.col("top"), 6)).otherwise(0.0).alias("scaled"))


def gamma(values: DataFrame, by: list[str], power: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``((v - min) / (max - min)) ** power`` scaled to [low, high]; unchanged where all values are equal."""
    ends = values.groupBy(*by).agg(F.min("v").alias("a"), F.max("v").alias("z"))
    scaled = F.pow((F.col("v") - F.col("a")) / (F.col("z") - F.col("a")), power) * (high - low) + low
    return values.join(ends, by).withColumn("v", F.when(F.col("a") == F.col("z"), F.col("v").cast("double")).otherwise(scaled)).drop("a", "z")


def weighted_stack(planes: Column, weights: list[float]) -> Column:
    """Sum of an array's values times the weights of their positions; null values keep their position and add nothing."""
    parts = F.filter(F.transform(planes, lambda v, i: v * F.get(F.array(*map(F.lit, weights)), i)), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.round(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), 6))


def weighted_planes(planes: DataFrame, weights: list[float], keys: list[str]) -> DataFrame:
    """Sum of the planes' values times the weights of their positions; missing planes shift the weights."""
    stacked = planes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("plane", "v"))).alias("p"))
    return stacked.select(*keys, weighted_stack(F.transform("p", lambda p: p["v"]), weights).alias("v"))


def score_to_byte(score: Column) -> Column:
    """[-1, 1] to 0..255, truncated."""
    return ((score + 1) / 2 * 255).cast("int")


def multiple_of_four(size: Column) -> Column:
    return (F.bround(size / 4) * 4).cast("int")


def resolution_noise(resolution: Column) -> Column:
    """The size threshold of each magnification."""
    return F.when(resolution == "10x", 1000).when(resolution == "20x", 4000).when(resolution == "40x", 16000)


def threshold_argument(text: Column, default: int) -> Column:
    """'none' is null, 'default' and what is no number are the default, else the number."""
    return F.when(F.lower(text) == "none", F.lit(None).cast("int")).when(F.lower(text) == "default", default).otherwise(F.coalesce(text.try_cast("int"), F.lit(default)))


def near_crop_edge(box: list[str], crop: list[int], image: list[int], within: int = 20) -> Column:
    """Whether a box ends at an edge of the crop that is no edge of the image."""
    out = F.lit(False)
    for c, edge, far in zip(box, crop, image):
        out = out | ((F.abs(F.col(c) - edge) <= within) & ~(F.abs(F.col(c) - far) <= within))
    return out


def fit_within(width: Column, height: Column, size: int, largest: int | None) -> tuple[Column, Column]:
    """Width and height with the shorter side ``size`` and the longer at most ``largest``."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    side = F.lit(size) if largest is None else F.when(long_ / short * size > largest, F.bround(largest * short / long_).cast("int")).otherwise(size)
    return (
        F.when(width < height, side).otherwise((side * width / height).cast("int")),
        F.when(width < height, (side * height / width).cast("int")).otherwise(side),
    )


def size_threshold(cells: DataFrame, by: list[str], allowed: tuple[int, int, int] = (4, 7, 10), count: int = 500) -> DataFrame:
    """The cell size below the first dip in the density of the sizes' square roots (column size).

    The density is taken at ``count`` points from 0 on.  The root is at least the first
    of ``allowed``, and the second where it is over the third.  With one cell or none it is 0.
    """
    root = F.sqrt("size")
    sizes = cells.groupBy(*by, root.alias("root")).agg(F.count("*").alias("n"))
    ends = sizes.groupBy(*by).agg(F.sum("n").alias("total"), ((F.max("root") + 1) / count).alias("step"))
    points = sizes.join(ends, by).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    gap = F.col("i") * F.col("step") - F.col("root")
    density = points.groupBy(*by, "i", "step", "total").agg(F.round(F.sum(F.col("n") * F.exp(-gap * gap / 2)) / F.first("total"), 9).alias("d"))
    keys = ", ".join(by)
    around = density.withColumn("_a", F.expr(f"lag(d) OVER (PARTITION BY {keys} ORDER BY i)")).withColumn("_z", F.expr(f"lead(d) OVER (PARTITION BY {keys} ORDER BY i)"))
    first = around.groupBy(*by, "step", "total").agg(F.coalesce(F.min(F.when((F.col("d") < F.col("_a")) & (F.col("d") < F.col("_z")), F.col("i"))), F.lit(1)).alias("i"))
    at = (F.col("i") - 1) * F.col("step")
    root_ = F.when(at < allowed[0], float(allowed[0])).when(at > allowed[2], float(allowed[1])).otherwise(at)
    return first.select(*by, F.when(F.col("total") > 1, F.bround(root_ * root_).cast("long")).otherwise(F.lit(0)).alias("threshold"))


def prompt_logits(points: DataFrame, by: list[str], height: int, width: int, cell: int, strong: float = 5.0) -> DataFrame:
    """Prompts as a coarse raster: ``strong`` on points, its negative elsewhere, averaged over cells of ``cell`` pixels a side.

    Points outside the image don't count; every cell of the image has a row.
    """
    inside = points.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*by, "y", "x").distinct()
    counts = inside.groupBy(*by, F.floor(F.col("y") / cell).cast("int").alias("y"), F.floor(F.col("x") / cell).cast("int").alias("x")).agg(F.count("*").alias("n"))
    rows = points.select(*by).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height // cell - 1))))
    grid = rows.select(*by, "y", F.explode(F.sequence(F.lit(0), F.lit(width // cell - 1))).alias("x"))
    return grid.join(counts, [*by, "y", "x"], "left").select(*by, "y", "x", (strong * (2 * F.coalesce("n", F.lit(0)) / float(cell * cell) - 1)).alias("v"))
