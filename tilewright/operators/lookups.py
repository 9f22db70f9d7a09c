"""Lookups, memberships, losses and layouts: keyed joins and sums over rows and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_best


def memberships(labels: DataFrame, others: DataFrame, pixel: list[str]) -> DataFrame:
    """Per label the other labels on its pixels: the least, all of them in order, and the shared pixels."""
    both = labels.join(others, pixel)
    return both.groupBy("image_id", "label").agg(F.min("other").alias("least"), F.array_join(F.transform(F.sort_array(F.collect_set("other")), lambda c: c.cast("string")), ";").alias("members"), F.count("*").alias("shared"))


def merged_cells(groups: DataFrame, members: DataFrame, scores: DataFrame) -> DataFrame:
    """Per group what its member cells give; a group without members gets a placeholder.

    The mean is that of the members' means, whatever their sizes; the centre is
    the first member's; a member without a score counts 0.
    """
    scored = members.join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    sums = scored.groupBy("grp").agg(
        F.bool_or("is_positive").alias("is_positive"), F.sum("marker").alias("marker"), F.round(F.avg("mean"), 6).alias("mean"), F.max("mean").alias("most"), F.min("mean").alias("least"),
        F.min_by("centre", "id").alias("centre"), F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n"),
    )
    zero = {"marker": 0, "mean": 0.0, "most": 0, "least": 0, "centre": 0, "score": 0.0, "n": 0}
    return groups.join(sums, "grp", "left").na.fill(zero).na.fill({"is_positive": False})


def compatible(one: DataFrame, two: DataFrame, on: str) -> DataFrame:
    """Pairs of configurations (a, b) with a common member; an equi-join on the member, so no other pairs arise."""
    return one.join(two, on).select("a", "b", on).distinct().groupBy("a", "b").agg(F.count("*").alias("n_common"), F.min(on).alias("first_common"))


def fanned_back(rows: DataFrame, key: str, result: Column, name: str) -> DataFrame:
    """A result computed once for each distinct key, joined back to all rows."""
    return rows.join(rows.select(key).distinct().withColumn(name, result), key)


def pointers(frames: DataFrame, present: DataFrame, most: int) -> DataFrame:
    """For each frame those of the ``most - 1`` frames before it that are present."""
    wanted = frames.select("video", "frame", F.explode(F.array(*(F.lit(k) for k in range(1, most)))).alias("gap")).withColumn("memory", F.col("frame") - F.col("gap")).where("memory >= 0")
    return wanted.join(present.select("video", F.col("frame").alias("memory")), ["video", "memory"]).select("video", "frame", "memory", "gap")


def dynamic_choice(cands: DataFrame, by: list[str], least: float) -> DataFrame:
    """Candidate 0 where it is stable enough or alone, else the best of the others."""
    place = F.when((F.col("cand") == 0) & (F.col("stability") >= least), 0).when(F.col("cand") > 0, 1).otherwise(2)
    return first_best(cands.withColumn("_tier", place), by, "_tier, score DESC, cand").drop("_tier")


def losses(values: DataFrame, of: list[str]) -> DataFrame:
    """Dice and focal loss (alpha 0.25, gamma 2) of probabilities ``p`` against truths ``t`` (0 or 1)."""
    p, t = F.col("p"), F.col("t")
    right = F.when(t == 1, p).otherwise(1 - p)
    focal = F.when(t == 1, 0.25).otherwise(0.75) * (1 - right) * (1 - right) * -F.log(right)
    dice = 1 - (2 * F.sum(p * t) + 1) / (F.sum(p) + F.sum(t) + 1)
    return values.groupBy(*of).agg(F.round(dice, 6).alias("dice"), F.round(F.avg(focal), 6).alias("focal"))


def candidate_losses(values: DataFrame, ious: DataFrame, of: list[str], weights: dict[str, float]) -> DataFrame:
    """Of several predictions of a mask (``candidate``) the one whose weighted focal and dice loss is least, the first on ties.

    ``values`` are probabilities ``p`` and truths ``t`` of pixels, ``ious`` what each candidate says its overlap
    is (iou); that loss is the squared error against the overlap at one half.  Losses of an object that the truth does
    not have are 0; ``loss`` is the sum by ``weights`` (mask, dice, iou).
    """
    p, t = F.col("p"), F.col("t")
    right = F.when(t == 1, p).otherwise(1 - p)
    focal = F.when(t == 1, 0.25).otherwise(0.75) * (1 - right) * (1 - right) * -F.log(right)
    seen = F.count_if((p > 0.5) & (t == 1)) / F.greatest(F.count_if((p > 0.5) | (t == 1)), F.lit(1))
    each = values.groupBy(*of, "candidate").agg(F.max("t").alias("target"), F.avg(focal).alias("mask"), (1 - (2 * F.sum(p * t) + 1) / (F.sum(p) + F.sum(t) + 1)).alias("dice"), seen.alias("seen"))
    each = each.join(ious.select(*of, "candidate", F.col("iou").alias("said")), [*of, "candidate"])
    each = each.withColumns({"iou": (F.col("said") - F.col("seen")) * (F.col("said") - F.col("seen")), "combined": F.round(F.col("mask") * weights["mask"] + F.col("dice") * weights["dice"], 9)})
    best = first_best(each, of, "combined, candidate")
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return best.select(*of, "candidate", *(F.round(F.col(c) * F.col("target"), 6).alias(f"loss_{c}") for c in ("mask", "dice", "iou")), F.round(total * F.col("target"), 6).alias("loss"))


def errors(values: DataFrame, of: list[str]) -> DataFrame:
    """False positives and negatives, and whether all is right."""
    return values.groupBy(*of).agg(F.count_if(F.col("found") & ~F.col("truth")).alias("n_fp"), F.count_if(~F.col("found") & F.col("truth")).alias("n_fn"), F.bool_and(F.col("found") == F.col("truth")).alias("all_right"))


def masklets(frames: DataFrame, of: list[str]) -> DataFrame:
    """Per track: mean area where visible, its size class, first visible frame, frames, and changes of visibility."""
    keys = ", ".join(of)
    rows = frames.withColumn("_before", F.expr(f"lag(area > 0) OVER (PARTITION BY {keys} ORDER BY frame)"))
    seen = F.when(F.col("area") > 0, F.col("area"))
    out = rows.groupBy(*of).agg(F.avg(seen).alias("mean_area"), F.min(F.when(F.col("area") > 0, F.col("frame"))).alias("first_frame"), F.count("*").alias("n_frames"), F.count_if(F.col("_before") != (F.col("area") > 0)).alias("changes"))
    size = F.when(F.col("mean_area") < 32**2, "small").when(F.col("mean_area") < 96**2, "medium").when(F.col("mean_area").isNotNull(), "large")
    return out.select(*of, F.round("mean_area", 6).alias("mean_area"), size.alias("size"), "first_frame", "n_frames", "changes")


def crop_pyramid(images: DataFrame, layers: int, ratio: float) -> DataFrame:
    """Crops of each image (w, h): 4**layer overlapping boxes a layer, each cut at the image's end."""
    short = F.least("w", "h")
    rows = images.select("*", F.explode(F.array(*(F.lit(k) for k in range(layers + 1)))).alias("layer")).withColumn("side", F.expr("CAST(1 << layer AS INT)"))
    overlap = F.when(F.col("layer") == 0, 0).otherwise((F.lit(ratio) * short * 2 / F.col("side")).cast("int"))
    rows = rows.withColumn("overlap", overlap)
    for c in ("w", "h"):
        rows = rows.withColumn(f"crop_{c}", F.ceil((F.col("overlap") * (F.col("side") - 1) + F.col(c)) / F.col("side")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("j"))
    x, y = (F.col("crop_w") - F.col("overlap")) * F.col("i"), (F.col("crop_h") - F.col("overlap")) * F.col("j")
    return rows.select(*images.columns, "layer", x.alias("x1"), y.alias("y1"), F.least(x + F.col("crop_w"), F.col("w")).alias("x2"), F.least(y + F.col("crop_h"), F.col("h")).alias("y2"))


def overridden(defaults: Column, given: Column) -> Column:
    """The maps' entries together; given ones override defaults."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)


def partition_errors(groups: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Keys that are in no group or in several: ``key`` and the number of groups."""
    n = groups.select(key, "grp").distinct().groupBy(key).agg(F.count("*").alias("n_groups"))
    return every.select(key).distinct().join(n, key, "left").na.fill(0, ["n_groups"]).where("n_groups <> 1")
