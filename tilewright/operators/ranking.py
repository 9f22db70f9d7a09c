"""Choosing, painting and looking back: ranking and windows over keyed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], order: str, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.expr(f"row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY {order})"))


def first_best(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each key in ``order`` (which should break all ties)."""
    return ranked(df, by, order, "_place").where("_place = 1").drop("_place")


def composite_choice(cands: DataFrame, by: list[str]) -> DataFrame:
    """Candidates weighted by their area's ratio; ratios outside [0.3, 10] count -1, and keys whose best is below -0.5 give none."""
    r = F.col("ratio")
    value = F.when((r < 0.3) | (r > 10), F.lit(-1.0)).otherwise(F.col("score") - 0.3 * F.abs(F.log(r / 1.5)))
    scored = cands.withColumn("value", F.round(value, 6))
    return first_best(scored, by, "value DESC, cand").where("value >= -0.5")


def paint(layers: DataFrame, pixel: list[str]) -> DataFrame:
    """Each pixel takes the first layer of those with the greatest score over 0."""
    return first_best(layers.where("score > 0"), pixel, "score DESC, layer")


def clamp_losers(scores: DataFrame, pixel: list[str], most: float = -10.0) -> DataFrame:
    """Per pixel, all but the best object's score are at most ``most``; single objects stay as they are."""
    keys = ", ".join(pixel)
    out = ranked(scores, pixel, "score DESC, object").withColumn("n", F.expr(f"count(*) OVER (PARTITION BY {keys})"))
    return out.withColumn("score", F.when((F.col("n") > 1) & (F.col("place") > 1), F.least(F.col("score"), F.lit(most))).otherwise(F.col("score"))).drop("place", "n")


def seen_so_far(frames: DataFrame, video: str = "video") -> DataFrame:
    """A row per frame and object for all objects seen up to that frame."""
    first = frames.groupBy(video, "object").agg(F.min("frame").alias("first_frame"))
    every = frames.select(video, "frame").distinct()
    return every.join(first, video).where("first_frame <= frame").select(video, "frame", "object")


def without_ends(frames: DataFrame, by: list[str]) -> DataFrame:
    """Each sequence without its first and last row."""
    keys = ", ".join(by)
    return frames.withColumn("_a", F.expr(f"min(frame) OVER (PARTITION BY {keys})")).withColumn("_z", F.expr(f"max(frame) OVER (PARTITION BY {keys})")).where("frame > _a AND frame < _z").drop("_a", "_z")


def look_back(frames: DataFrame, n: int, stride: int, reverse: bool = False) -> DataFrame:
    """For each frame the memory frames that exist: the last one, and ``n - 2`` at multiples of ``stride`` before it.

    With ``reverse`` frames are tracked from the last to the first, and the memory lies after them.
    """
    if reverse:
        place = lambda k: F.col("frame") + 1 if k == 1 else F.ceil((F.col("frame") + 2) / stride) * stride + (k - 2) * stride
    else:
        place = lambda k: F.col("frame") - 1 if k == 1 else F.floor((F.col("frame") - 2) / stride) * stride - (k - 2) * stride
    offsets = F.explode(F.array(*(F.struct(F.lit(k).alias("pos"), place(k).alias("memory")) for k in range(1, n))))
    wanted = frames.select("video", "frame", offsets.alias("m")).select("video", "frame", "m.*")
    there = frames.select("video", F.col("frame").alias("memory"), F.col("value").alias("memory_value"))
    return wanted.where("memory >= 0").join(there, ["video", "memory"])


def nearest_frames(frames: DataFrame, marked: DataFrame, k: int) -> DataFrame:
    """For each frame the marked frames: the closest before, the closest from it on, then by distance up to ``k``."""
    # Only the ``k`` marks on either side count: they are found by their number in the video, not by pairing all.
    marks = ranked(marked.select("video", F.col("frame").alias("mark")), ["video"], "mark", "nth")
    line = frames.select("video", "frame", F.lit(0).alias("is_mark")).unionByName(marked.select("video", "frame", F.lit(1).alias("is_mark")))
    n_before = F.expr("coalesce(sum(is_mark) OVER (PARTITION BY video ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    placed = line.withColumn("n_before", n_before).where("is_mark = 0")
    pairs = placed.select("video", "frame", F.explode(F.sequence(F.col("n_before") - (k - 1), F.col("n_before") + k)).alias("nth")).join(marks, ["video", "nth"]).drop("nth")
    pairs = pairs.withColumn("before", F.col("mark") < F.col("frame"))
    side = ranked(pairs, ["video", "frame", "before"], "abs(mark - frame), mark", "side_place")
    tier = F.when(F.col("side_place") == 1, F.when(F.col("before"), 0).otherwise(1)).otherwise(2)
    out = ranked(side.withColumn("tier", tier), ["video", "frame"], "tier, abs(mark - frame), mark")
    return out.where(F.col("place") <= k).select("video", "frame", "mark", "place")


def islands(frames: DataFrame, by: list[str], on: Column) -> DataFrame:
    """Runs of frames where ``on`` holds.

    A run's width includes the frame that closes it; a run that begins on the
    sequence's last frame is left out, and one that lasts to the end closes there.
    """
    keys = ", ".join(by)
    rows = frames.select(*by, "frame", on.alias("on")).withColumn("island", F.expr(f"sum(CASE WHEN on THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY frame)")).withColumn("final", F.expr(f"max(frame) OVER (PARTITION BY {keys})"))
    runs = rows.where("on").groupBy(*by, "island", "final").agg(F.min("frame").alias("start"), F.max("frame").alias("last"))
    return runs.where("start < final").select(*by, "start", F.least(F.col("last") + 1, F.col("final")).alias("end"), (F.least(F.col("last") + 1, F.col("final")) - F.col("start")).alias("width"))


def local_minima(series: DataFrame, by: list[str]) -> DataFrame:
    keys = ", ".join(by)
    return series.withColumn("_a", F.expr(f"lag(value) OVER (PARTITION BY {keys} ORDER BY frame)")).withColumn("_z", F.expr(f"lead(value) OVER (PARTITION BY {keys} ORDER BY frame)")).where("value < _a AND value < _z").drop("_a", "_z")


def best_so_far(series: DataFrame, by: list[str]) -> DataFrame:
    return series.withColumn("best", F.expr(f"max(value) OVER (PARTITION BY {', '.join(by)} ORDER BY frame)"))


def away_from_events(frames: DataFrame, events: DataFrame, radius: int) -> DataFrame:
    """Frames more than ``radius`` away from every event of the video."""
    near = events.select("video", F.explode(F.sequence(F.col("frame") - radius, F.col("frame") + radius)).alias("frame")).distinct()
    return frames.join(near, ["video", "frame"], "left_anti")


def fallback(keys: DataFrame, sources: list[DataFrame], on: list[str]) -> DataFrame:
    """The value of the first source that has the key, and which it was."""
    out = keys
    for k, s in enumerate(sources):
        out = out.join(s.select(*on, F.col("value").alias(f"_v{k}"), F.lit(True).alias(f"_p{k}")), on, "left")
    value = F.coalesce(*(F.when(F.col(f"_p{k}"), F.struct(F.lit(k).alias("source"), F.col(f"_v{k}").alias("value"))) for k in range(len(sources))))
    return out.withColumn("_r", value).select(*keys.columns, "_r.source", "_r.value")


def dense_ids(df: DataFrame, by: str, key: str) -> DataFrame:
    return df.select(by, key).distinct().withColumn("idx", F.expr(f"dense_rank() OVER (PARTITION BY {by} ORDER BY {key}) - 1"))


def truncate_and_stride(df: DataFrame, by: list[str], order: str, n: int, k: int) -> DataFrame:
    """The first ``n`` rows of each key, and of those every ``k``-th."""
    return ranked(df, by, order, "_place").where((F.col("_place") <= n) & ((F.col("_place") - 1) % k == 0)).drop("_place")
