"""Sampling that gives the same rows every time: seeded hashes instead of random numbers, and global numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .ranking import ranked


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number from 0 to below 1 for each key: 48 bits of the key's MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def uniform_sql(*keys: str, seed: int = 0) -> str:
    """The same in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 12))::BIGINT / {float(1 << 48)})"


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """Adds each row's number from 0 in the order of all rows, which should break all ties.

    Rows are dealt out by range and sorted; a row's number is its place in its partition
    plus the rows of the partitions before, of which there is one count each.
    """
    prefix = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(f"{prefix}at", F.monotonically_increasing_id()))
    part, place = F.shiftright(f"{prefix}at", 33), F.col(f"{prefix}at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias(f"{prefix}part")).agg(F.count("*").alias(f"{prefix}n"))
    before = counts.select(f"{prefix}part", F.expr(f"sum({prefix}n) OVER (ORDER BY {prefix}part) - {prefix}n").alias(f"{prefix}before"))
    out = placed.withColumn(f"{prefix}in", part).join(F.broadcast(before), F.col(f"{prefix}in") == F.col(f"{prefix}part"))
    return out.withColumn(name, F.col(f"{prefix}before") + place).select(*df.columns, name)


def shards(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """Adds ``shard``: ``n`` nearly equal shards in order, the first of which get one row more."""
    rows = cut(numbered(df, order, "_number"))
    size, more = divmod(rows.count(), n)
    wide = more * (size + 1)
    at = F.col("_number")
    shard = F.when(at < wide, F.floor(at / (size + 1))).otherwise(more + F.floor((at - wide) / max(size, 1)))
    return rows.withColumn("shard", shard.cast("int")).drop("_number")


def epoch_phase(df: DataFrame, key: str, epoch: int, phases: int) -> DataFrame:
    """The rows of an epoch: each ``phases`` epochs pass over all rows, permuted anew, in chunks of equal size (the last may be shorter)."""
    rows = cut(numbered(df.withColumn("_u", uniform(F.col(key), seed=epoch // phases)), ["_u", key], "_number"))
    size = max(1, -(-rows.count() // phases))
    return rows.where(F.floor(F.col("_number") / size) == epoch % phases).drop("_u", "_number")


def mixed(df: DataFrame, source: str, position: str, shares: dict[str, float], seed: int = 42, block: int = 65_536) -> DataFrame:
    """Adds ``at``, the time at which each row comes up when sources are drawn by their shares until all are used up.

    Each source is a Poisson process whose rate is its share, in the order of its
    positions (from 0, without gaps).  Merged, the next row is of a source with its share of the
    chance among those that are left.  Times are summed in blocks of positions first.
    """
    rate = F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))))[F.col(source)]
    rows = df.where(rate > 0).withColumn("_wait", -F.log(1 - uniform(F.col(source), F.col(position), seed=seed)) / rate).withColumn("_block", F.floor(F.col(position) / block))
    sums = rows.groupBy(source, "_block").agg(F.sum("_wait").alias("_all"))
    before = sums.select(source, "_block", F.expr(f"sum(_all) OVER (PARTITION BY {source} ORDER BY _block) - _all").alias("_before"))
    within = rows.withColumn("_in", F.expr(f"sum(_wait) OVER (PARTITION BY {source}, _block ORDER BY {position})"))
    return within.join(before, [source, "_block"]).withColumn("at", F.col("_before") + F.col("_in")).drop("_wait", "_block", "_before", "_in")


def window_sample(frames: DataFrame, n: int, most: int, reverse: float = 0.5, seed: int = 0) -> DataFrame:
    """Per video ``n`` frames in a row from a seeded start, perhaps backwards, with at most ``most`` of the objects visible in the first.

    ``frames`` has video, frame (0, 1, ... in each video), object, visible.  Videos with
    fewer frames, or no start with a visible object, are left out.  A start needs a visible object,
    so it is drawn from those that have one.
    """
    last = frames.groupBy("video").agg(F.max("frame").alias("last")).where(F.col("last") >= n - 1)
    back = uniform(F.col("video"), F.lit("reverse"), seed=seed) < reverse
    shown = frames.where("visible").select("video", "frame", "object").distinct()
    # a visible frame starts a window forwards, or ends one that is read backwards
    starts = shown.select("video", "frame").distinct().join(last.withColumn("back", back), "video")
    starts = starts.withColumn("start", F.when(F.col("back"), F.col("frame") - (n - 1)).otherwise(F.col("frame"))).where((F.col("start") >= 0) & (F.col("start") + n - 1 <= F.col("last")))
    start = ranked(starts.withColumn("u", uniform(F.col("video"), F.col("start"), seed=seed)), ["video"], "u, start", "_p").where("_p = 1").select("video", "start", "back", F.col("frame").alias("first"))
    objects = shown.join(start, "video").where("frame = first").withColumn("u", uniform(F.col("video"), F.col("object"), seed=seed))
    objects = ranked(objects, ["video"], "u, object", "_p").where(F.col("_p") <= most).select("video", "object", "start", "back")
    steps = objects.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return steps.select("video", "object", "step", F.when(F.col("back"), F.col("start") + (n - 1) - F.col("step")).otherwise(F.col("start") + F.col("step")).alias("frame"))


def error_points(errors: DataFrame, truth: DataFrame, keys: DataFrame, n: int, height: int, width: int, seed: int = 0) -> DataFrame:
    """Per key (image_id) ``n`` seeded points of its errors; missed pixels give positive points, false ones negative.

    Without errors the points are negative and from the background.
    """
    draws = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    clean = keys.join(errors.select("image_id").distinct(), "image_id", "left_anti")
    rows = clean.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    free = rows.join(truth.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti").withColumn("missed", F.lit(False))
    pixels = errors.select("image_id", "y", "x", "missed").unionByName(free).withColumn("draw", draws)
    u = uniform(F.col("image_id"), F.col("draw"), F.col("y"), F.col("x"), seed=seed)
    best = pixels.groupBy("image_id", "draw").agg(F.max(F.struct(u.alias("u"), "y", "x", "missed")).alias("b"))
    return best.select("image_id", "draw", F.col("b.x").alias("px"), F.col("b.y").alias("py"), F.col("b.missed").alias("positive"))


def noisy_boxes(boxes: DataFrame, keys: Sequence[str], height: int, width: int, noise: float = 0.1, bound: float = 20, seed: int = 0) -> DataFrame:
    """Each corner moved by up to ``noise`` of the box's size and ``bound`` pixels, kept within the image."""
    move = {"x": F.least((F.col("x2") - F.col("x1")) * noise, F.lit(float(bound))), "y": F.least((F.col("y2") - F.col("y1")) * noise, F.lit(float(bound)))}
    shift = lambda c: (2 * uniform(*(F.col(k) for k in keys), F.lit(c), seed=seed) - 1) * move[c[0]]
    most = {"x": float(width - 1), "y": float(height - 1)}
    return boxes.select(*keys, *(F.least(F.greatest(F.col(c) + shift(c), F.lit(0.0)), F.lit(most[c[0]])).alias(c) for c in ("x1", "y1", "x2", "y2")))


def prompt_points(pixels: DataFrame, of: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Prompts of a cluster: all its pixels if there are at most ``n``, else its truncated centre and ``n - 1`` seeded pixels."""
    keys = ", ".join(of)
    placed = pixels.withColumn("_u", uniform(*(F.col(k) for k in of), F.col("y"), F.col("x"), seed=seed)).withColumn("_n", F.expr(f"count(*) OVER (PARTITION BY {keys})"))
    placed = ranked(placed, list(of), "_u, y, x", "_p")
    chosen = placed.where((F.col("_n") <= n) | (F.col("_p") < n)).select(*of, F.lit(False).alias("is_centre"), "x", "y")
    centre = placed.where(F.col("_n") > n).groupBy(*of).agg(F.avg("x").cast("int").alias("x"), F.avg("y").cast("int").alias("y")).withColumn("is_centre", F.lit(True))
    return chosen.unionByName(centre)


def prompt_plans(videos: DataFrame, points: float, boxes: float, n_init: int, n_correct: int, random_init: bool, random_correct: bool, seed: int = 0) -> DataFrame:
    """Which frames of each video (video, start, n_frames) are prompted, and how: video, frame, is_init, prompt, corrects.

    With probability ``points`` a video's initial frames get points, else masks; an initial frame with points
    gets a box with probability ``boxes``.  The first frame and others without replacement are initial, ``n_init`` or a
    random number up to it; correction points (only with points) are added on the initial frames and on further ones up to
    ``n_correct``, or to a random number from the initial ones' on.  A single image always has one frame with points, which is corrected.
    Where a video has fewer frames than drawn, all of them are taken.
    """
    draw = lambda *what: uniform(F.col("video"), *(F.lit(w) if isinstance(w, str) else w for w in what), seed=seed)
    single = F.col("n_frames") == 1
    most_init, most_correct = F.when(single, 1).otherwise(n_init), F.when(single, 1).otherwise(n_correct)
    up_to = lambda least, most, what: (least + F.floor(draw(what) * (most - least + 1))).cast("int")
    plan = videos.select("video", "start", "n_frames", (single | (draw("points") < points)).alias("by_points"), up_to(F.lit(1), most_init, "init").alias("drawn"), most_init.alias("most_init"), most_correct.alias("most_correct"))
    plan = plan.withColumn("n_init", F.col("drawn") if random_init else F.col("most_init"))
    more = F.col("by_points") & (F.col("most_correct") > F.col("n_init"))
    wanted = F.when(more, up_to(F.col("n_init"), F.col("most_correct"), "correct")) if random_correct else F.when(more, F.col("most_correct"))
    plan = plan.withColumn("n_correct", F.when(F.col("by_points"), F.coalesce(wanted, F.col("n_init"))).otherwise(0))
    each = plan.withColumn("frame", F.explode(F.sequence("start", F.col("n_frames") - 1)))
    keyed = each.withColumn("u", F.when(F.col("frame") == F.col("start"), -1.0).otherwise(draw("init frame", F.col("frame"))))
    init = ranked(keyed, ["video"], "u, frame", "init_place").withColumn("is_init", F.col("init_place") <= F.col("n_init"))
    later = init.withColumn("v", F.when(F.col("is_init"), -1.0).otherwise(draw("correct frame", F.col("frame"))))
    chosen = ranked(later, ["video"], "v, frame", "correct_place").withColumn("corrects", F.col("by_points") & (F.col("correct_place") <= F.col("n_correct")))
    prompt = F.when(~F.col("is_init"), None).when(~F.col("by_points"), "mask").when(draw("box", F.col("frame")) < boxes, "box").otherwise("point")
    return chosen.where("is_init OR corrects").select("video", "frame", "is_init", prompt.alias("prompt"), "corrects")
