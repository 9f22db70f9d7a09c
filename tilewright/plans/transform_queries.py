"""Geometric and colour transforms of the rasters, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups, resampling, sampling
from ..sources import derived
from ..sources.derived import FRAMES_SQL, PIXELS_SQL, SIDE

TURN = resampling.inverse_affine(30.0, (5.0, -3.0), 1.25, (10.0, 0.0), SIDE, SIDE)
SMALL = 96


def turned(spark, sf):
    return resampling.affine(derived.pixels(spark, sf), ["r", "g", "b"], SIDE, SIDE, TURN)


def turned_mask(spark, sf):
    mask = derived.foreground(spark, sf).select("image_id", "y", "x", F.lit(1).alias("v"))
    return resampling.affine(mask, ["v"], SIDE, SIDE, TURN, "nearest").select("image_id", "y", "x")


def resized(spark, sf):
    mask = derived.foreground(spark, sf).select("image_id", "y", "x", F.lit(1).alias("v"))
    return resampling.resized(mask, ["v"], (SIDE, SIDE), (SMALL, SMALL))


CHANNELS = {"r": (0.485, 0.229), "g": (0.456, 0.224), "b": (0.406, 0.225)}


def chained(spark, sf):
    """Mirrored, in gray, normalised."""
    out = resampling.chained(derived.pixels(spark, sf), [lambda p: resampling.mirrored(p, SIDE), resampling.in_gray, lambda p: resampling.normalised(p, CHANNELS)])
    return out.select("image_id", "y", "x", *(F.round(c, 6).alias(c) for c in CHANNELS))


def coloured(spark, sf):
    return resampling.coloured(derived.pixels(spark, sf), resampling.NUCLEI)


JITTER = {"brightness": 0.1, "contrast": 0.05, "saturation": 0.2}


def jittered(spark, sf):
    return resampling.jittered(derived.pixels(spark, sf), JITTER, ["image_id"], seed=5, decimals=4)


def prompt_plans(spark, sf):
    videos = derived.frames(spark, sf).groupBy("video").agg(F.count("*").alias("n_frames"))
    videos = videos.select("video", (F.col("video") % 3).cast("int").alias("start"), F.when(F.col("video") % 10 == 9, F.col("video") % 3 + 1).otherwise(F.col("n_frames")).cast("int").alias("n_frames"))
    videos = videos.where("n_frames > start").withColumn("n_frames", F.when(F.col("video") % 30 == 9, 1).otherwise(F.col("n_frames")))
    return sampling.prompt_plans(videos, 0.7, 0.5, 3, 7, True, True, seed=11)


def candidate_losses(spark, sf):
    """Three predictions of a mask for each video: the one of least focal and dice loss."""
    d = derived.frames(spark, sf)
    values = d.select("video", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("candidate"), ((F.col("value") % 97 + 1) / 100).alias("q"), (F.col("object") == "click").cast("int").alias("t"))
    values = values.select("video", "candidate", F.when(F.col("candidate") == 0, F.col("q")).when(F.col("candidate") == 1, 1 - F.col("q")).otherwise(0.25 + F.col("q") / 2).alias("p"), "t")
    ious = values.select("video", "candidate").distinct().withColumn("iou", (F.col("candidate") + F.col("video") % 5) / 10)
    return lookups.candidate_losses(values, ious, ["video"], {"mask": 20.0, "dice": 1.0, "iou": 1.0})


def first_rows(spark, sf):
    """The first ten tiles of the catalogue by row and column."""
    p = derived.read(spark, sf, "part").select((F.col("p_partkey") % 37).alias("row"), F.col("p_size").alias("col"), "p_partkey")
    return p.orderBy("row", "col", "p_partkey").limit(10)


_A, _B, _C, _D, _E, _F = (f"{v!r}::DOUBLE" for v in TURN)
_AT = f"""i AS (SELECT DISTINCT image_id FROM pix), at_ AS (SELECT image_id, y::INT AS y, x::INT AS x, round({_A} * x + {_B} * y + {_C}, 9) AS sx, round({_D} * x + {_E} * y + {_F}, 9) AS sy FROM i, range({SIDE}) a(y), range({SIDE}) b(x))"""
_TAPS = """taps AS (SELECT image_id, y, x, (floor(sy) + dy)::INT AS py, (floor(sx) + dx)::INT AS px, (CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w FROM at_, range(2) u(dy), range(2) v(dx))"""
_U = lambda *what: sampling.uniform_sql("video", *what, seed=11)

def _factor(what):
    return f"({1 - JITTER[what]!r}::DOUBLE + {sampling.uniform_sql(repr(what), 'image_id', seed=5)} * {1 + JITTER[what] - (1 - JITTER[what])!r}::DOUBLE)"


_L = "r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE"
_inside = "greatest(least({}, 255::DOUBLE), 0::DOUBLE) AS {}".format

QUERIES = {
    "X21_affine": (turned, f"WITH {PIXELS_SQL}, {_AT}, {_TAPS} SELECT t.image_id, t.y, t.x, " + ", ".join(f"round(sum(w * {c}), 6) AS {c}" for c in "rgb") + " FROM taps t JOIN pix p ON p.image_id = t.image_id AND p.y = t.py AND p.x = t.px WHERE w > 0 GROUP BY 1, 2, 3"),
    "X21_affine_masks": (turned_mask, f"WITH {PIXELS_SQL}, {_AT} SELECT t.image_id, t.y, t.x FROM at_ t JOIN pix p ON p.image_id = t.image_id AND p.y = round_even(sy, 0)::INT AND p.x = round_even(sx, 0)::INT WHERE r + b > 120 AND g <= 80"),
    "F27_resized": (resized, f"""WITH {PIXELS_SQL}, fg AS (SELECT image_id, y, x FROM pix WHERE r + b > 120 AND g <= 80), i AS (SELECT DISTINCT image_id FROM fg),
        at_ AS (SELECT image_id, y::INT AS y, x::INT AS x, round((x + 0.5::DOUBLE) * {SIDE / SMALL!r}::DOUBLE - 0.5::DOUBLE, 9) AS sx, round((y + 0.5::DOUBLE) * {SIDE / SMALL!r}::DOUBLE - 0.5::DOUBLE, 9) AS sy FROM i, range({SMALL}) a(y), range({SMALL}) b(x)), {_TAPS}
        SELECT t.image_id, t.y, t.x, round(sum(w), 6) AS v FROM taps t JOIN fg p ON p.image_id = t.image_id AND p.y = greatest(least(t.py, {SIDE - 1}), 0) AND p.x = greatest(least(t.px, {SIDE - 1}), 0) WHERE w > 0 GROUP BY 1, 2, 3"""),
    "V05_X21_chained": (chained, f"WITH {PIXELS_SQL}, l AS (SELECT image_id, y, ({SIDE - 1} - x)::INT AS x, (r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) / 255 AS v FROM pix) SELECT image_id, y, x, " + ", ".join(f"round((v - {m}::DOUBLE) / {d}::DOUBLE, 6) AS {c}" for c, (m, d) in CHANNELS.items()) + " FROM l"),
    "X21_jittered": (jittered, f"WITH {PIXELS_SQL}, j1 AS (SELECT image_id, y, x, " + ", ".join(_inside(f"{c} * {_factor('brightness')}", c) for c in "rgb") + f" FROM pix), jm AS (SELECT image_id, round(avg({_L}), 4) AS m FROM j1 GROUP BY 1), "
        + "j2 AS (SELECT j1.image_id, y, x, " + ", ".join(_inside(f"m + ({c} - m) * {_factor('contrast').replace('image_id', 'j1.image_id')}", c) for c in "rgb") + f" FROM j1 JOIN jm ON j1.image_id = jm.image_id), j3 AS (SELECT *, {_L} AS l FROM j2) "
        + "SELECT image_id, y, x, " + ", ".join(f"round(greatest(least(l + ({c} - l) * {_factor('saturation')}, 255::DOUBLE), 0::DOUBLE), 4) AS {c}" for c in "rgb") + " FROM j3"),
    "F22_coloured": (coloured, f"WITH {PIXELS_SQL}, l AS (SELECT image_id, y, x, least(floor(round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5::DOUBLE, 9)), 255)::INT AS v FROM pix) SELECT image_id, y, x, 0 AS r, v AS g, v AS b FROM l"),
    "R10_prompt_plans": (prompt_plans, f"""WITH {FRAMES_SQL}, n AS (SELECT video, (video % 3)::INT AS start, (CASE WHEN video % 10 = 9 THEN video % 3 + 1 ELSE count(*) END)::INT AS n_frames FROM frames GROUP BY video), o AS (SELECT video, start, CASE WHEN video % 30 = 9 THEN 1 ELSE n_frames END AS n_frames FROM n WHERE n_frames > start),
        d AS (SELECT *, n_frames = 1 OR {_U("'points'")} < 0.7 AS by_points, CASE WHEN n_frames = 1 THEN 1 ELSE 3 END AS mi, CASE WHEN n_frames = 1 THEN 1 ELSE 7 END AS mc FROM o),
        i AS (SELECT *, (1 + floor({_U("'init'")} * mi))::INT AS n_init FROM d), c AS (SELECT *, CASE WHEN NOT by_points THEN 0 WHEN mc > n_init THEN (n_init + floor({_U("'correct'")} * (mc - n_init + 1)))::INT ELSE n_init END AS n_correct FROM i),
        e AS (SELECT c.*, unnest(range(start, n_frames))::INT AS frame FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN frame = start THEN -1 ELSE {_U("'init frame'", "frame")} END, frame) <= n_init AS is_init FROM e),
        q AS (SELECT *, by_points AND row_number() OVER (PARTITION BY video ORDER BY CASE WHEN is_init THEN -1 ELSE {_U("'correct frame'", "frame")} END, frame) <= n_correct AS corrects FROM p)
        SELECT video, frame, is_init, CASE WHEN NOT is_init THEN NULL WHEN NOT by_points THEN 'mask' WHEN {_U("'box'", "frame")} < 0.5 THEN 'box' ELSE 'point' END AS prompt, corrects FROM q WHERE is_init OR corrects"""),
    "A36_W18_candidates": (candidate_losses, f"""WITH {FRAMES_SQL}, v AS (SELECT video, k::INT AS candidate, CASE k WHEN 0 THEN (value % 97 + 1) / 100 WHEN 1 THEN 1 - (value % 97 + 1) / 100 ELSE 0.25::DOUBLE + (value % 97 + 1) / 100 / 2 END AS p, CASE WHEN object = 'click' THEN 1 ELSE 0 END AS t FROM frames, range(3) r(k)),
        w AS (SELECT *, CASE WHEN t = 1 THEN p ELSE 1 - p END AS q FROM v), l AS (SELECT video, candidate, max(t) AS target, avg(CASE WHEN t = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * (1 - q) * (1 - q) * -ln(q)) AS focal, 1 - (2 * sum(p * t) + 1) / (sum(p) + sum(t) + 1) AS dice,
          pow((candidate + video % 5) / 10 - count(*) FILTER (p > 0.5 AND t = 1) / greatest(count(*) FILTER (p > 0.5 OR t = 1), 1), 2) AS iou FROM w GROUP BY video, candidate),
        b AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY round(20 * focal + dice, 9), candidate) AS place FROM l)
        SELECT video, candidate, round(focal * target, 6) AS loss_mask, round(dice * target, 6) AS loss_dice, round(iou * target, 6) AS loss_iou, round((20 * focal + dice + iou) * target, 6) AS loss FROM b WHERE place = 1"""),
    "T03_T05_first_rows": (first_rows, "SELECT p_partkey % 37 AS row, p_size AS col, p_partkey FROM part ORDER BY 1, 2, 3 LIMIT 10"),
}
