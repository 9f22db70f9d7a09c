"""Queries over what a mask generator puts out, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generator, masks
from ..operators.sampling import uniform_sql
from ..sources import derived
from ..sources.derived import BOXES_SQL, FOREGROUND_SQL, FRAMES_SQL, PIXELS_SQL, SIDE
from .tile_queries import _suppress_sql

SQUARE, LEAST, OVERLAP = 16, 6, 0.6
PER_SIDE = SIDE // SQUARE


def good_masks(spark, sf):
    """Parts, by brand under four settings of the two bounds; 0 leaves a bound out."""
    p = derived.read(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 2100).alias("predicted_iou"), (F.col("p_size") / 50).alias("stability"))
    out = None
    for number, (iou, stable) in enumerate(((0.0, 0.0), (0.6, 0.0), (0.0, 0.5), (0.6, 0.5))):
        part = generator.good_masks(p, iou, stable).select("p_partkey", F.lit(number).alias("setting"))
        out = part if out is None else out.unionByName(part)
    return out


def crops(spark, sf):
    """Boxes with a point and a mask pixel of each, moved from their crop, and as a model takes them, there and back."""
    b = derived.boxes(spark, sf).withColumns({"crop_x": F.col("grp") * 100, "crop_y": F.col("grp") * 50, "px": (F.col("x1") + F.col("x2")) / 2, "py": F.col("y1") + 1.0, "mx": F.col("x1"), "my": F.col("y2")})
    moved = generator.uncropped(b, ["x1", "x2", "px", "mx"], ["y1", "y2", "py", "my"])
    size = (F.lit(4000), F.lit(5000))
    tx, ty = generator.model_coordinates(F.col("px"), F.col("py"), 1024, size)
    bx, by = generator.image_coordinates(tx, ty, 1024, size)
    return moved.select("id", "x1", "y1", "x2", "y2", "px", "py", "mx", "my", F.round(tx, 6).alias("tx"), F.round(ty, 6).alias("ty"), F.round(bx, 6).alias("bx"), F.round(by, 6).alias("by"))


def stability(spark, sf):
    """Stability as a plain quotient: without a pixel above either bound it is not a number."""
    pix = derived.pixels(spark, sf).select("image_id", (F.col("y") % 16).alias("part"), F.col("r").alias("v"))
    out = masks.stability(pix, ["image_id", "part"], 260 - 20, 15, plain=True)
    return out.select("image_id", "part", F.isnan("stability").alias("is_nan"), F.when(~F.isnan("stability"), F.col("stability")).alias("stability"))


def cleaned(spark, sf):
    """Corners, more or less large, of squares of the rasters as masks of one place, cleaned; of each that stays its area and box."""
    number = F.floor(F.col("y") / SQUARE) * PER_SIDE + F.floor(F.col("x") / SQUARE)
    pix = derived.foreground(spark, sf).select(F.col("image_id").alias("grp"), (F.col("image_id") * PER_SIDE**2 + number).cast("long").alias("mask"), (F.col("y") % SQUARE).alias("y"), (F.col("x") % SQUARE).alias("x"))
    pix = pix.where(f"y < 6 + mask % {PER_SIDE} AND x < 6 + floor(mask % {PER_SIDE**2} / {PER_SIDE})")
    out = generator.cleaned(pix, SQUARE, SQUARE, LEAST, OVERLAP, 512)
    return out.groupBy("grp", "mask", "unchanged").agg(F.count("*").alias("area"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def concatenated(spark, sf):
    d = derived.frames(spark, sf).select("event_id", "video", "frame")
    return generator.concatenated([(d.where("video % 2 = 0"), 1.5), (d.where("video % 2 = 1"), 0.25), (d.where("video % 10 = 0"), 2.0)], "event_id", 5).select("event_id", "part", F.col("copy").cast("long").alias("copy"))


def unprompted(spark, sf):
    d = derived.frames(spark, sf).select(F.col("video").alias("session"), F.col("object").alias("obj"), F.col("frame"), "value")
    outputs = d.where("value > 15").withColumn("is_prompted", F.lit(True)).unionByName(d.where("frame % 2 = 0").withColumn("is_prompted", F.lit(False)).withColumn("value", -F.col("value")))
    return generator.unprompted(outputs, d.where("frame % 3 = 0"))


_CC = """{name}_e AS MATERIALIZED (SELECT p.node AS a, q.node AS b FROM {nodes} p, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) s(dy, dx), {nodes} q WHERE q.mask = p.mask AND q.y = p.y + dy AND q.x = p.x + dx),
  {name}(node, root) AS (SELECT node, node FROM {nodes} UNION SELECT e.b, r.root FROM {name} r JOIN {name}_e e ON e.a = r.node WHERE r.root < e.b),
  {name}_c AS MATERIALIZED (SELECT mask, y, x, root, count(*) OVER (PARTITION BY root) AS area FROM (SELECT node, min(root) AS root FROM {name} GROUP BY node) JOIN {nodes} USING (node))"""
CLEANED_SQL = f"""WITH RECURSIVE {FOREGROUND_SQL}, own AS (SELECT image_id * {PER_SIDE**2} + (y // {SQUARE}) * {PER_SIDE} + x // {SQUARE} AS mask, image_id AS of, y % {SQUARE} AS y, x % {SQUARE} AS x FROM fg WHERE y % {SQUARE} < 6 + x // {SQUARE} AND x % {SQUARE} < 6 + (y // {SQUARE})),
  bg AS MATERIALIZED (SELECT mask, y::INT AS y, x::INT AS x, mask * 1024 + y * {SQUARE} + x AS node FROM (SELECT DISTINCT mask FROM own), range({SQUARE}) a(y), range({SQUARE}) b(x) WHERE (mask, y, x) NOT IN (SELECT (mask, y, x) FROM own)),
  {_CC.format(name="holes", nodes="bg")},
  filled AS MATERIALIZED (SELECT mask, y, x, mask * 1024 + y * {SQUARE} + x AS node FROM (SELECT mask, y, x FROM own UNION SELECT mask, y, x FROM holes_c WHERE area < {LEAST})),
  {_CC.format(name="parts", nodes="filled")},
  kept AS (SELECT p.* FROM parts_c p JOIN (SELECT mask, max(area) AS most, arg_min(root, -area * 100000 + root % 1024) AS first FROM parts_c GROUP BY mask) m USING (mask) WHERE CASE WHEN most < {LEAST} THEN root = first ELSE area >= {LEAST} END),
  changed AS (SELECT mask FROM holes_c WHERE area < {LEAST} UNION SELECT mask FROM parts_c WHERE area < {LEAST}),
  box AS MATERIALIZED (SELECT mask AS id, mask // {PER_SIDE**2} AS grp, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS area, CASE WHEN mask IN (SELECT mask FROM changed) THEN 0 ELSE 1 END AS score FROM kept GROUP BY mask),
  {_suppress_sql("score", OVERLAP).replace("SELECT grp, unnest(kept) AS id FROM (SELECT grp, arg_max(kept, r) AS kept FROM steps GROUP BY 1)", "").rstrip().rstrip(",")},
  stay AS (SELECT unnest(kept) AS id FROM (SELECT grp, arg_max(kept, r) AS kept FROM steps GROUP BY 1))
SELECT grp, id AS mask, score > 0 AS unchanged, area, x1, y1, x2, y2 FROM box WHERE id IN (SELECT id FROM stay)"""

QUERIES = {
    "F13_good_masks": (good_masks, "SELECT p_partkey, k::INT AS setting FROM part, range(4) r(k) WHERE (k % 2 = 0 OR p_retailprice / 2100 > 0.6::DOUBLE) AND (k < 2 OR p_size / 50 >= 0.5::DOUBLE)"),
    "F15_F17_crops": (crops, f"WITH {BOXES_SQL}, m AS (SELECT id, x1 + grp * 100 AS x1, y1 + grp * 50 AS y1, x2 + grp * 100 AS x2, y2 + grp * 50 AS y2, (x1 + x2) / 2 + grp * 100 AS px, y1 + 1.0::DOUBLE + grp * 50 AS py FROM box) SELECT *, x1 AS mx, y2 AS my, round(px / 5000 * 1024, 6) AS tx, round(py / 4000 * 1024, 6) AS ty, round(px, 6) AS bx, round(py, 6) AS by FROM m"),
    "A21_plain_stability": (stability, f"WITH {PIXELS_SQL}, c AS (SELECT image_id, y % 16 AS part, count(*) FILTER (r > 255) AS hi, count(*) FILTER (r > 225) AS lo FROM pix GROUP BY 1, 2) SELECT image_id, part, lo = 0 AS is_nan, CASE WHEN lo > 0 THEN round(hi / lo, 6) END AS stability FROM c"),
    "G16_cleaned_masks": (cleaned, CLEANED_SQL),
    "U02_concatenated": (concatenated, f"""WITH {FRAMES_SQL}, p AS (SELECT event_id, 0 AS part, 1.5::DOUBLE AS factor FROM frames WHERE video % 2 = 0 UNION ALL SELECT event_id, 1, 0.25 FROM frames WHERE video % 2 = 1 UNION ALL SELECT event_id, 2, 2 FROM frames WHERE video % 10 = 0)
        SELECT event_id, part, k AS copy FROM p, range(1, 4) r(k) WHERE k <= floor(factor) + CASE WHEN {uniform_sql('part', 'event_id', seed=5)} < factor - floor(factor) THEN 1 ELSE 0 END"""),
    "Z04_unprompted": (unprompted, f"""WITH {FRAMES_SQL}, o AS (SELECT video AS session, object AS obj, frame, value, true AS is_prompted FROM frames WHERE value > 15 UNION ALL SELECT video, object, frame, -value, false FROM frames WHERE frame % 2 = 0)
        SELECT session, obj, frame, value, is_prompted AND frame % 3 > 0 AS is_prompted FROM o WHERE is_prompted OR frame % 3 > 0 OR NOT -value > 15"""),
}
