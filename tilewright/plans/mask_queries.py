"""Queries over pixels and masks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks, pixels
from ..sources import derived
from ..sources.derived import FOREGROUND_SQL, PIXELS_SQL, SIDE, TILE

BY = ["image_id"]


def classes(spark, sf):
    pix = derived.pixels(spark, sf)
    return pix.select("image_id", "y", "x", pixels.pixel_class(120).alias("class"), pixels.pixel_class(120, 200, 150).alias("code"), (F.col("r") - F.col("b")).alias("difference"), pixels.is_red().alias("is_red"), pixels.luma().alias("luma"), pixels.brightest().alias("brightest"))


def empty_tiles(spark, sf):
    pix = derived.pixels(spark, sf).select("image_id", F.floor(F.col("y") / TILE).alias("tile_row"), F.floor(F.col("x") / TILE).alias("tile_col"), F.col("g").alias("v"))
    return pixels.empty_tiles(pix, ["image_id", "tile_row", "tile_col"], least=900.0)


def threshold(spark, sf):
    return pixels.marker_threshold(derived.pixels(spark, sf).select("image_id", F.col("r").alias("v")), BY)


def histogram(spark, sf):
    return pixels.histogram(derived.pixels(spark, sf).select("image_id", F.col("r").alias("v")), BY)


def gamma(spark, sf):
    out = pixels.gamma(derived.pixels(spark, sf).select("image_id", "y", "x", F.col("r").alias("v")), BY, 0.5, 0, 255)
    return out.withColumn("v", F.round("v", 6))


def weighted(spark, sf):
    pix = derived.pixels(spark, sf).where("b > 0 OR g > 0")
    # a pixel's planes are in one row, so they are not unfolded
    return pix.select("image_id", "y", "x", pixels.weighted_stack(F.when(F.col("g") > 0, F.array("r", "g", "b")).otherwise(F.array("r", "b")), [0.25, 0.15, 0.25]).alias("v"))


def scalings(spark, sf):
    line = derived.read(spark, sf, "part")
    w, h = F.col("p_size") * 7, (F.col("p_partkey") % 97 + 1) * 5
    fw, fh = pixels.fit_within(w, h, 240, 400)
    return line.select("p_partkey", pixels.multiple_of_four(F.col("p_size")).alias("by_four"), pixels.score_to_byte((F.col("p_partkey") % 201 - 100) / F.lit(100)).alias("byte"), fw.cast("int").alias("fit_w"), fh.cast("int").alias("fit_h"), pixels.near_crop_edge(["p_size", "p_partkey"], [30, 60], [0, 1000]).alias("at_edge"))


def arguments(spark, sf):
    part = derived.read(spark, sf, "part")
    text = F.element_at(F.array(F.lit("default"), F.lit("None"), F.lit("17"), F.lit("x1")), (F.col("p_partkey") % 4 + 1).cast("int"))
    res = F.element_at(F.array(F.lit("10x"), F.lit("20x"), F.lit("40x"), F.lit("5x")), (F.col("p_size") % 4 + 1).cast("int"))
    return part.select("p_partkey", pixels.threshold_argument(text, 99).alias("threshold"), pixels.resolution_noise(res).alias("noise"))


def runs(spark, sf):
    return masks.encode_runs(derived.foreground(spark, sf), SIDE, SIDE, BY).select("image_id", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"), masks.area_of_runs().alias("area"))


def decoded(spark, sf):
    return masks.decode_runs(masks.encode_runs(derived.foreground(spark, sf), SIDE, SIDE, BY), SIDE, BY)


def run_boxes(spark, sf):
    pix = derived.foreground(spark, sf).withColumn("part", F.floor(F.col("x") / 40)).where("(y + x) % 5 > 0")
    return masks.box_of_runs(masks.encode_runs(pix, SIDE, SIDE, ["image_id", "part"]), SIDE, ["image_id", "part"])


def _keys(spark, sf):
    pix = derived.pixels(spark, sf)
    return pix.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("tile_row")).select("image_id", F.col("tile_row").cast("int").alias("tile_row"))


def _rows(pix):
    return pix.withColumn("tile_row", F.floor(F.col("y") / TILE).cast("int"))


def _pair(spark, sf):
    pix = _rows(derived.pixels(spark, sf))
    return pix.where("r + b > 120 AND g <= 80"), pix.where("r + b > 150 AND g <= 60")


def tight_boxes(spark, sf):
    of = ["image_id", "tile_row"]
    truth = _pair(spark, sf)[0]
    zero = masks.boxes(truth, _keys(spark, sf), of, (0, 0, 0, 0)).withColumn("kind", F.lit("zero"))
    return zero.unionByName(masks.boxes(truth, _keys(spark, sf), of, (SIDE, SIDE, -1, -1)).withColumn("kind", F.lit("turned")))


def ious(spark, sf):
    return masks.overlap(*_pair(spark, sf), _keys(spark, sf), ["image_id", "tile_row"])


def stability(spark, sf):
    pix = derived.pixels(spark, sf)
    return masks.stability(pix.select("image_id", (F.col("y") % 16).alias("part"), F.col("r").alias("v")), ["image_id", "part"], 120, 30)


def boundaries(spark, sf):
    return masks.boundary(_pair(spark, sf)[0], BY, SIDE, SIDE)


def boundary_f(spark, sf):
    keys = derived.pixels(spark, sf).select("image_id").distinct()
    return masks.boundary_score(*_pair(spark, sf), keys, BY, SIDE, SIDE, 2)


RUNS_SQL = FOREGROUND_SQL + f""", pos AS (SELECT image_id, x * {SIDE} + y AS p FROM fg), isl AS (SELECT *, p - row_number() OVER (PARTITION BY image_id ORDER BY p) AS i FROM pos),
rn AS (SELECT image_id, min(p) AS s, max(p) AS e FROM isl GROUP BY image_id, i), z AS (SELECT *, s - coalesce(lag(e) OVER (PARTITION BY image_id ORDER BY s) + 1, 0) AS zeros FROM rn)"""
PAIR_SQL = PIXELS_SQL + f""", p AS (SELECT *, y // {TILE} AS tile_row FROM pix), t AS (SELECT * FROM p WHERE r + b > 120 AND g <= 80), f AS (SELECT * FROM p WHERE r + b > 150 AND g <= 60),
keys AS (SELECT DISTINCT image_id, k::INT AS tile_row FROM pix, range(5) r(k))"""


def _boundary_sql(name: str, source: str) -> str:
    has = lambda dy, dx: f"EXISTS (SELECT 1 FROM {source} q WHERE q.image_id = c.image_id AND q.y = c.y + {dy} AND q.x = c.x + {dx})"
    return f"""{name}_c AS (SELECT DISTINCT image_id, y - dy AS y, x - dx AS x FROM {source}, (VALUES (0,0),(0,1),(1,0),(1,1)) s(dy, dx) WHERE y >= dy AND x >= dx),
{name}_n AS (SELECT *, {has(0, 0)} AS m, {has(0, 1)} AS e, {has(1, 0)} AS s, {has(1, 1)} AS se FROM {name}_c c),
{name} AS (SELECT image_id, y, x FROM {name}_n WHERE CASE WHEN y = {SIDE - 1} AND x = {SIDE - 1} THEN false WHEN y = {SIDE - 1} THEN m <> e WHEN x = {SIDE - 1} THEN m <> s ELSE m <> e OR m <> s OR m <> se END)"""


QUERIES = {
    "F01_F04_pixel_classes": (classes, "WITH " + PIXELS_SQL + """ SELECT image_id, y, x, CASE WHEN r + b > 120 AND g <= 80 THEN CASE WHEN r >= b THEN 2 ELSE 1 END ELSE 0 END AS class, CASE WHEN r + b > 120 AND g <= 80 THEN CASE WHEN r >= b THEN 200 ELSE 150 END ELSE 0 END AS code,
        r - b AS difference, r > 150 AND g < 100 AND b < 100 AS is_red, CAST(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS INT) AS luma, greatest(r, g, b) AS brightest FROM pix"""),
    "F09_empty_tiles": (empty_tiles, "WITH " + PIXELS_SQL + f" SELECT image_id, (y // {TILE})::BIGINT AS tile_row, (x // {TILE})::BIGINT AS tile_col, round(coalesce(var_pop(g) FILTER (g <> 0 AND g <> 255), 0), 6) AS variance, coalesce(var_pop(g) FILTER (g <> 0 AND g <> 255), 0) < 900 AS is_empty FROM pix GROUP BY 1, 2, 3"),
    "A06_marker_threshold": (threshold, "WITH " + PIXELS_SQL + " SELECT image_id, coalesce(CAST(trunc(round((quantile_cont(r, 0.999) FILTER (r > 0) - quantile_cont(r, 0.001) FILTER (r > 0)) * 0.9 + quantile_cont(r, 0.001) FILTER (r > 0), 6)) AS INT), 128) AS threshold FROM pix GROUP BY 1"),
    "A31_histogram": (histogram, "WITH " + PIXELS_SQL + ", c AS (SELECT image_id, r AS bin, count(*) AS n FROM pix GROUP BY 1, 2), g AS (SELECT image_id, k::INT AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM pix), range(256) t(k) LEFT JOIN c USING (image_id, bin)) SELECT image_id, bin, n, CASE WHEN top > 0 THEN round(n / top, 6) ELSE 0 END AS scaled FROM (SELECT *, max(n) FILTER (bin >= 1) OVER (PARTITION BY image_id) AS top FROM g)".replace("FROM (SELECT DISTINCT image_id FROM pix), range(256) t(k) LEFT JOIN c USING (image_id, bin)", "FROM (SELECT image_id, k::INT AS bin, k FROM (SELECT DISTINCT image_id FROM pix), range(256) t(k)) LEFT JOIN c USING (image_id, bin)")),
    "F20_gamma": (gamma, "WITH " + PIXELS_SQL + ", e AS (SELECT image_id, min(r) AS a, max(r) AS z FROM pix GROUP BY 1) SELECT image_id, y, x, round(CASE WHEN a = z THEN r::DOUBLE ELSE pow((r - a) / (z - a), 0.5) * 255 + 0 END, 6) AS v FROM pix JOIN e USING (image_id)"),
    "F21_weighted_planes": (weighted, "WITH " + PIXELS_SQL + ", pl AS (SELECT image_id, y, x, 1 AS plane, r AS v FROM pix WHERE b > 0 OR g > 0 UNION ALL SELECT image_id, y, x, 2, g FROM pix WHERE g > 0 UNION ALL SELECT image_id, y, x, 3, b FROM pix WHERE b > 0 OR g > 0), o AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY plane) AS k FROM pl) SELECT image_id, y, x, round(sum(v * CASE k WHEN 1 THEN 0.25 WHEN 2 THEN 0.15 ELSE 0.25 END), 6)::DOUBLE AS v FROM o GROUP BY 1, 2, 3"),
    "F14_F23_F25_scalings": (scalings, """WITH s AS (SELECT p_partkey, p_size, p_size * 7 AS w, (p_partkey % 97 + 1) * 5 AS h FROM part), t AS (SELECT *, CASE WHEN greatest(w, h) / least(w, h) * 240 > 400 THEN CAST(round_even(400 * least(w, h) / greatest(w, h), 0) AS INT) ELSE 240 END AS side FROM s)
        SELECT p_partkey, CAST(round_even(p_size / 4, 0) * 4 AS INT) AS by_four, CAST(trunc(((p_partkey % 201 - 100) / 100::DOUBLE + 1) / 2 * 255) AS INT) AS byte,
        CASE WHEN w < h THEN side ELSE CAST(trunc(side * w / h) AS INT) END AS fit_w, CASE WHEN w < h THEN CAST(trunc(side * h / w) AS INT) ELSE side END AS fit_h,
        (abs(p_size - 30) <= 20 AND NOT abs(p_size - 0) <= 20) OR (abs(p_partkey - 60) <= 20 AND NOT abs(p_partkey - 1000) <= 20) AS at_edge FROM t"""),
    "F10_F11_arguments": (arguments, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 99 WHEN 1 THEN NULL WHEN 2 THEN 17 ELSE 99 END::INT AS threshold, CASE p_size % 4 WHEN 0 THEN 1000 WHEN 1 THEN 4000 WHEN 2 THEN 16000 END::INT AS noise FROM part"),
    "X01_A20_run_lengths": (runs, "WITH " + RUNS_SQL + f", l AS (SELECT image_id, list_concat(flatten(list([zeros, e - s + 1] ORDER BY s)), CASE WHEN max(e) < {SIDE * SIDE - 1} THEN [{SIDE * SIDE - 1} - max(e)] ELSE [] END) AS counts, sum(e - s + 1)::BIGINT AS area FROM z GROUP BY 1) SELECT image_id, array_to_string(counts, ',') AS counts, area FROM l"),
    "X02_decoded_runs": (decoded, "WITH " + FOREGROUND_SQL + " SELECT image_id, y, x FROM fg"),
    "X04_run_boxes": (run_boxes, "WITH " + FOREGROUND_SQL + f", q AS (SELECT image_id, x // 40 AS part, x * {SIDE} + y AS p FROM fg WHERE (y + x) % 5 > 0), i AS (SELECT *, p - row_number() OVER (PARTITION BY image_id, part ORDER BY p) AS k FROM q), r AS (SELECT image_id, part, min(p) AS s, max(p) AS e FROM i GROUP BY image_id, part, k) SELECT image_id, part::BIGINT AS part, min(s // {SIDE})::BIGINT AS x1, max(e // {SIDE})::BIGINT AS x2, min(CASE WHEN s // {SIDE} <> e // {SIDE} THEN 0 ELSE s % {SIDE} END)::BIGINT AS y1, max(CASE WHEN s // {SIDE} <> e // {SIDE} THEN {SIDE - 1} ELSE e % {SIDE} END)::BIGINT AS y2 FROM r GROUP BY 1, 2"),
    "A18_A19_tight_boxes": (tight_boxes, "WITH " + PAIR_SQL + f", b AS (SELECT image_id, tile_row, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM t GROUP BY 1, 2), j AS (SELECT * FROM keys LEFT JOIN b USING (image_id, tile_row)) SELECT image_id, tile_row, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1, coalesce(x2, 0) AS x2, coalesce(y2, 0) AS y2, 'zero' AS kind FROM j UNION ALL SELECT image_id, tile_row, coalesce(x1, {SIDE}), coalesce(y1, {SIDE}), coalesce(x2, -1), coalesce(y2, -1), 'turned' FROM j"),
    "A23_A24_ious": (ious, "WITH " + PAIR_SQL + ", u AS (SELECT image_id, tile_row, count(*) FILTER (t.r IS NOT NULL AND f.r IS NOT NULL) AS common, count(*) AS either FROM t FULL JOIN f USING (image_id, tile_row, y, x) GROUP BY 1, 2), j AS (SELECT image_id, tile_row, coalesce(common, 0) AS common, coalesce(either, 0) AS either FROM keys LEFT JOIN u USING (image_id, tile_row)) SELECT *, CASE WHEN either = 0 THEN 1 ELSE round(common / either, 6) END AS iou_empty_one, round(common / greatest(either, 1), 6) AS iou_empty_zero FROM j"),
    "A21_A22_stability": (stability, "WITH " + PIXELS_SQL + " SELECT image_id, y % 16 AS part, CASE WHEN count(*) FILTER (r > 90) = 0 THEN 1 ELSE round(count(*) FILTER (r > 150) / count(*) FILTER (r > 90), 6) END AS stability FROM pix GROUP BY 1, 2"),
    "A25_boundary": (boundaries, "WITH " + PAIR_SQL + ", " + _boundary_sql("ba", "t") + " SELECT * FROM ba"),
    "A26_boundary_f": (boundary_f, "WITH " + PAIR_SQL + ", " + _boundary_sql("ba", "t") + ", " + _boundary_sql("bb", "f") + """, n AS (
        SELECT image_id, (SELECT count(*) FROM ba WHERE ba.image_id = i.image_id) AS nt, (SELECT count(*) FROM bb WHERE bb.image_id = i.image_id) AS nf,
          (SELECT count(DISTINCT (bb.y, bb.x)) FROM bb JOIN ba ON ba.image_id = bb.image_id AND ba.y BETWEEN bb.y - 2 AND bb.y + 2 AND ba.x BETWEEN bb.x - 2 AND bb.x + 2 AND (ba.y - bb.y) * (ba.y - bb.y) + (ba.x - bb.x) * (ba.x - bb.x) <= 4 WHERE bb.image_id = i.image_id) AS hf,
          (SELECT count(DISTINCT (ba.y, ba.x)) FROM ba JOIN bb ON ba.image_id = bb.image_id AND ba.y BETWEEN bb.y - 2 AND bb.y + 2 AND ba.x BETWEEN bb.x - 2 AND bb.x + 2 AND (ba.y - bb.y) * (ba.y - bb.y) + (ba.x - bb.x) * (ba.x - bb.x) <= 4 WHERE ba.image_id = i.image_id) AS ht
        FROM (SELECT DISTINCT image_id FROM pix) i), q AS (SELECT image_id, CASE WHEN nf = 0 THEN 1 WHEN nt = 0 THEN 0 ELSE hf / nf END AS p, CASE WHEN nt = 0 THEN 1 WHEN nf = 0 THEN 0 ELSE ht / nt END AS r FROM n)
        SELECT image_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f FROM q"""),
}
