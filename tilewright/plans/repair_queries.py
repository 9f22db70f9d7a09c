"""Queries that mend masks, and codes of masks as text, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cells, geometry, masks, pixels, regions, repairs, run_strings
from ..operators.graph import components_sql, cut, shuffled
from ..operators.regions import SHIFT
from ..sources import derived
from ..sources.derived import SIDE, TILE
from . import region_queries
from .mask_queries import RUNS_SQL
from .region_queries import CC8_SQL, STEPS4, STEPS8, WORK_TILE

MOST, LEAST, PADDING = 12, 6, 2


def code_texts(spark, sf):
    """Run-length codes as text and back again; only codes that come back whole count as such."""
    coded = masks.encode_runs(derived.foreground(spark, sf), SIDE, SIDE, ["image_id"])
    text = cut(cut(coded).select("image_id", "counts", run_strings.to_text().alias("code")))
    back = run_strings.from_text(text.withColumnRenamed("counts", "sent"), ["image_id", "code", "sent"])
    return back.select("image_id", "code", (F.col("sent").cast("array<bigint>") == F.col("counts")).alias("is_same"))


def _dense(spark, sf):
    """A mask with few and small holes."""
    return derived.pixels(spark, sf).where("y % 5 > 0 OR x % 4 > 0 OR r > 200").select("image_id", "y", "x").unionByName(
        # whole columns, each once however many of its pixels there are
        derived.read(spark, sf, "lineitem").select(*derived.place()).select("image_id", "x").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y"), "x").where("y % 3 > 0")
    ).distinct()


def holes(spark, sf):
    return repairs.holes(cut(_dense(spark, sf)), SIDE, SIDE, MOST, WORK_TILE)


def _cells(spark, sf):
    comp = cut(region_queries.components8(spark, sf, region_queries.CHANNELS))
    kinds = comp.groupBy("image_id", "component").agg(F.when(F.count_if(F.col("r") >= F.col("b")) >= F.count_if(F.col("r") < F.col("b")), "positive").otherwise("negative").alias("class"), F.count("*").alias("n"))
    return comp, kinds.where("n > 3")


def borders(spark, sf):
    """Borders of cells with more than three pixels, widened twice: pixel, class and the pass that made it."""
    comp, kinds = _cells(spark, sf)
    first = cut(repairs.borders(comp, kinds, SIDE, SIDE))
    second = cut(repairs.dilated(first, comp, SIDE, SIDE))
    third = repairs.dilated(second, comp, SIDE, SIDE)
    return third.join(shuffled(first.select(*repairs.PIXEL, F.lit(1).alias("one"))), repairs.PIXEL, "left").select(*repairs.PIXEL, "class", F.col("one").isNotNull().alias("is_first"))


def merged(spark, sf):
    """Instances of a mask with their merged regions, as they are exported."""
    fg = derived.foreground(spark, sf)
    inst = cut(fg.withColumn("inst", (F.floor(F.col("y") / 4) * 100 + F.floor(F.col("x") / 4)).cast("int")))
    scores = inst.groupBy("image_id", "inst").agg((F.max("r") / 250).alias("score")).where("inst % 7 > 0")
    out = repairs.merged_instances(inst, scores, LEAST, WORK_TILE)
    return out.select("image_id", F.col("new_id").cast("long").alias("region_id"), F.col("area").alias("pixel_count"), F.round("score", 8).alias("avg_score"), F.array_join(F.transform("members", lambda m: m.cast("string")), ";").alias("member_instances"))


def overlap_merged(spark, sf):
    comp = region_queries.components8(spark, sf)
    cells = comp.groupBy("image_id", "component").agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2")).where("n > 3")
    # unique over images and in the order of each image's cells
    placed = cells.withColumns({"id": F.col("image_id") * (SHIFT * 128) + F.col("component"), "position": F.expr("row_number() OVER (PARTITION BY image_id ORDER BY component)")})
    out = repairs.overlap_merged(cut(placed.drop("component")), PADDING, 16)
    return out.select("image_id", "x1", "y1", "x2", "y2", "pixel_count", "cy", "cx", "is_merged", F.array_join(F.transform("members", lambda m: m.cast("string")), ";").alias("members"))


def error_centres(spark, sf):
    pix = derived.pixels(spark, sf)
    truth, found = F.expr("r + b > 120 AND g <= 80"), F.expr("r > 60 AND image_id % 3 > 0 OR r + b > 120 AND g <= 80 AND image_id % 5 = 0")
    wide = pix.select("image_id", "y", "x", truth.alias("t"), found.alias("f"))
    errors = repairs.widened_errors(wide, 2, SIDE, SIDE)
    return repairs.error_centres(errors, pix.select("image_id").distinct(), SIDE, SIDE)


def rebuilt(spark, sf):
    """The mask of all tiles with its components numbered from 1 in reading order."""
    comp = cut(region_queries.components8(spark, sf))
    number = comp.select("image_id", "component").distinct().withColumn("label", F.expr("row_number() OVER (PARTITION BY image_id ORDER BY component)").cast("long"))
    return comp.join(number, ["image_id", "component"]).select("image_id", "y", "x", "label")


def red_cells(spark, sf):
    """The statistics of the cells that red pixels form."""
    red = derived.pixels(spark, sf).where(pixels.is_red())
    comp = regions.whole_image_components(red, WORK_TILE, carry=region_queries.CHANNELS)
    return cells.cell_stats(comp).withColumn("mean_marker", F.round("mean_marker", 6))


def prompt_logits(spark, sf):
    points = derived.pixels(spark, sf).where("r > 150").select("image_id", (F.col("y") - 5).alias("y"), (F.col("x") + 7).alias("x"))
    return pixels.prompt_logits(points, ["image_id"], SIDE, SIDE, 8)


def region_instances(spark, sf):
    """Merged regions with the tiles' instances whose box, within the tile, is theirs."""
    merged_ = region_queries.merged(spark, sf)
    shape = lambda keys, y, x: merged_.groupBy("image_id", *keys).agg(F.min(y).alias("y1"), F.min(x).alias("x1"), F.max(y).alias("y2"), F.max(x).alias("x2"))
    whole = shape(["global_region"], "y", "x").withColumnRenamed("global_region", "id")
    local = shape(["region"], F.col("y") % TILE, F.col("x") % TILE).withColumnRenamed("region", "id")
    return geometry.matching_boxes(whole, local, ["image_id"])


def resolved(spark, sf):
    r, p = scalars.RESOLVERS, derived.read(spark, sf, "part")
    a, b = F.col("p_size"), F.col("p_partkey")
    return p.select("p_partkey", r["add"](a, b, F.lit(1)).alias("add"), r["times"](a, b).alias("times"), F.round(r["divide"](b, a), 6).alias("divide"), r["pow"](a, F.lit(2)).alias("pow"), r["subtract"](a, b).alias("subtract"), F.size(r["range"](a % 5)).alias("range"), r["int"]((a - b) / 7).alias("int"), r["ceil_int"](b / 7).alias("ceil_int"))


_LENGTH = "CASE " + " ".join(f"WHEN x >= {-(1 << 5 * k - 1)} AND x < {1 << 5 * k - 1} THEN {k}" for k in range(1, 7)) + " ELSE 7 END"
TEXT_SQL = RUNS_SQL + f""", l AS (SELECT image_id, list_concat(flatten(list([zeros, e - s + 1] ORDER BY s)), CASE WHEN max(e) < {SIDE * SIDE - 1} THEN [{SIDE * SIDE - 1} - max(e)] ELSE [] END) AS counts FROM z GROUP BY 1),
  d AS (SELECT image_id, i, CASE WHEN i > 3 THEN counts[i] - counts[i - 2] ELSE counts[i] END::BIGINT AS x FROM l, unnest(generate_series(1, len(counts))) t(i)),
  n AS (SELECT image_id, i, x, {_LENGTH} AS n FROM d), c AS (SELECT image_id, i, j, chr((48 + ((x >> (5 * j)) & 31) + CASE WHEN j < n - 1 THEN 32 ELSE 0 END)::INT) AS c FROM n, range(7) r(j) WHERE j < n)
  SELECT image_id, string_agg(c, '' ORDER BY i, j) AS code, true AS is_same FROM c GROUP BY 1"""
DENSE_SQL = derived.PIXELS_SQL + f""", m AS (SELECT image_id, y, x FROM pix WHERE y % 5 > 0 OR x % 4 > 0 OR r > 200 UNION SELECT DISTINCT image_id, k::INT, x FROM pix, range({SIDE}) r(k) WHERE k % 3 > 0),
  bg AS (SELECT i.image_id, a.y::INT AS y, b.x::INT AS x FROM (SELECT DISTINCT image_id FROM m) i, range({SIDE}) a(y), range({SIDE}) b(x) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = i.image_id AND m.y = a.y AND m.x = b.x))"""
BORDER_SQL = CC8_SQL + f""", kind AS (SELECT image_id, component, CASE WHEN count(*) FILTER (r >= b) >= count(*) FILTER (r < b) THEN 'positive' ELSE 'negative' END AS class FROM comp GROUP BY 1, 2 HAVING count(*) > 3),
  b1 AS (SELECT p.image_id, p.y + s.dy AS y, p.x + s.dx AS x, arg_min(class, component) AS class FROM comp p JOIN kind USING (image_id, component), {STEPS4}
    WHERE p.y * {SHIFT} + p.x <> component AND p.y + s.dy BETWEEN 0 AND {SIDE - 1} AND p.x + s.dx BETWEEN 0 AND {SIDE - 1} AND NOT EXISTS (SELECT 1 FROM comp q WHERE q.image_id = p.image_id AND q.y = p.y + s.dy AND q.x = p.x + s.dx) GROUP BY 1, 2, 3)"""


def _wider_sql(one: str, two: str) -> str:
    taken = f"(SELECT image_id, y, x FROM comp UNION ALL SELECT image_id, y, x FROM {one})"
    return f"""{two} AS (SELECT image_id, y, x, class FROM {one} UNION ALL SELECT p.image_id, p.y + s.dy, p.x + s.dx, arg_min(class, p.y * {SHIFT} + p.x) FROM {one} p, {STEPS8}
      WHERE p.y + s.dy BETWEEN 0 AND {SIDE - 1} AND p.x + s.dx BETWEEN 0 AND {SIDE - 1} AND NOT EXISTS (SELECT 1 FROM {taken} q WHERE q.image_id = p.image_id AND q.y = p.y + s.dy AND q.x = p.x + s.dx) GROUP BY 1, 2, 3)"""


QUERIES = {
    "X03_X06_code_texts": (code_texts, "WITH " + TEXT_SQL),
    "G11_G13_holes": (holes, "WITH RECURSIVE " + DENSE_SQL + f""", k AS (SELECT *, image_id::HUGEINT * {SHIFT}::HUGEINT * {SHIFT} + y * {SHIFT}::BIGINT + x AS node FROM bg),
        e AS (SELECT p.node AS a, q.node AS b FROM k p, {STEPS8}, k q WHERE q.image_id = p.image_id AND q.y = p.y + s.dy AND q.x = p.x + s.dx), {components_sql("k", "e")},
        n AS (SELECT image_id, y, x, (root % ({SHIFT}::HUGEINT * {SHIFT}))::BIGINT AS component, count(*) OVER (PARTITION BY root) AS area FROM k JOIN cc USING (node)) SELECT * FROM n WHERE area <= {MOST}"""),
    "G18_G19_borders": (borders, "WITH RECURSIVE " + BORDER_SQL + ", " + _wider_sql("b1", "b2") + ", " + _wider_sql("b2", "b3") + " SELECT b3.*, EXISTS (SELECT 1 FROM b1 WHERE b1.image_id = b3.image_id AND b1.y = b3.y AND b1.x = b3.x) AS is_first FROM b3"),
    "G17_K02_merged_instances": (merged, "WITH RECURSIVE " + CC8_SQL + f""", i AS (SELECT image_id, component, r, (y // 4 * 100 + x // 4)::INT AS inst FROM comp), sc AS (SELECT image_id, inst, max(r) / 250 AS score FROM i WHERE inst % 7 > 0 GROUP BY 1, 2),
        mem AS (SELECT image_id, component, inst, count(*) AS n FROM i GROUP BY 1, 2, 3), g AS (SELECT image_id, component, sum(n)::BIGINT AS pixel_count, round(avg(coalesce(score, 0)), 8) AS avg_score, array_to_string(list(inst ORDER BY inst), ';') AS member_instances FROM mem LEFT JOIN sc USING (image_id, inst) GROUP BY 1, 2)
        SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY component) AS region_id, pixel_count, avg_score, member_instances FROM g WHERE pixel_count >= {LEAST}"""),
    "A17_overlap_merged_cells": (overlap_merged, "WITH RECURSIVE " + CC8_SQL + f""", c0 AS (SELECT image_id, component, count(*) AS n, sum(y) AS sy, sum(x) AS sx, min(x) - {PADDING} AS x1, min(y) - {PADDING} AS y1, max(x) + {PADDING} AS x2, max(y) + {PADDING} AS y2 FROM comp GROUP BY 1, 2 HAVING count(*) > 3),
        cell AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY component) AS position, image_id::HUGEINT * {SHIFT}::HUGEINT * {SHIFT} + component AS node FROM c0),
        ce AS (SELECT a.node AS a, b.node AS b FROM cell a JOIN cell b ON a.image_id = b.image_id AND a.node <> b.node AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2),
        {components_sql("cell", "ce").replace("reach", "reach3").replace("cc AS", "oc AS")}
        SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum(n)::BIGINT AS pixel_count, trunc(sum(sy) / sum(n))::INT AS cy, trunc(sum(sx) / sum(n))::INT AS cx, count(*) > 1 AS is_merged, array_to_string(list(position ORDER BY position), ';') AS members FROM cell JOIN oc USING (node) GROUP BY image_id, root"""),
    "G09_rebuilt_mask": (rebuilt, "WITH RECURSIVE " + CC8_SQL + " SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY component) AS label FROM comp"),
    "A02_red_cell_stats": (red_cells, "WITH RECURSIVE " + region_queries.CELL_SQL.replace("r + b > 120 AND g <= 80", "r > 150 AND g < 100 AND b < 100") + " SELECT * REPLACE (round(mean_marker, 6) AS mean_marker) FROM cell"),
    "F26_prompt_logits": (prompt_logits, "WITH " + derived.PIXELS_SQL + f", p AS (SELECT image_id, y - 5 AS y, x + 7 AS x FROM pix WHERE r > 150), c AS (SELECT image_id, y // 8 AS y, x // 8 AS x, count(*) AS n FROM p WHERE y BETWEEN 0 AND {SIDE - 1} AND x BETWEEN 0 AND {SIDE - 1} GROUP BY 1, 2, 3) SELECT i.image_id, a.y::INT AS y, b.x::INT AS x, 5.0::DOUBLE * (2 * coalesce(n, 0) / 64 - 1) AS v FROM (SELECT DISTINCT image_id FROM p) i CROSS JOIN range({SIDE // 8}) a(y) CROSS JOIN range({SIDE // 8}) b(x) LEFT JOIN c ON c.image_id = i.image_id AND c.y = a.y AND c.x = b.x"),
    "J07_region_instances": (region_instances, "WITH RECURSIVE " + region_queries.MERGED_SQL + f""", w AS (SELECT image_id, global_region AS id, min(y) AS y1, min(x) AS x1, max(y) AS y2, max(x) AS x2 FROM merged GROUP BY 1, 2), l AS (SELECT image_id, region AS id, min(y % {TILE}) AS y1, min(x % {TILE}) AS x1, max(y % {TILE}) AS y2, max(x % {TILE}) AS x2 FROM merged GROUP BY 1, 2)
        SELECT w.image_id, w.id AS a, l.id AS b FROM w JOIN l ON w.image_id = l.image_id AND abs(w.x1 - l.x1) <= 2 AND abs(w.y1 - l.y1) <= 2 AND abs(w.x2 - l.x2) <= 2 AND abs(w.y2 - l.y2) <= 2 AND w.x1 <= l.x2 AND l.x1 <= w.x2 AND w.y1 <= l.y2 AND l.y1 <= w.y2"""),
    "X15_resolvers": (resolved, "SELECT p_partkey, p_size + p_partkey + 1 AS add, p_size * p_partkey AS times, round(p_partkey / p_size, 6) AS divide, pow(p_size, 2) AS pow, p_size - p_partkey AS subtract, (p_size % 5)::INT AS range, trunc((p_size - p_partkey) / 7)::BIGINT AS int, ceil(p_partkey / 7)::BIGINT AS ceil_int FROM part"),
    "G20_error_centres": (error_centres, "WITH " + derived.PIXELS_SQL + f""", w AS (SELECT image_id, y + dy AS y, x + dx AS x, bool_or(r + b > 120 AND g <= 80) AS t, bool_or(r > 60 AND image_id % 3 > 0 OR r + b > 120 AND g <= 80 AND image_id % 5 = 0) AS f FROM pix, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1} GROUP BY 1, 2, 3),
        e AS (SELECT image_id, y, x, t AS missed FROM w WHERE t <> f),
        rim AS (SELECT DISTINCT image_id, missed, y + s.dy AS y, x + s.dx AS x FROM e, {STEPS8} WHERE NOT EXISTS (SELECT 1 FROM e q WHERE q.image_id = e.image_id AND q.missed = e.missed AND q.y = e.y + s.dy AND q.x = e.x + s.dx)),
        d AS (SELECT e.image_id, e.missed, e.y, e.x, min((e.y - rim.y) * (e.y - rim.y) + (e.x - rim.x) * (e.x - rim.x)) AS depth FROM e JOIN rim ON rim.image_id = e.image_id AND rim.missed = e.missed GROUP BY 1, 2, 3, 4),
        b AS (SELECT image_id, missed, max(depth) AS depth, arg_max(y * {SIDE} + x, depth * {SIDE * SIDE} - (y * {SIDE} + x)) AS at_ FROM d GROUP BY 1, 2),
        j AS (SELECT i.image_id, p.depth AS pd, p.at_ AS pa, n.depth AS nd, n.at_ AS na FROM (SELECT DISTINCT image_id FROM pix) i LEFT JOIN b p ON p.image_id = i.image_id AND p.missed LEFT JOIN b n ON n.image_id = i.image_id AND NOT n.missed),
        k AS (SELECT image_id, coalesce(pd, 0) > coalesce(nd, 0) AS positive, CASE WHEN coalesce(pd, 0) > coalesce(nd, 0) THEN pa ELSE coalesce(na, 0) END AS at_ FROM j)
        SELECT image_id, (at_ % {SIDE})::INT AS px, (at_ // {SIDE})::INT AS py, positive FROM k"""),
}
