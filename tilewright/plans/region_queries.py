"""Queries over regions, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, regions
from ..operators.graph import components_sql, cut
from ..sources import derived
from ..sources.derived import FOREGROUND_SQL, TILE

K = regions.SHIFT
CHANNELS = ("r", "g", "b")
#: Components of whole images do not depend on the tiles they are labelled in; these are of the size that images come in.
WORK_TILE = 512
STEPS8 = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) s(dy, dx)"
STEPS4 = "(VALUES (-1,0),(0,-1),(0,1),(1,0)) s(dy, dx)"
#: Keys that put the image first; the table's own key is the rest.
NODE = f"(image_id::HUGEINT * {K}::HUGEINT * {K} + y * {K}::BIGINT + x)"
PICK = f"(%s %% ({K}::HUGEINT * {K}))::BIGINT"


def _cc_sql(source: str, steps: str, tiled: bool) -> str:
    same = f" AND q.y // {TILE} = p.y // {TILE} AND q.x // {TILE} = p.x // {TILE}" if tiled else ""
    return f"""k AS (SELECT *, {NODE} AS node FROM {source}),
e AS (SELECT p.node AS a, q.node AS b FROM k p, {steps}, k q WHERE q.image_id = p.image_id AND q.y = p.y + s.dy AND q.x = p.x + s.dx{same}),
{components_sql("k", "e")}"""


TILED_SQL = FOREGROUND_SQL + ", " + _cc_sql("fg", STEPS8, True) + f""", lab AS (
  SELECT image_id, y, x, y // {TILE} AS tile_row, x // {TILE} AS tile_col, {PICK % 'root'} AS region FROM k JOIN cc USING (node))"""
PAIRS_SQL = TILED_SQL + """, seams AS (
  SELECT DISTINCT p.image_id, p.region AS a, q.region AS b FROM lab p JOIN lab q
  ON q.image_id = p.image_id AND ((q.y = p.y AND q.x = p.x + 1) OR (q.y = p.y + 1 AND q.x = p.x)) WHERE p.tile_row <> q.tile_row OR p.tile_col <> q.tile_col)"""
MERGED_SQL = PAIRS_SQL + f""", rn AS (SELECT DISTINCT image_id::HUGEINT * {K}::HUGEINT * {K} + region AS node FROM lab),
re AS (SELECT image_id::HUGEINT * {K}::HUGEINT * {K} + a AS a, image_id::HUGEINT * {K}::HUGEINT * {K} + b AS b FROM seams
       UNION SELECT image_id::HUGEINT * {K}::HUGEINT * {K} + b, image_id::HUGEINT * {K}::HUGEINT * {K} + a FROM seams),
{components_sql("rn", "re").replace("reach", "reach2").replace("cc AS", "rc AS")}, merged AS (
  SELECT lab.*, {PICK % 'rc.root'} AS global_region FROM lab JOIN rc ON rc.node = image_id::HUGEINT * {K}::HUGEINT * {K} + region)"""
GLOBAL_SQL = MERGED_SQL + f""", inner8 AS (
  SELECT m.image_id, m.global_region, m.y, m.x FROM merged m, {STEPS8}, merged q
  WHERE q.image_id = m.image_id AND q.global_region = m.global_region AND q.y = m.y + s.dy AND q.x = m.x + s.dx GROUP BY 1, 2, 3, 4 HAVING count(*) = 8
), rim AS (
  SELECT image_id, global_region, count(*) AS perimeter FROM merged m ANTI JOIN inner8 USING (image_id, global_region, y, x) GROUP BY 1, 2
), whole AS (
  SELECT image_id, global_region, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y1, min(x) AS x1, max(y) AS y2, max(x) AS x2,
         count(DISTINCT (tile_row, tile_col)) AS n_tiles, count(DISTINCT region) AS n_sources FROM merged GROUP BY 1, 2
), g AS (SELECT whole.*, coalesce(perimeter, 0) AS perimeter,
         CASE WHEN coalesce(perimeter, 0) > 0 THEN 4 * pi() * area / (perimeter * perimeter) ELSE 0 END AS circularity FROM whole LEFT JOIN rim USING (image_id, global_region))"""


def labelled(spark, sf):
    return regions.tile_regions(derived.foreground(spark, sf), TILE)


def merged(spark, sf):
    lab = cut(regions.tile_regions(derived.foreground(spark, sf), TILE, near=True))
    return cut(regions.merged_regions(lab, regions.seam_pairs(lab, TILE)))


def tile_region_stats(spark, sf):
    return regions.border_flags(labelled(spark, sf), TILE).withColumns({"cy": F.round("cy", 6), "cx": F.round("cx", 6)})


def seam_pairs(spark, sf):
    return regions.seam_pairs(cut(labelled(spark, sf)), TILE)


def tile_adjacency(spark, sf):
    tiles = derived.foreground(spark, sf).select("image_id", F.floor(F.col("y") / TILE).alias("tile_row"), F.floor(F.col("x") / TILE).alias("tile_col")).distinct()
    return cells.adjacent_tiles(tiles)


def global_regions(spark, sf):
    out = regions.global_regions(merged(spark, sf), TILE)
    return out.withColumns({c: F.round(c, 6) for c in ("cy", "cx", "circularity")})


def area_summary(spark, sf):
    return regions.area_summary(regions.global_regions(merged(spark, sf), TILE), ["image_id"], 0.25)


def components8(spark, sf, carry=()):
    return regions.whole_image_components(derived.foreground(spark, sf), WORK_TILE, carry=carry)


def components4(spark, sf):
    return regions.whole_image_components(derived.foreground(spark, sf), WORK_TILE, diagonal=False)


def labels_with_area(spark, sf):
    comp = cut(components8(spark, sf))
    return comp.join(comp.groupBy("image_id", "component").agg(F.count("*").alias("area")), ["image_id", "component"])


def cell_stats(spark, sf):
    comp = components8(spark, sf, CHANNELS)
    return cells.cell_stats(comp).withColumn("mean_marker", F.round("mean_marker", 6))


def positive_cells(spark, sf):
    return cells.positive_cells(cells.cell_stats(components8(spark, sf, CHANNELS)), 300, 10, 100).select("image_id", "component")


def grown_cells(spark, sf):
    comp = components8(spark, sf, CHANNELS)
    return cells.final_class(cells.grown_cells(comp), marker_threshold=200, low=3, high=200)


def cell_score(spark, sf):
    return cells.score(grown_cells(spark, sf))


def cell_export(spark, sf):
    comp = components8(spark, sf, CHANNELS)
    return cells.export_rows(cells.cell_stats(comp))


def flooded_background(spark, sf):
    return cells.flooded_background(derived.pixels(spark, sf), derived.SIDE, WORK_TILE)


def small_components(spark, sf):
    return cells.without_small(cut(components8(spark, sf)), 4)


def isolated_islands(spark, sf):
    return cells.islands(cut(components8(spark, sf)), 100)


CC8_SQL = TILED_SQL + f""", seams AS (
  SELECT DISTINCT p.image_id, p.region AS a, q.region AS b FROM lab p, (VALUES (0,1),(1,0),(1,1),(1,-1)) s(dy, dx), lab q
  WHERE q.image_id = p.image_id AND q.y = p.y + s.dy AND q.x = p.x + s.dx AND (p.tile_row <> q.tile_row OR p.tile_col <> q.tile_col))""" + MERGED_SQL[len(PAIRS_SQL):] + ", comp AS (SELECT m.image_id, m.y, m.x, fg.r, fg.g, fg.b, m.global_region AS component FROM merged m JOIN fg ON fg.image_id = m.image_id AND fg.y = m.y AND fg.x = m.x)"
CC4_SQL = FOREGROUND_SQL + ", " + _cc_sql("fg", STEPS4, False) + f", comp AS (SELECT image_id, y, x, {PICK % 'root'} AS component FROM k JOIN cc USING (node))"
CELL_SQL = CC8_SQL + """, cell AS (
  SELECT image_id, component, count(*) AS pixel_count, sum(r)::BIGINT AS sum_marker, avg(r) AS mean_marker, max(r) AS max_marker, min(r) AS min_marker,
         CAST(trunc(avg(y)) AS INT) AS cy, CAST(trunc(avg(x)) AS INT) AS cx, count(*) FILTER (r >= b) AS n_positive, count(*) FILTER (r < b) AS n_negative,
         count(*) FILTER (r >= b) >= count(*) FILTER (r < b) AS is_positive FROM comp GROUP BY 1, 2)"""
GROWN_SQL = CC8_SQL + """, grown AS (
  SELECT image_id, component, count(*) AS pixel_count, count(*) FILTER (r >= b) AS n_positive, count(*) FILTER (r < b) AS n_negative, max(r) AS max_marker,
         CAST(round_even(avg(y), 0) AS INT) AS cy, CAST(round_even(avg(x), 0) AS INT) AS cx FROM comp GROUP BY 1, 2
), fin AS (SELECT *, n_positive >= n_negative OR max_marker > 200 AS is_positive FROM grown WHERE pixel_count > 3 AND pixel_count < 200)"""
QUERIES = {
    "A07_tile_regions": (tile_region_stats, "WITH RECURSIVE " + TILED_SQL + f""" SELECT image_id, tile_row::INT AS tile_row, tile_col::INT AS tile_col, region, count(*) AS area, round(avg(y % {TILE}), 6) AS cy, round(avg(x % {TILE}), 6) AS cx,
        min(y % {TILE}) AS y1, min(x % {TILE}) AS x1, max(y % {TILE}) AS y2, max(x % {TILE}) AS x2,
        array_to_string(list_filter([CASE WHEN max(y % {TILE}) = {TILE - 1} THEN 'bottom' END, CASE WHEN min(x % {TILE}) = 0 THEN 'left' END, CASE WHEN max(x % {TILE}) = {TILE - 1} THEN 'right' END, CASE WHEN min(y % {TILE}) = 0 THEN 'top' END], lambda e: e IS NOT NULL), ',') AS edges
        FROM lab GROUP BY 1, 2, 3, 4"""),
    "J03_tile_adjacency": (tile_adjacency, "WITH " + FOREGROUND_SQL + f""", t AS (SELECT DISTINCT image_id, y // {TILE} AS r, x // {TILE} AS c FROM fg)
        SELECT a.image_id, a.r::BIGINT AS tile_row, a.c::BIGINT AS tile_col, b.r::BIGINT AS near_row, b.c::BIGINT AS near_col,
        CASE WHEN b.r = a.r + 1 THEN 'bottom' WHEN b.r = a.r - 1 THEN 'top' WHEN b.c = a.c + 1 THEN 'right' ELSE 'left' END AS side FROM t a JOIN t b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1"""),
    "J04_seam_pairs": (seam_pairs, "WITH RECURSIVE " + PAIRS_SQL + " SELECT image_id, a, b FROM seams"),
    "G10_global_regions": (global_regions, "WITH RECURSIVE " + GLOBAL_SQL + " SELECT image_id, global_region, area, round(cy, 6) AS cy, round(cx, 6) AS cx, y1, x1, y2, x2, n_tiles, n_sources, perimeter, round(circularity, 6) AS circularity FROM g"),
    "A10_area_summary": (area_summary, "WITH RECURSIVE " + GLOBAL_SQL + """ SELECT image_id, count(*) AS n, sum(area)::BIGINT AS total_area, round(avg(area), 6) AS mean_area, round(median(area), 6) AS median_area, min(area) AS min_area, max(area) AS max_area,
        round(stddev_pop(area), 6) AS std_area, round(sum(area) * 0.25, 6)::DOUBLE AS total_um2, count(*) FILTER (area < 100) AS small, count(*) FILTER (area >= 100 AND area < 500) AS medium, count(*) FILTER (area >= 500) AS large,
        count(*) FILTER (n_sources > 1) AS merged, round(100 * count(*) FILTER (n_sources > 1) / count(*), 6) AS merged_percent FROM g GROUP BY 1"""),
    "G01_components_8": (components8, "WITH RECURSIVE " + CC8_SQL + " SELECT image_id, y, x, component FROM comp"),
    "G01_components_4": (components4, "WITH RECURSIVE " + CC4_SQL + " SELECT image_id, y, x, component FROM comp"),
    "G02_labels_with_area": (labels_with_area, "WITH RECURSIVE " + CC8_SQL + " SELECT image_id, component, y, x, count(*) OVER (PARTITION BY image_id, component) AS area FROM comp"),
    "A01_cell_stats": (cell_stats, "WITH RECURSIVE " + CELL_SQL + " SELECT * REPLACE (round(mean_marker, 6) AS mean_marker) FROM cell"),
    "F05_positive_cells": (positive_cells, "WITH RECURSIVE " + CELL_SQL + " SELECT image_id, component FROM cell WHERE is_positive AND sum_marker >= 300 AND pixel_count >= 10 AND mean_marker > 100"),
    "A03_A04_grown_cells": (grown_cells, "WITH RECURSIVE " + GROWN_SQL + " SELECT * FROM fin"),
    "A05_cell_score": (cell_score, "WITH RECURSIVE " + GROWN_SQL + " SELECT image_id, count(*) AS n_total, count(*) FILTER (is_positive) AS n_positive, count(*) FILTER (NOT is_positive) AS n_negative, round_even(100.0 * count(*) FILTER (is_positive) / count(*), 1)::DOUBLE AS percent_positive FROM fin GROUP BY 1"),
    "K01_K04_cell_export": (cell_export, "WITH RECURSIVE " + CELL_SQL + """ SELECT image_id, component AS "Cell_ID", CASE WHEN is_positive THEN 'Yes' ELSE 'No' END AS "Is_Positive", pixel_count AS "Pixel_Count", sum_marker AS "Marker_Sum", printf('%.2f', round(mean_marker, 2)) AS "Marker_Mean", max_marker AS "Marker_Max", min_marker AS "Marker_Min", cy AS "Center_Y", cx AS "Center_X",
        CASE WHEN n_positive > n_negative THEN 'majority' WHEN n_positive = n_negative THEN 'tie' ELSE 'minority' END AS decision_reason FROM cell"""),
    "G12_without_small": (small_components, "WITH RECURSIVE " + CC8_SQL + ", n AS (SELECT *, count(*) OVER (PARTITION BY image_id, component) AS area FROM comp) SELECT image_id, y, x, component FROM n WHERE area > 4"),
    "G13_islands": (isolated_islands, "WITH RECURSIVE " + CC8_SQL + ", n AS (SELECT image_id, component, count(*) AS area FROM comp GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, component) AS place, max(area) OVER (PARTITION BY image_id) AS top FROM n) SELECT image_id, component, area FROM m WHERE CASE WHEN top < 100 THEN place = 1 ELSE area >= 100 END"),
}
