"""Queries over boxes and points, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry
from ..operators.graph import components_sql, cut
from ..sources import derived
from ..sources.derived import BOXES_SQL, POINTS_SQL

D = 12
OVERLAP_SQL = "pairs AS (SELECT p.grp, p.id AS a, q.id AS b FROM box p JOIN box q ON p.grp = q.grp AND p.id < q.id AND p.x1 <= q.x2 AND q.x1 <= p.x2 AND p.y1 <= q.y2 AND q.y1 <= p.y2)"
NEAR_SQL = f"pairs AS (SELECT p.id AS a, q.id AS b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS squared FROM pts p JOIN pts q ON p.id < q.id AND abs(p.x - q.x) < {D} AND abs(p.y - q.y) < {D} WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) < {D * D})"
SYMMETRIC = "sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)"


def _cc(items: str) -> str:
    return f"{SYMMETRIC}, nodes AS (SELECT id AS node FROM {items}), {components_sql('nodes', 'sym')}"


def overlaps(spark, sf):
    return geometry.overlapping(derived.boxes(spark, sf), 32, ["grp"]).select("grp", "a", "b")


def merged_boxes(spark, sf):
    boxes = derived.boxes(spark, sf)
    return geometry.box_union(geometry.grouped(boxes, cut(geometry.overlapping(boxes, 32, ["grp"]).select("a", "b"))), ["grp_id"])


def close_points(spark, sf):
    return geometry.within_distance(derived.points(spark, sf), D)


def point_groups(spark, sf):
    points = derived.points(spark, sf)
    return geometry.group_rollup(geometry.grouped(points, cut(geometry.within_distance(points, D))))


def group_distances(spark, sf):
    points = derived.points(spark, sf)
    pairs = cut(geometry.within_distance(points, D))
    return geometry.group_distances(cut(geometry.grouped(points, pairs)), pairs)


def clusters(spark, sf):
    return geometry.density_clusters(derived.points(spark, sf), 20, 3)


def padded(spark, sf):
    box = derived.boxes(spark, sf)
    pad = 5
    return box.select("id", *(F.greatest(F.col(c) - pad, F.lit(0)).alias(c) for c in ("x1", "y1")), (F.col("x2") + pad).alias("x2"), (F.col("y2") + pad).alias("y2"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


def tolerant(spark, sf):
    a = derived.boxes(spark, sf)
    near = geometry.overlapping(a, 32, ["grp"])
    ok = F.lit(True)
    for c in ("x1", "y1", "x2", "y2"):
        ok = ok & (F.abs(F.col(c) - F.col(f"b_{c}")) <= 2)
    return near.where(ok).select("grp", "a", "b")


QUERIES = {
    "J01_box_overlaps": (overlaps, "WITH " + BOXES_SQL + ", " + OVERLAP_SQL + " SELECT grp, a, b FROM pairs"),
    "J07_tolerant_boxes": (tolerant, "WITH " + BOXES_SQL + " SELECT p.grp, p.id AS a, q.id AS b FROM box p JOIN box q ON p.grp = q.grp AND p.id < q.id AND abs(p.x1 - q.x1) <= 2 AND abs(p.x2 - q.x2) <= 2 AND abs(p.y1 - q.y1) <= 2 AND abs(p.y2 - q.y2) <= 2 AND p.x1 <= q.x2 AND q.x1 <= p.x2 AND p.y1 <= q.y2 AND q.y1 <= p.y2"),
    "G06_A16_merged_boxes": (merged_boxes, "WITH RECURSIVE " + BOXES_SQL + ", " + OVERLAP_SQL + ", " + _cc("box") + " SELECT root AS grp_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM box JOIN cc ON node = id GROUP BY 1"),
    "J02_close_points": (close_points, "WITH " + POINTS_SQL + ", " + NEAR_SQL + " SELECT a, b, squared FROM pairs"),
    "G07_A15_point_groups": (point_groups, "WITH RECURSIVE " + POINTS_SQL + ", " + NEAR_SQL + ", " + _cc("pts") + " SELECT root AS grp_id, count(*) AS n, sum(size)::BIGINT AS size, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, string_agg(id::VARCHAR, ';' ORDER BY id) AS members FROM pts JOIN cc ON node = id GROUP BY 1"),
    "A37_K03_group_distances": (group_distances, "WITH RECURSIVE " + POINTS_SQL + ", " + NEAR_SQL + ", " + _cc("pts") + ", d AS (SELECT root, string_agg(a || '-' || b || ':' || printf('%.1f', round(sqrt(squared), 1)), ';' ORDER BY a, b) AS t FROM pairs JOIN cc ON node = a GROUP BY 1) SELECT r.root AS grp_id, coalesce(t, 'single_cell') AS distances FROM (SELECT DISTINCT root FROM cc) r LEFT JOIN d USING (root)"),
    "G08_density_clusters": (clusters, "WITH RECURSIVE " + POINTS_SQL + """, e AS (SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q ON p.id <> q.id AND abs(p.x - q.x) <= 20 AND abs(p.y - q.y) <= 20 WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 400),
        core AS (SELECT id AS node FROM pts LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) ON a = id WHERE coalesce(n, 0) + 1 >= 3), sym AS (SELECT a, b FROM e WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)), """ + components_sql("core", "sym") + """
        SELECT node AS id, root AS cluster FROM cc UNION ALL SELECT a, min(root) FROM e JOIN cc ON node = b WHERE a NOT IN (SELECT node FROM core) GROUP BY 1"""),
    "X10_F16_padded_boxes": (padded, "WITH " + BOXES_SQL + " SELECT id, greatest(x1 - 5, 0) AS x1, greatest(y1 - 5, 0) AS y1, x2 + 5 AS x2, y2 + 5 AS y2, x2 - x1 AS w, y2 - y1 AS h FROM box"),
}
