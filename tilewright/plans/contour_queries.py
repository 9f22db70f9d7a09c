"""Polygon queries: borders as SQL walks them crack by crack, and simplified annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contours
from ..operators.graph import cut
from ..sources import derived
from ..sources.derived import FOREGROUND_SQL, SIDE, TILE

#: An instance is the foreground of a square of this side; it has many parts, some within holes of others.
SQUARE = 32
#: Tiles that cut instances, so that borders are joined at seams.
SEAMED = 20
K = 1 << 28


def instances(spark, sf):
    number = F.floor(F.col("y") / SQUARE) * (SIDE // SQUARE) + F.floor(F.col("x") / SQUARE) + 1
    return derived.foreground(spark, sf).select("image_id", "y", "x", number.cast("long").alias("inst"))


def k05_contours(spark, sf):
    text = F.array_join(F.transform("points", lambda p: F.concat(p["x"].cast("int").cast("string"), F.lit(","), p["y"].cast("int").cast("string"))), ";")
    return contours.contours(instances(spark, sf), SEAMED).select("image_id", "inst", "y0", "x0", "n_corners", text.alias("points"))


def k05_k06_annotations(spark, sf):
    """One document an image, with the tighter bound that the export takes; an instance with an odd number is positive."""
    pix = cut(instances(spark, sf))
    cells = pix.select("image_id", "inst").distinct().withColumn("is_positive", F.col("inst") % 2 == 1)
    images = pix.select("image_id").distinct().select("image_id", F.concat(F.lit("image_"), F.col("image_id").cast("string"), F.lit(".png")).alias("name"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    return contours.annotations(contours.shapes(contours.contours(pix, 512, 0.01), cells), images)


# sides 0 west, 1 south, 2 east, 3 north; (ady, adx) along a side, (fdy, fdx) ahead on its far side
SIDES = "(VALUES (0, 0, -1, 1, 0, 1, -1), (1, 1, 0, 0, 1, 1, 1), (2, 0, 1, -1, 0, -1, 1), (3, -1, 0, 0, -1, -1, -1)) s(side, cdy, cdx, ady, adx, fdy, fdx)"
AROUND = "(VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) s(dy, dx)"
CONTOURS_SQL = f"""WITH RECURSIVE {FOREGROUND_SQL}, px AS MATERIALIZED (
  SELECT image_id, y, x, (y // {SQUARE}) * {SIDE // SQUARE} + x // {SQUARE} + 1 AS inst, row_number() OVER (ORDER BY image_id, y, x) AS node FROM fg
), near AS MATERIALIZED (
  SELECT p.node AS a, q.node AS b FROM px p, {AROUND}, px q WHERE q.image_id = p.image_id AND q.inst = p.inst AND q.y = p.y + dy AND q.x = p.x + dx
), reach(node, root) AS (
  SELECT node, node FROM px UNION SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node WHERE r.root < n.b
), firsts AS (
  SELECT px.* FROM px JOIN (SELECT DISTINCT min(root) OVER (PARTITION BY node) AS root FROM reach) c ON px.node = c.root
), crack AS MATERIALIZED (
  SELECT p.image_id, p.inst, p.node, side, f.node AS far, a.node AS ahead
  FROM px p CROSS JOIN {SIDES}
  LEFT JOIN px c ON c.image_id = p.image_id AND c.inst = p.inst AND c.y = p.y + cdy AND c.x = p.x + cdx
  LEFT JOIN px f ON f.image_id = p.image_id AND f.inst = p.inst AND f.y = p.y + fdy AND f.x = p.x + fdx
  LEFT JOIN px a ON a.image_id = p.image_id AND a.inst = p.inst AND a.y = p.y + ady AND a.x = p.x + adx
  WHERE c.node IS NULL
), following AS MATERIALIZED (
  SELECT node, side, coalesce(far, ahead, node) AS n_node, CASE WHEN far IS NOT NULL THEN (side + 3) % 4 WHEN ahead IS NOT NULL THEN side ELSE (side + 1) % 4 END AS n_side FROM crack
), walk(start, step, node, side) AS (
  SELECT node, 0, node, 0 FROM firsts
  UNION ALL SELECT w.start, w.step + 1, f.n_node, f.n_side FROM walk w JOIN following f ON f.node = w.node AND f.side = w.side WHERE NOT (f.n_node = w.start AND f.n_side = 0)
), walked AS MATERIALIZED (SELECT w.*, p.image_id, p.inst, p.y, p.x FROM walk w JOIN px p USING (node)
), nested AS (
  SELECT f.node AS start FROM firsts f JOIN walked w ON w.image_id = f.image_id AND w.inst = f.inst AND w.y = f.y AND w.x < f.x AND w.side IN (0, 2)
  GROUP BY f.node HAVING sum(1 - w.side) > 0
), pixel AS (
  SELECT *, row_number() OVER (PARTITION BY start ORDER BY step) AS k, count(*) OVER (PARTITION BY start) AS n FROM (
    SELECT *, lag(node) OVER (PARTITION BY start ORDER BY step) AS before FROM walked) WHERE before IS NULL OR before <> node
), ring AS (  -- the last pixel may be the first again
  SELECT * FROM pixel p WHERE NOT (k = n AND n > 1 AND node = start)
), turn AS (
  SELECT *, coalesce(lag(y) OVER w, last_value(y) OVER v) AS py, coalesce(lag(x) OVER w, last_value(x) OVER v) AS px_, coalesce(lead(y) OVER w, first_value(y) OVER v) AS ny, coalesce(lead(x) OVER w, first_value(x) OVER v) AS nx
  FROM ring WINDOW w AS (PARTITION BY start ORDER BY k), v AS (PARTITION BY start ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT image_id, inst, first(y ORDER BY k) AS y0, first(x ORDER BY k) AS x0, CAST(count(*) AS INT) AS n_corners, string_agg(x || ',' || y, ';' ORDER BY k) AS points
FROM turn WHERE (ny - y <> y - py OR nx - x <> x - px_) AND start NOT IN (SELECT start FROM nested) GROUP BY start, image_id, inst HAVING count(*) >= 3"""

QUERIES = {
    "K05_contours": (k05_contours, CONTOURS_SQL),
    "K05_K06_annotations": (k05_k06_annotations, None),
}
