"""Queries over tiles, samples and mixtures, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, pixels, sampling, tiling
from ..operators.graph import cut
from ..operators.sampling import uniform_sql
from ..sources import derived, files
from ..sources.derived import BOXES_SQL, FOREGROUND_SQL, FRAMES_SQL, PIXELS_SQL, SIDE
from . import region_queries
from .region_queries import CC8_SQL, STEPS4

FR = "WITH " + FRAMES_SQL
SIZE, PATCH, OVERLAP = SIDE, 48, 8
PHASES, EPOCH = 3, 7
SHARES = {"click": 0.5, "view": 0.25, "purchase": 0.15, "signup": 0.07, "error": 0.03}


def _text(*parts):
    return F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))


def _paths(spark, sf):
    p = derived.read(spark, sf, "part")
    r, c, k = ((F.col("p_partkey") % n).cast("string") for n in (13, 7, 5))
    four = _text("tile_", r, "_", c, "_", F.col("p_partkey").cast("string"), "_0.npy")
    name = F.when(F.col("p_partkey") % 4 == 0, four).when(F.col("p_partkey") % 4 == 1, _text("tile_r", r, "_c", c, ".npy")).when(F.col("p_partkey") % 4 == 2, _text(r, "_", c, "_x.npy")).otherwise(_text("other", r))
    return p.select("p_partkey", _text("d", k, "/", name).alias("path"))


def catalogue(spark, sf):
    return tiling.catalogue(_paths(spark, sf)).select("tile_row", "tile_col", "path", "offset_y", "offset_x")


def sidecars(spark, sf):
    paths = _paths(spark, sf)
    told = paths.where("p_partkey % 3 = 0").select(F.replace("path", F.lit(".npy"), F.lit("_meta.json")).alias("path"), (F.col("p_partkey") % 50).alias("num_instances"))
    return tiling.with_sidecars(paths, told).select("filename", "tile_row", "tile_col", "offset_y", "offset_x", "num_instances")


def grid_sizes(spark, sf):
    p = derived.read(spark, sf, "part")
    tiles = p.select("p_brand", (F.col("p_partkey") % 13).alias("tile_row"), (F.col("p_size") % 7).alias("tile_col"), F.when(F.col("p_brand") > "Brand#3", F.col("p_partkey") % 13 * 40).alias("offset_y"), F.when(F.col("p_brand") > "Brand#3", F.col("p_size") % 7 * 40).alias("offset_x"))
    return tiling.grid_size(tiles, ["p_brand"], 64)


def stitched(spark, sf):
    """Images cut into tiles and put together again; each value tells its tile."""
    pix = derived.foreground(spark, sf).select("image_id", "y", "x", "r")
    tiles = cut(tiling.cut_tiles(pix, SIZE, SIZE, PATCH, OVERLAP)).withColumn("v", F.col("r") + 1000 * F.col("tile_x") + 1_000_000 * F.col("tile_y"))
    return tiling.stitched(tiles, ["image_id"], SIZE, SIZE, PATCH, OVERLAP)


def mirrored(spark, sf):
    p = derived.read(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("at"))
    return p.select("p_partkey", "at", tiling.mirrored(F.col("at"), 20).cast("int").alias("source"))


def layers(spark, sf):
    p = derived.read(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7 + 2).alias("n"), F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("layer"))
    per = F.floor(F.col("n") / F.pow(F.lit(2.0), F.col("layer"))).cast("int")
    axis = lambda name: F.explode(F.when(F.col("per") > 0, F.sequence(F.lit(0), F.col("per") - 1))).alias(name)
    g = p.withColumn("per", per).select("*", axis("i")).select("*", axis("j"))
    return g.select("p_partkey", "layer", F.round((F.col("i") + 0.5) / F.col("per"), 6).alias("x"), F.round((F.col("j") + 0.5) / F.col("per"), 6).alias("y"))


def size_thresholds(spark, sf):
    cells = region_queries.components8(spark, sf).groupBy("image_id", "component").agg(F.count("*").alias("size"))
    wide = cells.withColumn("size", F.col("size") * F.when(F.col("component") % 3 == 0, 60).otherwise(9))
    return pixels.size_threshold(wide, ["image_id"])


def suppressed(spark, sf):
    return geometry.suppress(derived.boxes(spark, sf), "grp", 0.3)


def crop_suppressed(spark, sf):
    """Boxes of several crops: those of smaller crops are preferred."""
    b = derived.boxes(spark, sf)
    return geometry.suppress(b.withColumn("score", 1.0 / ((F.col("id") % 5 + 1) * 100)), "grp", 0.3)


def numbers(spark, sf):
    """Orders in batches of 100 by price, and in 7 shards."""
    o = derived.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    batches = sampling.numbered(o, ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.floor(F.col("number") / 100).alias("batch"))
    return batches.join(sampling.shards(o.select(F.col("o_orderkey").alias("k")), ["k"], 7), F.col("o_orderkey") == F.col("k")).select("o_orderkey", "batch", "shard")


def epoch_rows(spark, sf):
    return sampling.epoch_phase(derived.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", EPOCH, PHASES)


def mixture(spark, sf):
    d = derived.read(spark, sf, "events")
    placed = d.select("event_type", F.expr("row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1").alias("pos"))
    return sampling.mixed(placed, "event_type", "pos", SHARES, block=64).select("event_type", "pos", F.round("at", 5).alias("at"))


def window_sample(spark, sf):
    d = derived.frames(spark, sf).select("video", "frame", "object", (F.col("value") > 5).alias("visible"))
    return sampling.window_sample(d, 6, 1)


def repeats(spark, sf):
    d = derived.frames(spark, sf).groupBy("video").agg(F.count("*").alias("n"))
    factor = F.col("n") / 60
    more = (sampling.uniform(F.col("video"), seed=7) < factor - F.floor(factor)).cast("int")
    return d.select("video", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.floor(factor) + more).cast("int")))).alias("copy"))


def error_points(spark, sf):
    pix = derived.pixels(spark, sf)
    errors = pix.withColumns({"t": F.expr("r + b > 120 AND g <= 80"), "f": F.expr("r > 60 AND image_id % 3 > 0 OR r + b > 120 AND g <= 80")}).where("t <> f")
    truth = pix.where("r + b > 120 AND g <= 80")
    return sampling.error_points(errors.select("image_id", "y", "x", F.col("t").alias("missed")), truth, pix.select("image_id").distinct(), 3, SIDE, SIDE)


def noisy_boxes(spark, sf):
    out = sampling.noisy_boxes(derived.boxes(spark, sf), ["id"], 4000, 5000)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def prompt_points(spark, sf):
    return sampling.prompt_points(derived.foreground(spark, sf).withColumn("part", F.floor(F.col("y") / 8).cast("int")), ["image_id", "part"], 5)


def masklets_at(spark, sf):
    d = derived.frames(spark, sf)
    found = d.where("frame % 4 = 0").select("video", F.floor(F.col("frame") / 4).cast("int").alias("annotated"), "object", F.when(F.col("value") > 5, F.col("value")).alias("code"))
    return files.masklets_at(found, d.select("video", "frame"), 4, d.where("value > 20").select("video", "object"))


def copies(spark, sf):
    """Each video once for each of its frames, with the frame's key over all videos."""
    n = derived.frames(spark, sf).groupBy("video").agg(F.count("*").alias("n"))
    return n.select("video", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).withColumn("key", F.col("video") * 10_000 + F.col("copy"))


def picked(spark, sf):
    """Boxes of each group by a list of positions, which may repeat and need not be in order; and whether their score is kept."""
    b = derived.boxes(spark, sf).withColumn("position", F.expr("row_number() OVER (PARTITION BY grp ORDER BY id) - 1"))
    lists = b.select("grp").distinct().select("grp", F.posexplode(F.array(*(F.lit(k) for k in (3, 0, 0, 2, 999_999)))).alias("place", "position"))
    return lists.join(b.select("grp", "position", "id", "score"), ["grp", "position"]).select("grp", "place", "id", (F.col("score") > 500).alias("kept"))


BEGINS = ", ".join(f"({s})" for s in tiling.starts(SIZE, PATCH, OVERLAP))
LAST = SIZE - PATCH
_axis = lambda at, t: f"({at} >= {t} + CASE WHEN {t} = 0 THEN 0 ELSE {OVERLAP} END AND {at} < {t} + {PATCH} - CASE WHEN {t} = {LAST} THEN 0 ELSE {OVERLAP} END)"
PATHS_SQL = """paths AS (SELECT p_partkey, 'd' || p_partkey % 5 || '/' || CASE p_partkey % 4 WHEN 0 THEN 'tile_' || p_partkey % 13 || '_' || p_partkey % 7 || '_' || p_partkey || '_0.npy' WHEN 1 THEN 'tile_r' || p_partkey % 13 || '_c' || p_partkey % 7 || '.npy'
  WHEN 2 THEN p_partkey % 13 || '_' || p_partkey % 7 || '_x.npy' ELSE 'other' || p_partkey % 13 END AS path, (p_partkey % 13)::INT AS r, (p_partkey % 7)::INT AS c FROM part)"""


def _suppress_sql(score: str, most: float) -> str:
    size = lambda t: f"({t}.x2 - {t}.x1)::DOUBLE * ({t}.y2 - {t}.y1)"
    common = "(least(a.x2, b.x2) - greatest(a.x1, b.x1))::DOUBLE * (least(a.y2, b.y2) - greatest(a.y1, b.y1))"
    return f"""ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {score} DESC, id) AS r FROM box),
      worse AS MATERIALIZED (SELECT a.grp, a.r, list(b.id) AS better FROM ranked a JOIN ranked b ON a.grp = b.grp AND b.r < a.r AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 WHERE {common} > {most} * ({size('a')} + {size('b')} - {common}) GROUP BY 1, 2),
      steps(grp, r, kept) AS (SELECT DISTINCT grp, 0::BIGINT, []::BIGINT[] FROM box UNION ALL SELECT s.grp, s.r + 1, CASE WHEN w.better IS NOT NULL AND list_has_any(s.kept, w.better) THEN s.kept ELSE list_append(s.kept, b.id) END
        FROM steps s JOIN ranked b ON b.grp = s.grp AND b.r = s.r + 1 LEFT JOIN worse w ON w.grp = s.grp AND w.r = s.r + 1)
      SELECT grp, unnest(kept) AS id FROM (SELECT grp, arg_max(kept, r) AS kept FROM steps GROUP BY 1)"""


GRID = f"range({SIDE}) gy(y), range({SIDE}) gx(x)"
QUERIES = {
    "S05_tile_catalogue": (catalogue, "WITH " + PATHS_SQL + " SELECT r AS tile_row, c AS tile_col, max(path) AS path, CASE WHEN arg_max(p_partkey, path) % 4 = 0 THEN arg_max(p_partkey, path) END::INT AS offset_y, CASE WHEN arg_max(p_partkey, path) % 4 = 0 THEN 0 END::INT AS offset_x FROM paths WHERE p_partkey % 4 < 3 GROUP BY 1, 2"),
    "S03_S06_tile_sidecars": (sidecars, "WITH " + PATHS_SQL + " SELECT split_part(path, '/', 2) AS filename, r AS tile_row, c AS tile_col, p_partkey::INT AS offset_y, 0 AS offset_x, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 ELSE 0 END::BIGINT AS num_instances FROM paths WHERE p_partkey % 4 = 0"),
    "A32_grid_extents": (grid_sizes, "WITH t AS (SELECT p_brand, p_partkey % 13 AS r, p_size % 7 AS c, p_brand > 'Brand#3' AS o FROM part) SELECT p_brand, (max(r) + 1)::BIGINT AS n_rows, (max(c) + 1)::INT AS n_cols, CASE WHEN bool_or(o) THEN max(r * 40) + 64 ELSE (max(r) + 1) * 64 END::BIGINT AS height, CASE WHEN bool_or(o) THEN max(c * 40) + 64 ELSE (max(c) + 1) * 64 END::INT AS width FROM t GROUP BY 1"),
    "X12_X13_stitched_tiles": (stitched, "WITH " + FOREGROUND_SQL + f", t AS (SELECT image_id, y, x, r, b.s AS ty, a.s AS tx FROM fg, (VALUES {BEGINS}) a(s), (VALUES {BEGINS}) b(s) WHERE {_axis('y', 'b.s')} AND {_axis('x', 'a.s')}) SELECT image_id, y, x, arg_max(r + 1000 * tx + 1000000 * ty, ty * 1000 + tx)::INT AS v FROM t GROUP BY 1, 2, 3"),
    "X12_mirrored": (mirrored, "SELECT p_partkey, k::INT AS at, CASE WHEN k % 40 < 20 THEN k % 40 ELSE 39 - k % 40 END::INT AS source FROM part, range(48) r(k)"),
    "X08_layered_grids": (layers, "WITH g AS (SELECT p_partkey, l.layer::INT AS layer, floor((p_size % 7 + 2) / pow(2.0, layer))::INT AS per FROM part, range(3) l(layer)) SELECT p_partkey, layer, round((i + 0.5) / per, 6)::DOUBLE AS x, round((j + 0.5) / per, 6)::DOUBLE AS y FROM g, range(9) a(i), range(9) b(j) WHERE i < per AND j < per"),
    "A30_size_thresholds": (size_thresholds, "WITH RECURSIVE " + CC8_SQL + """, sized AS (SELECT image_id, component, count(*) * CASE WHEN component % 3 = 0 THEN 60 ELSE 9 END AS size FROM comp GROUP BY 1, 2), ends AS (SELECT image_id, count(*) AS n, (max(sqrt(size)) + 1) / 500 AS step FROM sized GROUP BY 1),
        dens AS (SELECT image_id, i, step, n, round(sum(exp(-(i * step - sqrt(size)) * (i * step - sqrt(size)) / 2)) / n, 9) AS d FROM sized JOIN ends USING (image_id), range(500) r(i) GROUP BY 1, 2, 3, 4), dips AS (SELECT *, lag(d) OVER v AS a, lead(d) OVER v AS z FROM dens WINDOW v AS (PARTITION BY image_id ORDER BY i)),
        fit AS (SELECT image_id, n, (coalesce(min(i) FILTER (d < a AND d < z), 1) - 1) * step AS at_ FROM dips GROUP BY image_id, n, step) SELECT image_id, CASE WHEN n <= 1 THEN 0 ELSE round_even(pow(CASE WHEN at_ < 4 THEN 4 WHEN at_ > 10 THEN 7 ELSE at_ END, 2), 0) END::BIGINT AS threshold FROM fit"""),
    "G14_suppressed_boxes": (suppressed, "WITH RECURSIVE " + BOXES_SQL + ", " + _suppress_sql("score", 0.3)),
    "G15_crop_suppressed": (crop_suppressed, "WITH RECURSIVE " + BOXES_SQL + ", " + _suppress_sql("1.0 / ((id % 5 + 1) * 100)", 0.3)),
    "G03_flooded_background": (region_queries.flooded_background, "WITH RECURSIVE " + PIXELS_SQL + f""", bg AS (SELECT i.image_id, gy.y::INT AS y, gx.x::INT AS x FROM (SELECT DISTINCT image_id FROM pix) i, {GRID} WHERE NOT EXISTS (SELECT 1 FROM pix p WHERE p.image_id = i.image_id AND p.y = gy.y AND p.x = gx.x)),
        out_ AS (SELECT * FROM bg WHERE y = 0 OR x = 0 OR y = {SIDE - 1} OR x = {SIDE - 1} UNION SELECT q.image_id, q.y, q.x FROM out_ p, {STEPS4}, bg q WHERE q.image_id = p.image_id AND q.y = p.y + s.dy AND q.x = p.x + s.dx)
        SELECT image_id, y, x, EXISTS (SELECT 1 FROM out_ o WHERE o.image_id = bg.image_id AND o.y = bg.y AND o.x = bg.x) AS outside FROM bg"""),
    "X11_R11_batches_and_shards": (numbers, "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS shard FROM orders) SELECT o_orderkey, k // 100 AS batch, shard::INT AS shard FROM n"),
    "R06_epoch_phase": (epoch_rows, f"WITH u AS (SELECT o_orderkey, {uniform_sql('o_orderkey', seed=EPOCH // PHASES)} AS u FROM orders), n AS (SELECT *, row_number() OVER (ORDER BY u, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM u) SELECT o_orderkey FROM n WHERE k // ((n + {PHASES - 1}) // {PHASES}) = {EPOCH % PHASES}"),
    "R04_mixture_times": (mixture, f"WITH p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events), w AS (SELECT *, -ln(1 - {uniform_sql('event_type', 'pos', seed=42)}) / CASE event_type {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in SHARES.items())} END AS wait FROM p) SELECT event_type, pos::INT AS pos, round(sum(wait) OVER (PARTITION BY event_type ORDER BY pos), 5) AS at FROM w WHERE wait IS NOT NULL"),
    "R01_window_sample": (window_sample, FR + f""", l AS (SELECT video, max(frame) AS last, {uniform_sql('video', "'reverse'")} < 0.5 AS back FROM frames GROUP BY 1 HAVING max(frame) >= 5), sh AS (SELECT DISTINCT video, frame, object FROM frames WHERE value > 5),
        st AS (SELECT DISTINCT video, frame, back, last, CASE WHEN back THEN frame - 5 ELSE frame END AS start FROM sh JOIN l USING (video)), s1 AS (SELECT video, frame, back, start, row_number() OVER (PARTITION BY video ORDER BY {uniform_sql('video', 'start')}, start) AS p FROM st WHERE start >= 0 AND start + 5 <= last),
        ob AS (SELECT video, object, start, back, row_number() OVER (PARTITION BY video ORDER BY {uniform_sql('video', 'object')}, object) AS k FROM sh JOIN s1 USING (video, frame) WHERE p = 1)
        SELECT video, object, i::INT AS step, CASE WHEN back THEN start + 5 - i ELSE start + i END::INT AS frame FROM ob, range(6) r(i) WHERE k <= 1"""),
    "R03_repeat_factors": (repeats, FR + f", n AS (SELECT video, count(*) / 60 AS f FROM frames GROUP BY 1) SELECT video, k::INT AS copy FROM n, range(1, 1000) r(k) WHERE k <= greatest(1, floor(f) + CASE WHEN {uniform_sql('video', seed=7)} < f - floor(f) THEN 1 ELSE 0 END)"),
    "R08_error_points": (error_points, "WITH " + PIXELS_SQL + f""", v AS (SELECT image_id, y, x, r + b > 120 AND g <= 80 AS t, r > 60 AND image_id % 3 > 0 OR r + b > 120 AND g <= 80 AS f FROM pix), e AS (SELECT image_id, y, x, t AS missed FROM v WHERE t <> f),
        c AS (SELECT i.image_id, gy.y::INT AS y, gx.x::INT AS x, false AS missed FROM (SELECT DISTINCT image_id FROM v WHERE image_id NOT IN (SELECT image_id FROM e)) i, {GRID} WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.t AND v.image_id = i.image_id AND v.y = gy.y AND v.x = gx.x)),
        a AS (SELECT *, d::INT AS draw, {uniform_sql('image_id', 'd', 'y', 'x')} AS u FROM (SELECT * FROM e UNION ALL SELECT * FROM c), range(3) r(d)), b AS (SELECT *, row_number() OVER (PARTITION BY image_id, draw ORDER BY u DESC, y DESC, x DESC) AS p FROM a) SELECT image_id, draw, x AS px, y AS py, missed AS positive FROM b WHERE p = 1"""),
    "R09_noisy_boxes": (noisy_boxes, "WITH " + BOXES_SQL + ", m AS (SELECT *, least((x2 - x1) * 0.1::DOUBLE, 20) AS mx, least((y2 - y1) * 0.1::DOUBLE, 20) AS my FROM box) SELECT id, " + ", ".join(f"round(least(greatest({c} + (2 * {uniform_sql('id', repr(c))} - 1) * m{c[0]}, 0), {4999 if c[0] == 'x' else 3999}), 6) AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM m"),
    "X14_prompt_points": (prompt_points, "WITH " + FOREGROUND_SQL + f", p AS (SELECT image_id, y // 8 AS part, y, x, row_number() OVER (PARTITION BY image_id, y // 8 ORDER BY {uniform_sql('image_id', 'y // 8', 'y', 'x')}, y, x) AS k, count(*) OVER (PARTITION BY image_id, y // 8) AS n FROM fg) SELECT image_id, part, false AS is_centre, x, y FROM p WHERE n <= 5 OR k < 5 UNION ALL SELECT image_id, part, true, trunc(avg(x))::INT, trunc(avg(y))::INT FROM p WHERE n > 5 GROUP BY 1, 2"),
    "S16_masklets_at_frames": (masklets_at, FR + " SELECT f.video, f.frame, a.object, CASE WHEN a.value > 5 THEN a.value END AS code FROM frames f JOIN frames a ON a.video = f.video AND a.frame = f.frame // 4 * 4 WHERE (a.video, a.object) IN (SELECT (video, object) FROM frames WHERE value > 20)"),
    "S21_J19_video_copies": (copies, FR + ", n AS (SELECT video, count(*) AS n FROM frames GROUP BY 1) SELECT video, k::INT AS copy, video * 10000 + k AS key FROM n, range(1, 10000) r(k) WHERE k <= n"),
    "F12_F18_F19_picked": (picked, "WITH " + BOXES_SQL + ", b AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS position, id, score FROM box) SELECT grp, place::INT AS place, id, score > 500 AS kept FROM b JOIN (VALUES (0, 3), (1, 0), (2, 0), (3, 2), (4, 999999)) l(place, position) USING (position)"),
}
