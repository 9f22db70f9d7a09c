"""Queries over tracks, sets and samples, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..sources import derived
from ..sources.derived import FRAMES_SQL

FR = "WITH " + FRAMES_SQL
V = ["video"]


def fr(spark, sf):
    return derived.frames(spark, sf)


def cands(spark, sf):
    line = derived.read(spark, sf, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") % 3).alias("cand")).agg(F.round(F.max("l_discount") * 100).cast("long").alias("s"), F.count("*").alias("n"), F.max("l_linenumber").alias("m")).select("key", "cand", (F.col("s") / 10).alias("score"), (F.col("n") * F.col("m") / 8).alias("ratio"))


CANDS = "WITH c AS (SELECT l_orderkey AS key, l_linenumber % 3 AS cand, round(max(l_discount) * 100)::BIGINT / 10 AS score, count(*) * max(l_linenumber) / 8 AS ratio FROM lineitem GROUP BY 1, 2)"


def layers(spark, sf):
    return derived.read(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 7).alias("px"), F.col("l_linenumber").alias("layer"), F.col("l_suppkey").alias("object"), (F.round(F.col("l_discount") * 100).cast("long") - 2).alias("score"))


LAYERS = "WITH l AS (SELECT l_orderkey // 7 AS px, l_linenumber AS layer, l_suppkey AS object, round(l_discount * 100)::BIGINT - 2 AS score FROM lineitem)"


def _objects(spark, sf):
    return layers(spark, sf).groupBy("px", "object").agg(F.max("score").alias("score"))


def q_running(spark, sf):
    d = fr(spark, sf)
    return d.groupBy("video", "object").agg(F.round(F.sum(F.col("value") * F.col("frame")) / F.sum("frame"), 6).alias("weighted_mean"), F.count("*").alias("n"), F.countDistinct("frame").alias("frames"))


def q_sets(spark, sf):
    d = fr(spark, sf)
    a = d.where("value > 20").select("video", "object").distinct()
    b = d.where("frame % 2 = 0").select("video", "object").distinct()
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).withColumn("kind", F.lit("first"))).unionByName(b.exceptAll(a).withColumn("kind", F.lit("second")))


def q_semi_anti(spark, sf):
    d = fr(spark, sf)
    bad = d.groupBy("video", "frame").agg(F.bool_or(F.col("value") < 5).alias("bad")).where("bad").select("video", "frame")
    allowed = d.where("object = 'click'").select("video").distinct()
    return d.join(bad, ["video", "frame"], "left_anti").join(allowed, "video", "left_semi").where(~F.col("video").isin(3, 5)).select("video", "frame", "object")


def q_fallback(spark, sf):
    d = fr(spark, sf).select("video", "frame", "value", "object")
    return ranking.fallback(d.select("video", "frame"), [d.where("object = 'click'"), d.where("object <> 'click' AND value > 30"), d.where("value <= 30")], ["video", "frame"])


def q_units(spark, sf):
    return fr(spark, sf).select("video", "object").distinct()


def q_eval_sample(spark, sf):
    d = fr(spark, sf)
    return d.select("video", "frame").join(d.where("frame = 0").select("video", "object"), "video")


def q_tiles(spark, sf):
    size = derived.read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 40 + 300).alias("w"))
    step, tile = 448, 512
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("w") - tile) / step), F.lit(0))), lambda k: F.least(k * step, F.greatest(F.col("w") - tile, F.lit(0))))
    return size.select("p_partkey", F.posexplode(starts).alias("k", "start")).select("p_partkey", F.col("k").cast("int").alias("k"), F.col("start").cast("long").alias("start"))


def q_grid(spark, sf):
    n = derived.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 4 + 1).alias("n"))
    g = n.select("k", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("k", "n", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return g.select("k", F.round((F.col("i") + 0.5) / F.col("n"), 6).alias("x"), F.round((F.col("j") + 0.5) / F.col("n"), 6).alias("y"))


def q_names(spark, sf):
    from ..sources.names import tile_position

    p = derived.read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 13).alias("r"), (F.col("p_partkey") % 7).alias("c"))
    s = lambda c: c.cast("string")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("tile_"), s(F.col("r") + 1), F.lit("_"), s(F.col("c") + 1), F.lit("_"), s(F.col("r") * 32), F.lit("_"), s(F.col("c") * 32), F.lit(".npy"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("tile_r"), s(F.col("r")), F.lit("_c"), s(F.col("c")), F.lit(".png"))).when(F.col("p_partkey") % 4 == 2, F.concat(s(F.col("r")), F.lit("_"), s(F.col("c")), F.lit("_x"))).otherwise(F.lit("other"))
    return p.select("p_partkey", *(v.alias(k) for k, v in tile_position(name).items()))


def q_strings(spark, sf):
    from ..functions import scalars

    c = derived.read(spark, sf, "customer")
    # the last six digits: a key times 997 may have more
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("c_custkey") * 997) % (1 << 24))), 6, "0"))
    r, g, b = scalars.hex_colour(colour)
    return c.select("c_custkey", r.alias("r"), g.alias("g"), b.alias("b"), scalars.humanised(F.col("c_custkey") * 977).alias("time"), scalars.content_name(F.col("c_name")).alias("stored_as"))


def simple(fn):
    return lambda spark, sf: fn(fr(spark, sf))


QUERIES = {
    "W01_first_best": (lambda s, f: ranking.first_best(cands(s, f), ["key"], "score DESC, cand").select("key", "cand"), CANDS + " SELECT key, cand FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, cand) AS k FROM c) WHERE k = 1"),
    "W02_composite_choice": (lambda s, f: ranking.composite_choice(cands(s, f), ["key"]).select("key", "cand", "value"), CANDS + ", v AS (SELECT *, round(CASE WHEN ratio < 0.3 OR ratio > 10 THEN -1 ELSE score - 0.3 * abs(ln(ratio / 1.5)) END, 6) AS value FROM c) SELECT key, cand, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, cand) AS k FROM v) WHERE k = 1 AND value >= -0.5"),
    "W03_paint_by_score": (lambda s, f: ranking.paint(_objects(s, f).withColumnRenamed("object", "layer"), ["px"]), LAYERS + ", o AS (SELECT px, object AS layer, max(score) AS score FROM l GROUP BY 1, 2) SELECT px, layer, score FROM (SELECT *, row_number() OVER (PARTITION BY px ORDER BY score DESC, layer) AS k FROM o WHERE score > 0) WHERE k = 1"),
    "W04_W05_last_and_lowest": (lambda s, f: layers(s, f).groupBy("px").agg(F.max("layer").alias("last_layer"), F.min("object").alias("lowest_object")), LAYERS + " SELECT px, max(layer) AS last_layer, min(object) AS lowest_object FROM l GROUP BY 1"),
    "W06_clamped_losers": (lambda s, f: ranking.clamp_losers(_objects(s, f), ["px"]), LAYERS + ", o AS (SELECT px, object, max(score) AS score FROM l GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY px ORDER BY score DESC, object) AS k, count(*) OVER (PARTITION BY px) AS n FROM o) SELECT px, object, CASE WHEN n > 1 AND k > 1 THEN least(score, -10.0) ELSE score END::DOUBLE AS score FROM k"),
    "W07_seen_so_far": (simple(ranking.seen_so_far), FR + " SELECT e.video, e.frame, o.object FROM frames e JOIN (SELECT video, object, min(frame) AS f FROM frames GROUP BY 1, 2) o ON o.video = e.video AND o.f <= e.frame"),
    "W08_without_ends": (lambda s, f: ranking.without_ends(fr(s, f), V).select("video", "frame", "object"), FR + " SELECT video, frame, object FROM (SELECT *, min(frame) OVER (PARTITION BY video) AS a, max(frame) OVER (PARTITION BY video) AS z FROM frames) WHERE frame > a AND frame < z"),
    "W09_look_back": (lambda s, f: ranking.look_back(fr(s, f), 7, 3), FR + ", w AS (SELECT video, frame, k::INT AS pos, (CASE WHEN k = 1 THEN frame - 1 ELSE floor((frame - 2) / 3) * 3 - (k - 2) * 3 END)::BIGINT AS memory FROM frames, range(1, 7) r(k)) SELECT w.video, w.frame, w.pos, w.memory, m.value AS memory_value FROM w JOIN frames m ON m.video = w.video AND m.frame = w.memory WHERE w.memory >= 0"),
    "W09_Z13_look_back_reverse": (lambda s, f: ranking.look_back(fr(s, f), 7, 3, reverse=True), FR + ", w AS (SELECT video, frame, k::INT AS pos, (CASE WHEN k = 1 THEN frame + 1 ELSE ceil((frame + 2) / 3) * 3 + (k - 2) * 3 END)::BIGINT AS memory FROM frames, range(1, 7) r(k)) SELECT w.video, w.frame, w.pos, w.memory, m.value AS memory_value FROM w JOIN frames m ON m.video = w.video AND m.frame = w.memory"),
    "J11_nearest_frames": (lambda s, f: ranking.nearest_frames(fr(s, f), fr(s, f).where("object = 'click' AND value > 40"), 4), FR + ", p AS (SELECT a.video, a.frame, b.frame AS mark, b.frame < a.frame AS before FROM frames a JOIN frames b ON a.video = b.video WHERE b.object = 'click' AND b.value > 40), s AS (SELECT *, row_number() OVER (PARTITION BY video, frame, before ORDER BY abs(mark - frame), mark) AS sp FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY CASE WHEN sp = 1 AND before THEN 0 WHEN sp = 1 THEN 1 ELSE 2 END, abs(mark - frame), mark) AS place FROM s) SELECT video, frame, mark, place::INT AS place FROM t WHERE place <= 4"),
    "J12_fallback": (q_fallback, FR + " SELECT video, frame, CASE WHEN object = 'click' THEN 0 WHEN value > 30 THEN 1 ELSE 2 END::INT AS source, value FROM frames"),
    "J13_dense_ids": (lambda s, f: ranking.dense_ids(fr(s, f).where("frame > 3"), "video", "object"), FR + " SELECT video, object, dense_rank() OVER (PARTITION BY video ORDER BY object) - 1 AS idx FROM (SELECT DISTINCT video, object FROM frames WHERE frame > 3)"),
    "J15_J16_S19_S23_semi_anti": (q_semi_anti, FR + " SELECT video, frame, object FROM frames WHERE NOT value < 5 AND video IN (SELECT video FROM frames WHERE object = 'click') AND video NOT IN (3, 5)"),
    "W11_away_from_events": (lambda s, f: ranking.away_from_events(fr(s, f), fr(s, f).where("object = 'error' AND value > 60"), 3).select("video", "frame"), FR + " SELECT video, frame FROM frames a WHERE NOT EXISTS (SELECT 1 FROM frames b WHERE b.video = a.video AND b.object = 'error' AND b.value > 60 AND abs(b.frame - a.frame) <= 3)"),
    "W12_islands": (lambda s, f: ranking.islands(fr(s, f), V, F.col("value") > 10), FR + ", o AS (SELECT *, value > 10 AS on_, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY frame) AS i, max(frame) OVER (PARTITION BY video) AS final FROM frames), r AS (SELECT video, final, i, min(frame) AS s, max(frame) AS l FROM o WHERE on_ GROUP BY 1, 2, 3) SELECT video, s AS start, least(l + 1, final) AS \"end\", least(l + 1, final) - s AS width FROM r WHERE s < final"),
    "W13_local_minima": (lambda s, f: ranking.local_minima(fr(s, f), V).select("video", "frame", "value"), FR + " SELECT video, frame, value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS z FROM frames WINDOW w AS (PARTITION BY video ORDER BY frame)) WHERE value < a AND value < z"),
    "W14_renumbered": (lambda s, f: ranking.ranked(fr(s, f).where("value > 30"), V, "frame", "number").select("video", "frame", F.col("number").cast("long").alias("number")), FR + " SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) AS number FROM frames WHERE value > 30"),
    "W15_newest_first": (lambda s, f: ranking.ranked(fr(s, f), V, "ts DESC, frame DESC").select("video", "frame", (F.col("place") == 1).alias("redo")), FR + " SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY ts DESC, frame DESC) = 1 AS redo FROM frames"),
    "W18_W19_first_per_object": (lambda s, f: ranking.first_best(fr(s, f).where("value > 0"), ["video", "object"], "frame").select("video", "object", "frame", "value"), FR + " SELECT video, object, min(frame) AS frame, min_by(value, frame) AS value FROM frames WHERE value > 0 GROUP BY 1, 2"),
    "A33_A39_means_and_objects": (q_running, FR + " SELECT video, object, round(sum(value * frame) / sum(frame), 6) AS weighted_mean, count(*) AS n, count(DISTINCT frame) AS frames FROM frames GROUP BY 1, 2"),
    "A35_best_so_far": (lambda s, f: ranking.best_so_far(fr(s, f), V).select("video", "frame", "best"), FR + " SELECT video, frame, max(value) OVER (PARTITION BY video ORDER BY frame) AS best FROM frames"),
    "U01_U05_sets": (q_sets, FR + ", a AS (SELECT DISTINCT video, object FROM frames WHERE value > 20), b AS (SELECT DISTINCT video, object FROM frames WHERE frame % 2 = 0) SELECT *, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"),
    "S20_units": (q_units, FR + " SELECT DISTINCT video, object FROM frames"),
    "S22_truncate_and_stride": (lambda s, f: ranking.truncate_and_stride(fr(s, f), V, "frame", 20, 3).select("video", "frame"), FR + " SELECT video, frame FROM frames WHERE frame < 20 AND frame % 3 = 0"),
    "R02_evaluation_sample": (q_eval_sample, FR + " SELECT a.video, a.frame, b.object FROM frames a JOIN frames b ON a.video = b.video AND b.frame = 0"),
    "X07_X08_point_grids": (q_grid, "SELECT c_custkey AS k, round((i.i + 0.5) / n, 6)::DOUBLE AS x, round((j.j + 0.5) / n, 6)::DOUBLE AS y FROM (SELECT c_custkey, c_custkey % 4 + 1 AS n FROM customer) t JOIN range(9) i(i) ON i.i < n JOIN range(9) j(j) ON j.j < n"),
    "X12_overlapping_tiles": (q_tiles, "SELECT p_partkey, k::INT AS k, least(k * 448, greatest(w - 512, 0))::BIGINT AS start FROM (SELECT p_partkey, p_size * 40 + 300 AS w FROM part) t JOIN range(40) r(k) ON r.k <= greatest(ceil((w - 512) / 448), 0)"),
    "S04_S06_tile_names": (q_names, """WITH p AS (SELECT p_partkey, p_partkey % 13 AS r, p_partkey % 7 AS c FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN r + 1 WHEN 1 THEN r WHEN 2 THEN r END::INT AS tile_row, CASE p_partkey % 4 WHEN 0 THEN c + 1 WHEN 1 THEN c WHEN 2 THEN c END::INT AS tile_col,
        CASE WHEN p_partkey % 4 = 0 THEN r * 32 END::INT AS offset_y, CASE WHEN p_partkey % 4 = 0 THEN c * 32 END::INT AS offset_x FROM p"""),
    "X16_X17_K16_strings": (q_strings, """WITH t AS (SELECT c_custkey, c_name, c_custkey * 997 AS v, c_custkey * 977 AS s FROM customer) SELECT c_custkey, ((v // 65536) % 256)::INT AS r, ((v // 256) % 256)::INT AS g, (v % 256)::INT AS b,
        printf('%02dd %02dh %02dm', s // 86400, (s // 3600) % 24, (s // 60) % 60) AS time, sha256(c_name) AS stored_as FROM t"""),
}
